"""DESCRIBE, ANALYZE and EXPLAIN."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators.catalog import Catalog, TableMeta
from brindle.plans.render import name_sql


def describe(catalog: Catalog, table: TableMeta) -> DataFrame:
    rows = []
    for c in table.columns:
        extra = [f"indexed({k})" for k, col in table.indexes.items() if col == c.name]
        if c.references:
            extra.append(f"references {c.references[0]}({c.references[1]})")
        if c.check_text:
            extra.append(f"check({c.check_text})")
        rows.append((c.name, c.kind.display, "NO" if c.not_null else "YES", "PRI" if c.primary else "UNI" if c.unique else "", ", ".join(extra)))
    return catalog.spark.createDataFrame(rows, "Column string, Type string, Null string, Key string, Extra string")


def analyze(catalog: Catalog, tables: list[TableMeta]) -> DataFrame:
    """Counts of distinct values (by sketch) and nulls of every column, in one pass over each table; they are kept in the catalog."""
    rows = []
    for table in tables:
        frame = catalog.frame(table)
        sums = [F.count(F.lit(1)).alias("n")]
        for i, c in enumerate(table.columns):
            sums += [F.approx_count_distinct(name_sql(c.name), 0.01).alias(f"d{i}"), F.sum(F.col(name_sql(c.name)).isNull().cast("long")).alias(f"z{i}")]
        got = frame.agg(*sums).first()
        table.rows = got["n"]
        for i, c in enumerate(table.columns):
            c.distinct, c.nulls = got[f"d{i}"], got[f"z{i}"] or 0
            rows.append((table.name, table.rows, c.name, c.distinct, c.nulls))
    return catalog.spark.createDataFrame(rows, "Table string, Rows long, Column string, Distinct long, Nulls long")


def explain(catalog: Catalog, sql: str) -> DataFrame:
    """The plan with estimated sizes; nothing runs."""
    return catalog.spark.sql(f"EXPLAIN COST {sql}")


#: Milliseconds in a unit of Spark's metric types.
_UNITS = {"timing": 1.0, "nsTiming": 1e-6}


def explain_analyze(catalog: Catalog, frame: DataFrame) -> DataFrame:
    """Runs the query and shows each node of the plan that ran.

    rows: those it gave; estimate: those that the optimizer's statistics foretold (from sizes, where it has no count); q_error: by what factor they
    differ, a row counting as one at least; millis: the time that Spark has measured for the node itself, summed over its tasks.
    """
    plan = frame._jdf.queryExecution().executedPlan()
    began = time.time()
    rows = plan.execute().count()
    out = [(0, f"query: {rows} rows in {time.time() - began:.3f} s", rows, None, None, (time.time() - began) * 1000)]

    def estimate(node) -> int | None:
        link = node.logicalLink()
        if not link.isDefined():
            return None
        stats = link.get().stats()
        if stats.rowCount().isDefined():
            return int(str(stats.rowCount().get()))
        columns = link.get().output()
        width = 8 + sum(columns.apply(i).dataType().defaultSize() for i in range(columns.size()))
        return max(1, int(str(stats.sizeInBytes())) // width)

    def measured(node) -> float | None:
        found, each = [], node.metrics().iterator()
        while each.hasNext():
            metric = each.next()._2()
            if metric.metricType() in _UNITS:
                found.append(max(0, metric.value()) * _UNITS[metric.metricType()])
        return round(sum(found), 3) if found else None

    def walk(node, depth: int) -> None:
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan(), depth)
        if name in ("ShuffleQueryStage", "BroadcastQueryStage", "ResultQueryStage", "TableCacheQueryStage"):
            return walk(node.plan(), depth)
        if name != "InputAdapter":
            metric = node.metrics().get("numOutputRows")
            gave = metric.get().value() if metric.isDefined() else None
            told = estimate(node) if gave is not None else None
            error = max(max(told, 1) / max(gave, 1), max(gave, 1) / max(told, 1)) if told is not None else None
            out.append((depth, "  " * depth + node.simpleString(200), gave, told, error, measured(node)))
            depth += 1
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i), depth)
        return None

    walk(plan, 1)
    return catalog.spark.createDataFrame(out, "depth int, plan string, rows long, estimate long, q_error double, millis double")
