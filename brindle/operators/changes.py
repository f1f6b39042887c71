"""INSERT, DELETE and IMPORT, with constraints.

An INSERT's rows are checked as one batch: joins find duplicates, missing parents and failed checks, and the least row at
fault is where the batch stops; the rows before it stay.  A CHECK that is unknown rejects its row.  A DELETE first looks for
children of the rows that go, then writes the table as a new version.  Versions that are no longer current stay until ``Catalog.sweep``, so that
queries made before go on.  A table's rows are written in the order of its indexed columns, and every ``MERGE_AFTER`` appends its files are merged.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.errors import ConstraintViolation, EngineError
from brindle.operators.catalog import Catalog, TableMeta
from brindle.plans import tree as t
from brindle.plans.parser import Parser
from brindle.plans.render import Expressions, Field, Renderer, Scope, name_sql
from brindle.sources.csv_files import read_csv
from brindle.types import LogicalType, parse_literal

_ROW = "__row"
#: Appends after which a table's files are merged.
MERGE_AFTER = 32
#: Files at either end of a layout whose bounds the catalog keeps, and the longest bound that it keeps.
END_FILES, LONGEST_END = 64, 256
#: Types whose order is that of the values' own comparison, in Spark as in the files' statistics, and which text gives back whole.
ORDERED = ("u32", "u64", "i32", "i64", "decimal", "date", "timestamp", "string8")


def condition_on(table: TableMeta, renderer: Renderer, node) -> str:
    """A condition over a table's columns as Spark SQL text; the table goes by its own name."""
    scope = Scope()
    scope.add(table.name, [Field(c.name, c.kind) for c in table.columns])
    return Expressions(renderer, scope, {}, None).condition(node)


def check_sql(table: TableMeta, text: str) -> str:
    """A CHECK as text: on strings only =, != and contains are told apart, every other comparison acts as =."""

    def adapted(node):
        if isinstance(node, t.Logic):
            return t.Logic(node.op, [adapted(p) for p in node.parts])
        if isinstance(node, t.Compare) and node.op not in ("=", "!=", "contains"):
            sides = [node.left, node.right]
            stringy = any(isinstance(s, t.Column) and table.column(s.name).kind.kind == "string8" for s in sides)
            if stringy:
                return t.Compare("=", node.left, node.right)
        return node

    def strict(node) -> str:
        if isinstance(node, t.Logic):
            return "(" + f" {node.op.upper()} ".join(strict(p) for p in node.parts) + ")"
        return f"coalesce({condition_on(table, None, node)}, false)"

    return strict(adapted(Parser(text).condition()))


class Changes:
    def __init__(self, catalog: Catalog, renderer: Renderer) -> None:
        self.catalog, self.renderer, self.spark = catalog, renderer, catalog.spark

    @staticmethod
    def _physical(table: TableMeta, rows: DataFrame) -> DataFrame:
        return rows.select([F.col(name_sql(c.name)).cast(c.kind.spark).alias(c.physical) for c in table.columns])

    def _append(self, table: TableMeta, rows: DataFrame) -> None:
        out, keys = self._physical(table, rows), table.order
        (out.sortWithinPartitions(*keys) if keys else out).write.mode("append").parquet(table.path)
        table.rows = None
        table.appends += 1
        if table.appends >= MERGE_AFTER:
            self.rewrite(table, self.catalog.frame(table))

    def rewrite(self, table: TableMeta, rows: DataFrame) -> None:
        """Writes rows as the table's next version, in the order of its indexed columns, so that files and row groups are skipped by their statistics."""
        out, keys = self._physical(table, rows), table.order
        out = out.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else out  # small files are read several to a task, and so are merged
        out.write.mode("overwrite").parquet(f"{table.folder}/v{table.version + 1}")
        table.version += 1
        table.appends = 0
        table.ends = self.ends(table) if keys else {}
        self.catalog.save()

    def ends(self, table: TableMeta) -> dict:
        """Bounds of a laid-out table's first and last files by its leading column, each with the rows that are surely there up to it.

        Files are taken by their largest values upwards ("low") and by their least downwards ("high"), so the rows add up whether or not files overlap.
        """
        column = next(c for c in table.columns if c.physical == table.order[0])
        if column.kind.kind not in ORDERED:
            return {}
        key = F.col(column.physical)
        files = self.spark.read.schema(table.schema).parquet(table.path).groupBy("_metadata.file_path").agg(F.min(key).alias("least"), F.max(key).alias("most"), F.count(key).alias("n")).where("n > 0").persist()
        out: dict = {"column": column.physical}
        for end, bound, by in (("low", "most", F.asc("most")), ("high", "least", F.desc("least"))):
            out[end], rows = [], 0
            for value, n in files.orderBy(by).limit(END_FILES).select(F.col(bound).cast("string"), "n").collect():  # so many rows at most
                rows += n
                if len(value) > LONGEST_END:
                    break
                out[end].append([value, rows])
        files.unpersist()
        return out

    # -- INSERT

    def insert(self, name: str, columns: list[str] | None, rows: list[list]) -> int:
        table = self.catalog.database().own_table(name)
        listed = [table.column(c) for c in columns] if columns is not None else table.columns
        parsed, problem = [], None
        for row in rows:
            try:
                parsed.append(self._parsed(table, listed, row))
            except EngineError as e:  # rows before it stay
                problem = e
                break
        kept, violation = self._accepted(table, parsed)
        if kept:
            schema = T.StructType([T.StructField(c.name, c.kind.spark) for c in table.columns])
            self._append(table, self.spark.createDataFrame(kept, schema).coalesce(1))
        if violation or problem:
            raise violation or problem
        return len(kept)

    @staticmethod
    def _parsed(table: TableMeta, listed: list, row: list) -> tuple:
        if len(row) > len(listed):
            raise EngineError(f"a row has {len(row)} values for {len(listed)} columns")
        if len(row) < len(listed):
            raise EngineError(f"a row has only {len(row)} values for {len(listed)} columns")
        values = {}
        for c, node in zip(listed, row, strict=True):
            if isinstance(node, t.Null):
                values[c.name] = None
            else:
                text = node.text if isinstance(node, t.Number) else str(int(node.value)) if isinstance(node, t.Bool) else node.value
                values[c.name] = parse_literal(c.kind, text, c.name)
        return tuple(values.get(c.name) for c in table.columns)

    def _accepted(self, table: TableMeta, rows: list[tuple]) -> tuple[list[tuple], ConstraintViolation | None]:
        """The rows before the first that a constraint rejects, and its error."""
        guarded = [c for c in table.columns if c.not_null or c.unique or c.primary or c.references or c.check_text]
        if not rows or not guarded:
            return rows, None
        schema = T.StructType([T.StructField(_ROW, T.LongType()), *[T.StructField(c.name, c.kind.spark) for c in table.columns]])
        batch = self.spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)
        faults: list[DataFrame] = []

        def fault(found: DataFrame, order: int, message: str) -> None:
            faults.append(found.select(_ROW, F.lit(order).alias("order"), F.lit(message).alias("message")))

        for i, c in enumerate(table.columns):
            col = F.col(name_sql(c.name))
            if c.not_null:
                fault(batch.where(col.isNull()), 4 * i, f"column '{c.name}' must have a value (NOT NULL)")
            if c.unique or c.primary:
                message = f"a value is already there in column '{c.name}' (UNIQUE)"
                there = self.catalog.frame(table).select(col.alias("__v"))
                fault(batch.join(there, col == F.col("__v"), "left_semi"), 4 * i + 1, message)
                first = batch.where(col.isNotNull()).groupBy(col.alias("__v")).agg(F.min(_ROW).alias("__first"))
                fault(batch.join(first, (col == F.col("__v")) & (F.col(_ROW) > F.col("__first"))), 4 * i + 1, message)
            if c.references:
                message = f"column '{c.name}' refers to a value that '{c.references[0]}.{c.references[1]}' lacks (FOREIGN KEY)"
                parents = self.catalog.database().tables.get(c.references[0])
                mine = batch.where(col.isNotNull())
                if parents is None or all(p.name != c.references[1] for p in parents.columns):
                    fault(mine, 4 * i + 2, message)
                else:
                    orphans = mine.join(self.catalog.frame(parents).select(F.col(name_sql(c.references[1])).alias("__v")), col == F.col("__v"), "left_anti")
                    if parents is table:  # rows before it in the batch are parents as well
                        earlier = batch.select(F.col(_ROW).alias("__r"), F.col(name_sql(c.references[1])).alias("__v"))
                        orphans = orphans.join(earlier, (col == F.col("__v")) & (F.col("__r") < F.col(_ROW)), "left_anti")
                    fault(orphans, 4 * i + 2, message)
            if c.check_text:
                fault(batch.alias(table.name).where(f"NOT {check_sql(table, c.check_text)}"), 4 * i + 3, f"a row fails the condition of column '{c.name}' (CHECK)")
        worst = reduce(DataFrame.union, faults).orderBy(_ROW, "order").first()
        if worst is None:
            return rows, None
        return rows[: worst[_ROW]], ConstraintViolation(worst["message"])

    # -- DELETE

    def delete(self, name: str, where) -> int:
        database = self.catalog.database()
        table = database.own_table(name)
        frame = self.catalog.frame(table).alias(table.name)
        goes = F.coalesce(F.expr(condition_on(table, self.renderer, where)), F.lit(False)) if where is not None else F.lit(True)
        gone = frame.where(goes)
        for other in database.tables.values():
            for c in other.columns:
                if other is table or not c.references or c.references[0] != name or all(p.name != c.references[1] for p in table.columns):
                    continue
                children = self.catalog.frame(other).select(F.col(name_sql(c.name)).alias("__v"))
                if not gone.join(children, F.col(f"{name_sql(name)}.{name_sql(c.references[1])}") == F.col("__v"), "left_semi").isEmpty():
                    raise ConstraintViolation(f"'{other.name}.{c.name}' still refers to rows that would go from '{name}'")
        n = gone.count()
        if n:
            self.rewrite(table, frame.where(~goes))
            table.rows = None
        return n

    # -- IMPORT

    def import_csv(self, name: str, path: str) -> int:
        """Replaces the table; its constraints and indexes are lost."""
        frame, columns = read_csv(self.spark, path)
        return self.replace(name, frame, columns)

    def replace(self, name: str, frame: DataFrame, columns: list[tuple[str, LogicalType]]) -> int:
        database = self.catalog.database()
        made = TableMeta(name, [], f"{self.catalog.folder}/{database.name}/{name}-{uuid.uuid4().hex[:8]}")  # a folder of its own: another table may have had the name
        for column, kind in columns:
            made.add(column, kind)
        self._append(made, frame)
        made.rows = self.catalog.frame(made).count()
        database.tables[name] = made
        self.catalog.save()
        return made.rows
