import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from brindle.errors import ConstraintViolation, EngineError
from brindle.session import Engine


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_types_round_trip(engine):
    engine.sql("create type shade as enum ('light', 'dark')")
    engine.sql("create table x (a u32, b u64, c i32, d i64, e f32, f f64, g bool, h date, i timestamp, j decimal(6,2), k string8, l shade)")
    engine.sql("insert into x values (4294967295, 18446744073709551615, -5, -6, 1.5, 2.25, true, '2024-02-31', '2024-01-02 03:04:05', 2.345, 'it''s', 'dark'), (0, 0, 0, 0, 0, 0, false, '2024-01-01', '2024-01-01', -2.345, '', 'light')")
    engine.sql("insert into x (a) values (7)")
    got = rows(engine.sql("select * from x order by a"))
    assert got[2] == (4294967295, Decimal(18446744073709551615), -5, -6, 1.5, 2.25, True, dt.date(2024, 3, 2), dt.datetime(2024, 1, 2, 3, 4, 5), Decimal("2.35"), "it's", "dark")
    assert got[1][1:] == (None,) * 11
    assert rows(engine.sql("select a from x where j = -2.35 and g = false and h < '2024-02-01' and i >= '2024-01-01'")) == [(0,)]
    assert rows(engine.sql("select a from x where l > 'light'")) == [(4294967295,)]
    assert rows(engine.sql("select l from x where l is not null order by l desc")) == [("dark",), ("light",)]
    assert rows(engine.sql("select a from x where l = 'green' or h = 'soon'")) == []
    assert rows(engine.sql("select sum(b) as s from x"))[0][0] == 18446744073709551615


@pytest.mark.parametrize("values", ["(4294967296)", "(-1)", "('x')", "(1, 2)"])
def test_bad_values(engine, values):
    engine.sql("create table x (a u32)")
    with pytest.raises(EngineError):
        engine.sql(f"insert into x values {values}")


def test_constraints_stop_at_the_first_fault(engine):
    engine.sql("create table p (id u32 primary key, name string8 not null, n i32 check (n > 3 or n = 0))")
    with pytest.raises(ConstraintViolation, match="'id'.*UNIQUE"):
        engine.sql("insert into p values (1, 'a', 5), (2, 'b', 0), (1, 'c', 9), (3, 'd', 9)")
    assert rows(engine.sql("select id from p order by id")) == [(1,), (2,)]
    with pytest.raises(ConstraintViolation, match="UNIQUE"):
        engine.sql("insert into p values (2, 'z', 9)")
    with pytest.raises(ConstraintViolation, match="'name'.*NOT NULL"):
        engine.sql("insert into p values (4, null, 9)")
    with pytest.raises(ConstraintViolation, match="'n'.*CHECK"):
        engine.sql("insert into p values (4, 'd', 2)")
    with pytest.raises(ConstraintViolation, match="CHECK"):  # unknown is rejected
        engine.sql("insert into p (id, name) values (4, 'd')")


def test_foreign_keys(engine):
    engine.sql("create table p (id u32 unique); insert into p values (1), (2), (null), (null)")
    engine.sql("create table c (k u32, pid u32 references p(id)); insert into c values (1, 1), (2, null)")
    with pytest.raises(ConstraintViolation, match="FOREIGN KEY"):
        engine.sql("insert into c values (3, 9)")
    with pytest.raises(ConstraintViolation):
        engine.sql("delete from p where id < 9")
    engine.sql("delete from p where id = 2")
    assert rows(engine.sql("select count(*) from p")) == [(3,)]
    engine.sql("alter table p rename to parents")
    with pytest.raises(ConstraintViolation):
        engine.sql("delete from parents")


def test_check_on_strings(engine):
    engine.sql("create table s (a string8 check (a contains 'x'), b string8 check (b > 'm'))")
    engine.sql("insert into s values ('axa', 'm')")  # other comparisons of strings act as =
    with pytest.raises(ConstraintViolation):
        engine.sql("insert into s values ('axa', 'z')")


def test_delete_keeps_unknown(engine):
    engine.sql("create table t (a i32); insert into t values (1), (null), (3); delete from t where a > 1")
    assert sorted(rows(engine.sql("select a from t")), key=str) == [(1,), (None,)]
    engine.sql("delete from t")
    assert rows(engine.sql("select count(*) from t")) == [(0,)]


def test_alter_and_persistence(engine, spark):
    engine.sql("create table t (a i32, b string8); insert into t values (1, 'x'); create index i on t (a)")
    engine.sql("alter table t add column c f64; insert into t values (2, 'y', 0.5); alter table t drop column b; alter table t add column b i64")
    with pytest.raises(EngineError):
        engine.sql("alter table t add column B i64")
    engine.optimize("t")
    again = Engine(spark, engine.catalog.folder)
    again.sql("use d")
    assert rows(again.sql("select a, c, b from t order by a")) == [(1, None, None), (2, 0.5, None)]
    assert [tuple(r) for r in again.sql("describe t").collect()] == [("a", "i32", "YES", "", "indexed(i)"), ("c", "f64", "YES", "", ""), ("b", "i64", "YES", "", "")]
    again.sql("drop index i on t")
    with pytest.raises(EngineError):
        again.sql("drop index i on t")


def test_catalog_and_analyze(engine):
    engine.sql("create table t (a u32 primary key check (a > 0), b string8); insert into t values (1, 'x'), (2, null), (3, 'x')")
    before = engine.sql("select column_name, distinct_count from column_catalog where table_name = 't' order by ordinal")
    assert rows(before) == [("a", None), ("b", None)]
    assert rows(engine.sql("analyze t")) == [("t", 3, "a", 3, 0), ("t", 3, "b", 1, 1)]
    got = rows(engine.sql("select column_name, is_primary_key, has_check, check_text, row_count, distinct_count, null_count from column_catalog order by ordinal"))
    assert got == [("a", 1, 1, "a > 0", 3, 3, 0), ("b", 0, 0, "", 3, 1, 1)]


def test_databases(engine, spark):
    with pytest.raises(EngineError):
        engine.sql("create database d")
    with pytest.raises(EngineError):
        engine.sql("use other")
    with pytest.raises(EngineError):
        Engine(spark, engine.catalog.folder).sql("select a from t")
    with pytest.raises(EngineError):
        engine.sql("create table t (a nothing)")


def test_import_and_export(engine, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('id,big,price,wide,mixed,name,empty\n1,5000000000,1.5,0.1,1,"a, ""b""",\n2,3, 2.25 ,1.5,1.5,,\n')
    engine.sql(f"create table t (z i32 not null); import into t from '{path}'")
    kinds = [r.Type for r in engine.sql("describe t").collect()]
    assert kinds == ["u32", "u64", "f32", "f64", "string8", "string8", "string8"]
    got = rows(engine.sql("select * from t order by id"))
    assert got == [(1, Decimal(5000000000), 1.5, 0.1, "1", 'a, "b"', None), (2, Decimal(3), 2.25, 1.5, "1.5", None, None)]
    engine.export_csv("t", str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*.csv"))
    assert "id,big,price,wide,mixed,name,empty" in text and "1.500000" in text


def test_cells_that_the_sample_does_not_foretell(engine, tmp_path):
    lines = ["a,b,c"] + [f"{i},{i}.5,{i}" for i in range(300)] + ["x9,seven,6000000000"]
    (tmp_path / "long.csv").write_text("\n".join(lines) + "\n")
    engine.sql(f"import into t from '{tmp_path}/long.csv'")
    assert [r.Type for r in engine.sql("describe t").collect()] == ["string8", "string8", "u64"]
    assert rows(engine.sql("select a, b from t where c = 6000000000")) == [("x9", "seven")]
    assert rows(engine.sql("select count(a), count(b), count(c) from t")) == [(301, 301, 301)]


def test_import_after_rename_leaves_the_renamed_table_alone(engine, tmp_path):
    (tmp_path / "one.csv").write_text("k\n1\n2\n")
    (tmp_path / "two.csv").write_text("k\n30\n")
    engine.sql(f"import into a from '{tmp_path}/one.csv'; alter table a rename to b; import into a from '{tmp_path}/two.csv'")
    assert rows(engine.sql("select k from b order by k")) == [(1,), (2,)] and rows(engine.sql("select k from a")) == [(30,)]


def test_readers_of_former_versions_go_on(engine, tmp_path):
    engine.sql("create table t (a i32, b string8); insert into t values (1, 'x'), (2, 'y'), (3, 'z')")
    before = engine.sql("select a from t order by a")
    engine.sql("delete from t where a = 2")
    engine.sql("create index i on t (a)")
    after = engine.sql("select a from t order by a")
    (tmp_path / "n.csv").write_text("a\n7\n")
    engine.sql(f"import into t from '{tmp_path}/n.csv'")
    assert rows(before) == [(1,), (2,), (3,)] and rows(after) == [(1,), (3,)] and rows(engine.sql("select a from t")) == [(7,)]
    place = f"{engine.catalog.folder}/d"
    assert len(engine.catalog.files.folders(place)) == 2
    engine.sweep()
    assert len(engine.catalog.files.folders(place)) == 1 and rows(engine.sql("select a from t")) == [(7,)]


def test_an_index_lays_the_table_out(engine, spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that small tables have several files
    spark.range(40_000).selectExpr("id * 7919 % 40009 as a", "id as b").createOrReplaceTempView("numbers")
    engine.changes.replace("t", spark.table("numbers").repartition(4), [("a", engine.catalog.kind("i64", ())), ("b", engine.catalog.kind("i64", ()))])
    engine.sql("create index i on t (a)")
    engine.sql("insert into t values (50, 1), (3, 2), (40, 3)")
    engine.sql("delete from t where b = 0")

    def ranges():
        """Least and greatest value of the indexed column in each file, by order."""
        found = engine.catalog.database().table("t")
        files = spark.read.parquet(found.path).selectExpr("c1", "_metadata.file_path as f").groupBy("f").agg({"c1": "min"}).orderBy("min(c1)").collect()
        tops = {r.f: r["max(c1)"] for r in spark.read.parquet(found.path).selectExpr("c1", "_metadata.file_path as f").groupBy("f").agg({"c1": "max"}).collect()}
        return [(r["min(c1)"], tops[r.f]) for r in files]

    found = ranges()
    assert len(found) > 1 and all(a[1] <= b[0] for a, b in zip(found[:-1], found[1:]))  # a delete keeps the order
    plan = engine.sql("select b from t where a = 17")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(c1), EqualTo(c1,17)]" in plan
    assert rows(engine.sql("select count(*) from t")) == [(40_002,)]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("kind", ["i64", "u64", "string8", "date", "timestamp", "decimal", "f64"])
def test_first_rows_of_a_layout(engine, spark, kind):
    """ORDER BY the indexed column with a LIMIT reads the files at that end, and gives what a sort of all rows does."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    made = engine.catalog.kind(kind, (9, 2) if kind == "decimal" else ())
    number = "id * 7919 % 5003"
    value = {"string8": f"concat('it''s ', lpad({number}, 5, '0'))", "date": f"date_add(date '2001-01-01', cast({number} as int))", "timestamp": f"timestamp_seconds({number}) + interval 1 millisecond", "decimal": f"({number}) / 100"}.get(kind, number)
    frame = spark.range(5000).selectExpr(f"if(id % 100 = 7, null, cast({value} as {made.spark.simpleString()})) as a", "id as b").repartition(4)
    engine.changes.replace("t", frame, [("a", made), ("b", engine.catalog.kind("i64", ()))])
    engine.sql("create index i on t (a); insert into t values (null, -1), (null, -2); delete from t where b = 7 or b = 0; insert into t values (null, -3)")
    again = Engine(spark, engine.catalog.folder)
    again.sql("use d")
    whole = engine.sql("select a, b from t")
    for way in ("", " desc"):
        for limit, offset in ((60, 3), (0, 0), (1500, 0), (9000, 0)):
            text = f"select a as x, t.b from t order by x{way}, b limit {limit} offset {offset}"
            assert rows(again.sql(text)) == rows(whole.orderBy(F.desc("a") if way else F.asc("a"), "b").offset(offset).limit(limit)), (way, limit)
            assert (" WHERE " in again.spark_sql(text)) == (kind != "f64" and limit < 9000)
    plan = engine.sql("select b from t order by a desc limit 5")._jdf.queryExecution().toString()
    assert ("GreaterThanOrEqual(c1" in plan) == (kind != "f64")
    for other in ("select b from t order by b limit 3", "select b as a from t order by a limit 3", "select count(*) from t order by a limit 3", "select b, row_number() over (order by b) from t order by a limit 3", "select b from t where b > 3 order by a limit 3", "select b from t order by a"):
        try:
            assert "c1" not in engine.spark_sql(other) and "CAST(" not in engine.spark_sql(other), other
        except EngineError:
            pass  # not a statement of the dialect
    for e in (engine, again):
        e.sql("select a from t limit 0")  # the views that spark_sql leaves for its text go
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_appends_are_merged(engine, spark, monkeypatch):
    from brindle.operators import changes

    monkeypatch.setattr(changes, "MERGE_AFTER", 6)
    engine.sql("create table t (a i32)")
    for i in range(14):
        engine.sql(f"insert into t values ({i})")
    found = engine.catalog.database().table("t")
    assert rows(engine.sql("select a from t order by a")) == [(i,) for i in range(14)]
    assert len(spark.read.parquet(found.path).inputFiles()) < 10 and found.version == 2
