import pytest

from brindle.errors import EngineError
from brindle.streaming import ingest


def test_ingest(engine, spark, tmp_path):
    source = tmp_path / "in"
    spark.range(5).selectExpr("id", "cast(id as string) as name").write.parquet(str(source))
    engine.sql("create table t (id i64, name string8)")
    stream = spark.readStream.schema("id long, name string").parquet(str(source))
    for _ in range(2):  # a restart reads nothing twice
        ingest(engine, "t", stream, str(tmp_path / "at")).awaitTermination(60)
        assert engine.sql("select count(*) as n, max(name) as m from t").first() == (5, "4")
    spark.range(5, 7).selectExpr("id", "cast(id as string) as name").write.mode("append").parquet(str(source))
    ingest(engine, "t", stream, str(tmp_path / "at")).awaitTermination(60)
    engine.sql("insert into t values (9, 'x')")
    assert engine.sql("select count(*) as n from t").first() == (8,)


def test_two_streams_and_a_delete(engine, spark, tmp_path):
    for name, low in (("one", 0), ("two", 100)):
        spark.range(low, low + 5).write.parquet(str(tmp_path / name))
    engine.sql("create table t (id i64)")
    streams = {name: spark.readStream.schema("id long").parquet(str(tmp_path / name)) for name in ("one", "two")}
    for name in ("one", "two"):
        ingest(engine, "t", streams[name], str(tmp_path / f"at-{name}")).awaitTermination(60)
    assert engine.sql("select count(*) as n from t").first() == (10,)
    engine.sql("delete from t where id = 3")
    ingest(engine, "t", streams["one"], str(tmp_path / "at-one")).awaitTermination(60)
    ingest(engine, "t", streams["one"], str(tmp_path / "at-again")).awaitTermination(60)  # a new checkpoint is another stream
    assert engine.sql("select count(*) as n from t").first() == (14,)
    assert sorted(engine.catalog.database().table("t").streams.values()) == [0, 0, 0]


def test_constrained_tables_are_refused(engine, spark, tmp_path):
    engine.sql("create table t (id i64 not null)")
    with pytest.raises(EngineError):
        ingest(engine, "t", spark.range(1), str(tmp_path))
