"""RANK and DENSE_RANK over few partitions, with marks so near that small tables have many, against Spark's own window."""

import random

import pytest
from pyspark.sql import functions as F

from brindle.plans import ranks
from brindle.session import Engine


@pytest.fixture
def near(monkeypatch):
    monkeypatch.setattr(ranks, "MARK_EVERY", 20)


@pytest.fixture(scope="module")
def frame(spark, tmp_path_factory):
    """As files: flags, a value with many peers, one of its own, and one of odd doubles; each with nulls."""
    path = f"file://{tmp_path_factory.mktemp('ranks')}/t"
    odd = "CASE id % 11 WHEN 0 THEN double('NaN') WHEN 1 THEN -0.0D WHEN 2 THEN 0.0D WHEN 3 THEN NULL WHEN 4 THEN double('-Infinity') ELSE double(id % 97) END"
    spark.range(3000).selectExpr("id", "IF(id % 7 = 0, NULL, concat('f', id % 3)) AS flag", "IF(id % 13 = 0, NULL, concat('w', id * 31 % 17)) AS word", "id * 7919 % 3001 AS own", f"{odd} AS odd", "timestamp_ntz'2024-01-01' + make_dt_interval(int(id % 29)) AS at").write.parquet(path)
    return spark.read.parquet(path)


OVERS = ["partition by flag order by word", "partition by flag order by own desc", "partition by flag order by odd", "order by odd desc", "order by word", "partition by flag order by word desc, own desc", "partition by flag, word order by at, odd", "partition by flag order by word, own desc", "partition by own order by word", "partition by flag order by flag, word"]


@pytest.mark.parametrize("over", OVERS)
def test_same_ranks_as_spark(spark, near, frame, over):
    got = Engine.over(spark, {"t": frame}).sql(f"select id, rank() over ({over}) as r, dense_rank() over ({over}) as d from t")
    want = frame.selectExpr("id", f"rank() over ({over}) as r", f"dense_rank() over ({over}) as d")
    assert got.schema.simpleString() == want.schema.simpleString()
    assert sorted(got.collect()) == sorted(want.collect())


def test_no_task_ranks_a_whole_partition(spark, near, frame):
    """A plain window without partitions has a single task with all rows."""
    put = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "2k", "spark.sql.files.openCostInBytes": "0"}
    was = {k: spark.conf.get(k) for k in put}
    for k, v in put.items():
        spark.conf.set(k, v)
    try:
        for order in ("own", "word"):  # each row's own, and of many peers
            got = Engine.over(spark, {"t": frame}).sql(f"select id, rank() over (order by {order}) as r, dense_rank() over (order by {order}) as d from t")
            tasks = got.select("*", F.spark_partition_id().alias("task")).where("r > 0 and d > 0").groupBy("task").count()
            rows = sorted(x["count"] for x in tasks.collect())
            assert sum(rows) == 3000 and rows[-1] < 1500, (order, rows)
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_rows_that_differ_from_run_to_run(spark, near):
    """The ranks are those of the rows that are returned."""
    drawn = F.udf(lambda _: random.randrange(10**6), "int").asNondeterministic()
    t = spark.range(2000).select("id", drawn("id").alias("v"))
    got = Engine.over(spark, {"t": t}).sql("select id, v, rank() over (order by v) as r from t").collect()
    values = sorted(x.v for x in got)
    first = {v: i + 1 for i, v in reversed(list(enumerate(values)))}
    assert len({x.id for x in got}) == 2000 and all(x.r == first[x.v] for x in got)


def test_around_rankings(spark, near, frame):
    """Groups, two rankings of different keys, other windows, ORDER BY of columns that aren't listed, a CTE and a join."""
    frame.createOrReplaceTempView("ranked_t")
    for text in (
        "select word, count(*) as n, rank() over (order by count(*) desc) as r from t group by word having count(*) > 5",
        "select id, rank() over (partition by flag order by word) as a, dense_rank() over (order by own desc) as b, count(*) over (partition by word) as c from t where id > 100",
        "select id, rank() over (partition by flag order by word) as a from t order by own desc limit 50 offset 3",
        "with x as (select id, word, rank() over (order by word) as r from t) select x.r, count(*) as n from x join t on x.id = t.id group by x.r",
        "select id, dense_rank() over (order by own) as r from t order by r desc limit 5",
    ):
        got = Engine.over(spark, {"t": frame}).sql(text).collect()
        assert sorted(map(repr, got)) == sorted(map(repr, spark.sql(text.replace("from t", "from ranked_t t").replace("join t", "join ranked_t t")).collect()))


def test_first_ranks_are_left_to_the_group_limit(spark, frame):
    got = Engine.over(spark, {"t": frame}).sql("select id from (select id, rank() over (partition by flag order by own) as r from t) as x where r <= 3")
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString() and got.count() == 12
