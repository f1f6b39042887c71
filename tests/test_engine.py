import pytest
from pyspark.errors import AnalysisException

from brindle.errors import EngineError
from brindle.session import Engine

PARCELS = [(101, "Oslo", 2.0), (102, "Bern", 3.5), (103, "Oslo", 0.5), (104, "Turin", 7.25), (105, None, 1.0), (106, "Bern", 3.5), (107, "Quito", 12.0), (108, "Oslo", 4.0)]
TOWNS = [("Oslo", "north"), ("Bern", "west"), ("Lima", "south"), (None, "none")]


@pytest.fixture(scope="module")
def post(spark):
    return Engine.over(spark, {"parcels": spark.createDataFrame(PARCELS, "code long, town string, kg double"), "towns": spark.createDataFrame(TOWNS, "name string, side string")})


def rows(df):
    return [tuple(r) for r in df.collect()]


GOLDEN = [
    ("with heavy as (select code, kg from parcels where kg >= 4) select code from heavy where kg < 10 order by code", [(104,), (108,)]),
    ("with s as (select town, sum(kg) as total from parcels group by town), u as (select town from s where total > 6.5) select count(*) from u", [(3,)]),
    ("select max(kg) as m from (select kg from parcels order by kg limit 3) as light", [(2.0,)]),
    ("select code from parcels where town not in (select name from towns) order by code", []),  # the list has a null
    ("select code from parcels where town not in (select name from towns where name is not null) order by code", [(104,), (107,)]),
    ("select count(*) from parcels where town not in (select name from towns where side = 'east')", [(8,)]),  # an empty list: nulls stay
    ("select code from parcels where code < 103 or town not in (select name from towns where side != 'none') order by code", [(101,), (102,), (104,), (107,)]),
    ("select name from towns where name in (select town from parcels where kg > 3.5)", [("Oslo",)]),
    ("select code from parcels where kg > (select avg(kg) from parcels) order by code", [(104,), (107,)]),
    ("select count(*) from parcels where exists (select name from towns where side = 'south')", [(8,)]),
    ("select town from parcels where code in (101, 107, 555) order by town", [("Oslo",), ("Quito",)]),
    ("select code, row_number() over (partition by town order by kg desc) as r from parcels where town equals 'Oslo' order by code", [(101, 2), (103, 3), (108, 1)]),
    ("select code, sum(kg) over (order by kg) as upto from parcels where kg < 4 order by code", [(101, 3.5), (102, 10.5), (103, 0.5), (105, 1.5), (106, 10.5)]),
    ("select town, code from (select town, code, rank() over (partition by town order by kg desc) as r from parcels) as x where r = 1 and town is not null order by code", [("Bern", 102), ("Turin", 104), ("Bern", 106), ("Quito", 107), ("Oslo", 108)]),
    ("select count(*) from towns; select min(code) from parcels", [(101,)]),
    ("select count(*) from parcels where town contains ''", [(7,)]),
    ("select code from parcels where town > 'Oslo' order by code desc", [(107,), (104,)]),
    ("select parcels.code, towns.side from parcels left join towns on town = name and side != 'west' where code < 104 order by code", [(101, "north"), (102, None), (103, "north")]),
    ("select * from towns, parcels where name = town and kg > 3 order by code", [("Bern", "west"), ("Bern", "west"), ("Oslo", "north")]),
    ("select count(*), count(town), min(town) from parcels", [(8, 7, "Bern")]),
    ("select sum(kg) as s from parcels having sum(kg) > 100", []),
    ("select lag(kg, 1, 0) over (order by code) as earlier from parcels order by code limit 2", [(0.0,), (2.0,)]),
    ("select avg(s) as a from (select town, sum(kg) as s from parcels where town is not null group by town) as t", [(8.1875,)]),
    ("select town, sum(kg) as s, rank() over (order by sum(kg) desc) as r from parcels group by town order by r limit 2", [("Quito", 12.0, 1), ("Turin", 7.25, 2)]),
    ("select code from parcels where similarity(town, 'Osloo') > 0.6 order by code", [(101,), (103,), (108,)]),
    ("select edit_distance(town, 'Berne') as d from parcels order by edit_distance(town, 'Berne') desc, code limit 1 offset 4", [(4,)]),
]


@pytest.mark.parametrize(("text", "want"), GOLDEN)
def test_golden(post, text, want):
    assert rows(post.sql(text)) == want


def test_parameters(post):
    assert rows(post.sql("select code from parcels where kg > $1 and town != $2 order by code", [3.5, "Turin"])) == [(107,), (108,)]


@pytest.mark.parametrize(
    "text",
    [
        "select weight from parcels",
        "select code from letters",
        "select code from parcels join parcels on parcels.code = parcels.code",
        "select x from (select code as x, kg as x from parcels) d",
        "select upper(town) from parcels",
        "select rank() from parcels",
        "select code from parcels where code = (select code, kg from parcels)",
        "select code from parcels where code not in (select code, kg from parcels)",
        "select code from parcels having code > 103",
    ],
)
def test_refused(post, text):
    with pytest.raises(EngineError):
        post.sql(text)


def test_scalar_subquery_with_rows(post):
    with pytest.raises(Exception, match="SCALAR_SUBQUERY_TOO_MANY_ROWS"):
        post.sql("select code from parcels where town = (select name from towns)").collect()
    assert rows(post.sql("select code from parcels where town = (select name from towns where side = 'east')")) == []


def test_names_keep_case_and_first_table_wins(spark):
    a = spark.createDataFrame([(1, "low")], "k long, x string")
    b = spark.createDataFrame([(1, "high", "B")], "k long, x string, X string")
    e = Engine.over(spark, {"a": a, "b": b})
    assert rows(e.sql("select x from a join b on a.k = b.k")) == [("low",)]
    assert rows(e.sql("select X from a join b on a.k = b.k")) == [("B",)]
    assert spark.conf.get("spark.sql.caseSensitive") == "false"


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_plan_shapes(post):
    assert "TakeOrderedAndProject" in plan_of(post.sql("select code from parcels order by kg desc limit 3"))
    assert "LeftSemi" in plan_of(post.sql("select code from parcels where exists (select name from towns where name = town)"))
    assert "WindowGroupLimit" in plan_of(post.sql("select code from (select code, row_number() over (partition by town order by kg) as r from parcels) as x where r <= 2"))


def test_not_in_is_never_a_broadcast_of_the_list(post, spark):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(post.sql("select code from parcels where town not in (select name from towns)"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "LeftAnti" in plan and "Broadcast" not in plan


def test_no_views_are_left(post, spark):
    df = post.sql("select count(*) as n from parcels join towns on town = name")
    assert not [x.name for x in spark.catalog.listTables() if x.name.startswith("brindle_")] and df.first().n == 5


def test_explain(post):
    assert "Plan" in post.sql("explain select code from parcels where kg > 3").first()[0]
    ran = post.sql("explain analyze select town, count(*) as n from parcels where kg > 3 group by town").collect()
    assert ran[0].rows == 4 and ran[0].millis > 0
    told = [r for r in ran if r.q_error is not None]
    assert told and all(r.q_error >= 1 and r.estimate >= 0 for r in told)
    assert any(r.millis is not None for r in ran[1:])


def test_unknown_spark_errors_are_not_hidden(post):
    with pytest.raises((EngineError, AnalysisException)):
        post.sql("select sum(town, code) from parcels")
