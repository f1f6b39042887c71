"""Registered queries: dialect text over the driver's tables, with the SQL that must give the same rows.

Each entry is (dialect, oracle); an oracle of None is the dialect's own text, which is then plain SQL.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from brindle.errors import ConstraintViolation
from brindle.session import Engine

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

FLAGSHIP = (
    "SELECT n.n_name, COUNT(*) AS n, SUM(l.l_extendedprice) AS revenue FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey "
    "JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE l.l_quantity > 10 GROUP BY n.n_name HAVING COUNT(*) > 5 ORDER BY revenue DESC, n.n_name LIMIT 10"
)

#: Columns that sum doubles; both sides round them, as the order of summing differs.
ROUNDED = ("revenue", "total", "s", "a", "m", "pa", "running", "p", "med")

QUERIES: dict[str, tuple[str, str | None]] = {
    "revenue_by_nation": (FLAGSHIP, None),
    # scans and projection
    "scan_star": ("SELECT * FROM nation", None),
    "star_first_table": ("SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'", "SELECT nation.* FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'"),
    "project_alias": ("SELECT sup.s_name AS supplier_name, s_acctbal AS balance FROM supplier AS sup", None),
    "point_lookup": ("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 777", None),
    "wide_filter": ("SELECT * FROM lineitem WHERE l_quantity >= 50 AND l_discount <= 0.01", None),
    # predicates
    "filter_three_predicates": ("SELECT l_orderkey, l_partkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 20 AND l_discount < 0.05", None),
    "filter_or_group": ("SELECT o_orderkey, o_totalprice FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 100000) OR (o_orderstatus = 'O' AND o_totalprice < 5000)", None),
    "filter_string_cmp": ("SELECT p_partkey, p_name FROM part WHERE p_name >= 'm' AND p_name < 't' AND p_brand != 'Brand#11'", None),
    "filter_contains": ("SELECT p_partkey, p_name FROM part WHERE p_name contains 'ring'", "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'ring')"),
    "filter_equals": ("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment equals 'BUILDING'", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "filter_double_equals": ("SELECT c_custkey FROM customer WHERE c_nationkey == 7", "SELECT c_custkey FROM customer WHERE c_nationkey = 7"),
    "filter_in_list": ("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')", None),
    "filter_not_in_list": ("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey NOT IN (1, 3)", None),
    "filter_is_null": ("SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_orderkey IS NULL", None),
    "filter_is_null_some": ("SELECT c.c_custkey, c.c_name FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 400000 WHERE o.o_orderkey IS NULL", None),
    "filter_is_not_null": ("SELECT COUNT(*) AS n FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_orderkey IS NOT NULL", None),
    "null_comparison": ("SELECT COUNT(*) AS n FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_orderstatus != 'F'", None),
    "filter_date": ("SELECT o_orderkey FROM orders WHERE o_orderdate >= '1995-03-15' AND o_orderdate < '1995-06-15 12:00:00'", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-03-15' AND o_orderdate < TIMESTAMP '1995-06-15 12:00:00'"),
    "filter_bad_date": ("SELECT o_orderkey FROM orders WHERE o_orderdate >= 'soon'", "SELECT o_orderkey FROM orders WHERE false"),
    "constant_false": ("SELECT o_orderkey FROM orders WHERE 1 = 0", None),
    "column_to_column": ("SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_partkey = l_suppkey", None),
    # joins
    "join_inner": ("SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal > 5000", None),
    "join_left": ("SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT OUTER JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 150000", None),
    "join_comma": ("SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey AND r_name != 'AFRICA'", None),
    "join_two_keys": ("SELECT COUNT(*) AS n FROM customer c JOIN supplier s ON c.c_nationkey = s.s_nationkey AND c.c_custkey = s.s_suppkey", None),
    "join_residual": ("SELECT COUNT(*) AS n FROM customer c JOIN supplier s ON c.c_nationkey = s.s_nationkey AND c.c_acctbal > s.s_acctbal", None),
    "join_string_key": ("SELECT a.n_nationkey FROM nation a JOIN nation b ON a.n_name = b.n_name WHERE b.n_regionkey = 2", None),
    "join_three_way": ("SELECT c.c_mktsegment, n.n_name, COUNT(*) AS n, SUM(o.o_totalprice) AS total FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY c.c_mktsegment, n.n_name", None),
    "join_self_cte": ("WITH big AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) SELECT a.o_custkey, b.n FROM big a JOIN big b ON a.o_custkey = b.o_custkey WHERE a.n > 12", None),
    "join_agg_by_dimension": ("SELECT p_brand, COUNT(*) AS n, SUM(l_quantity) AS total FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand", None),
    # semi and anti joins, subqueries
    "semi_exists": ("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey)", None),
    "anti_not_exists": ("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey)", None),
    "anti_not_exists_some": ("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)", None),
    "not_in_with_null": ("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o.o_custkey FROM nation n LEFT JOIN orders o ON n.n_nationkey = o.o_orderkey AND o.o_orderkey < 9)", None),
    "not_in_empty": ("SELECT n_name FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_name = 'ATLANTIS')", None),
    "not_in_strings": ("SELECT c_mktsegment, COUNT(*) AS n FROM customer WHERE c_mktsegment NOT IN (SELECT c_mktsegment FROM customer WHERE c_custkey = 1) GROUP BY c_mktsegment", None),
    "exists_constant": ("SELECT r_name FROM region WHERE EXISTS (SELECT n_name FROM nation WHERE n_nationkey = 3) AND r_regionkey < 3", None),
    "in_subquery": ("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)", None),
    "not_in_subquery": ("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)", None),
    "scalar_subquery": ("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM orders)", None),
    "scalar_subquery_left": ("SELECT s_suppkey FROM supplier WHERE (SELECT AVG(s_acctbal) FROM supplier) < s_acctbal", None),
    "nested_subqueries": ("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM orders))", None),
    # aggregation
    "agg_global": ("SELECT COUNT(*) AS n, SUM(l_quantity) AS s, AVG(l_extendedprice) AS a, MIN(l_shipdate) AS lo, MAX(l_shipdate) AS hi FROM lineitem", None),
    "agg_sum_int": ("SELECT l_returnflag, SUM(l_partkey) AS total, MIN(l_linenumber) AS lo, MAX(l_linenumber) AS hi FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, CAST(SUM(l_partkey) AS BIGINT) AS total, MIN(l_linenumber) AS lo, MAX(l_linenumber) AS hi FROM lineitem GROUP BY l_returnflag"),
    "agg_two_keys": ("SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_extendedprice) AS s, AVG(l_discount) AS a FROM lineitem GROUP BY l_returnflag, l_linestatus", None),
    "agg_dense_key": ("SELECT l_linenumber, COUNT(*) AS n, SUM(l_quantity) AS s FROM lineitem GROUP BY l_linenumber", None),
    "agg_high_cardinality": ("SELECT l_partkey, COUNT(*) AS n, SUM(l_quantity) AS s FROM lineitem GROUP BY l_partkey", None),
    "agg_min_max_text": ("SELECT c_mktsegment, MIN(c_name) AS lo, MAX(c_name) AS hi FROM customer GROUP BY c_mktsegment", None),
    "agg_many": ("SELECT o_orderstatus, COUNT(*) AS n1, COUNT(o_custkey) AS n2, MIN(o_orderkey) AS n3, MAX(o_orderkey) AS n4, MIN(o_custkey) AS n5, MAX(o_custkey) AS n6, MIN(o_orderdate) AS n7, MAX(o_orderdate) AS n8, MIN(o_totalprice) AS n9, MAX(o_totalprice) AS n10, MIN(o_orderpriority) AS n11, MAX(o_orderpriority) AS n12 FROM orders GROUP BY o_orderstatus", None),
    "agg_nested": ("SELECT o_orderstatus, MAX(n) AS most, MIN(n) AS least, COUNT(*) AS customers FROM (SELECT o_orderstatus, o_custkey, COUNT(*) AS n FROM orders GROUP BY o_orderstatus, o_custkey) AS t GROUP BY o_orderstatus", None),
    "distinct_via_group": ("SELECT COUNT(*) AS n FROM (SELECT user_id FROM events GROUP BY user_id) AS t", None),
    "null_group": ("SELECT o.o_orderstatus, COUNT(*) AS n, COUNT(o.o_orderkey) AS k FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY o.o_orderstatus", None),
    "bare_column": ("SELECT n_regionkey, r_name, COUNT(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY n_regionkey", "SELECT n_regionkey, any_value(r_name) AS r_name, COUNT(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY n_regionkey"),
    "having": ("SELECT l_suppkey, COUNT(*) AS n FROM lineitem GROUP BY l_suppkey HAVING COUNT(*) > 10 AND SUM(l_quantity) > 200", None),
    "having_scalar_subquery": ("SELECT o_custkey, SUM(o_totalprice) AS total FROM orders GROUP BY o_custkey HAVING SUM(o_totalprice) > (SELECT MAX(o_totalprice) FROM orders)", None),
    "having_in": ("SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus HAVING o_orderstatus IN ('F', 'O')", None),
    # sorting and limits
    "topn": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", None),
    "topn_over_groups": ("SELECT o_custkey, SUM(o_totalprice) AS total FROM orders GROUP BY o_custkey ORDER BY total DESC, o_custkey LIMIT 20", None),
    "limit_offset": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 30", None),
    "offset_alone": ("SELECT n_nationkey FROM nation ORDER BY n_nationkey OFFSET 20", None),
    "order_nulls": ("SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey ORDER BY o.o_orderkey, c.c_custkey LIMIT 40", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey ORDER BY o.o_orderkey NULLS FIRST, c.c_custkey LIMIT 40"),
    "sort_by_unselected": ("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 30", None),
    "sort_rows": ("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_returnflag = 'A' ORDER BY l_extendedprice, l_orderkey, l_linenumber", None),
    # windows
    "win_row_number": ("SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders", "SELECT o_orderkey, CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rn FROM orders"),
    "win_row_number_unordered": ("SELECT n_regionkey, MAX(rn) AS m FROM (SELECT n_regionkey, ROW_NUMBER() OVER (PARTITION BY n_regionkey) AS rn FROM nation) AS t GROUP BY n_regionkey", "SELECT n_regionkey, CAST(COUNT(*) AS INTEGER) AS m FROM nation GROUP BY n_regionkey"),
    "win_rank_dense": ("SELECT l_orderkey, l_linenumber, RANK() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS r, DENSE_RANK() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS d FROM lineitem", "SELECT l_orderkey, l_linenumber, CAST(RANK() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS INTEGER) AS r, CAST(DENSE_RANK() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS INTEGER) AS d FROM lineitem"),
    "win_over_groups": ("SELECT o_custkey, COUNT(*) AS n, RANK() OVER (ORDER BY COUNT(*) DESC) AS r FROM orders GROUP BY o_custkey", "SELECT o_custkey, COUNT(*) AS n, CAST(RANK() OVER (ORDER BY COUNT(*) DESC) AS INTEGER) AS r FROM orders GROUP BY o_custkey"),
    "win_lag_lead": ("SELECT o_orderkey, LAG(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before, LEAD(o_orderkey, 2, 0) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS after FROM orders", None),
    "win_running_sum_peers": ("SELECT o_orderkey, SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS running FROM orders", None),
    "win_partition_agg": ("SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey) AS n, MIN(o_totalprice) OVER (PARTITION BY o_custkey) AS lo, MAX(o_totalprice) OVER (PARTITION BY o_custkey) AS hi, AVG(o_totalprice) OVER (PARTITION BY o_custkey) AS pa FROM orders", None),
    "win_topk_per_group": ("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) AS t WHERE rn <= 3", None),
    "win_nulls": ("SELECT c.c_custkey, o.o_orderkey, DENSE_RANK() OVER (PARTITION BY c.c_nationkey ORDER BY o.o_orderkey) AS d FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey", "SELECT c.c_custkey, o.o_orderkey, CAST(DENSE_RANK() OVER (PARTITION BY c.c_nationkey ORDER BY o.o_orderkey NULLS FIRST) AS INTEGER) AS d FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey"),
    # composition
    "cte_chain": ("WITH a AS (SELECT o_custkey, SUM(o_totalprice) AS s FROM orders GROUP BY o_custkey), b AS (SELECT o_custkey, s FROM a WHERE s > 500000) SELECT COUNT(*) AS n, MAX(s) AS m FROM b", None),
    "derived_nested": ("SELECT id FROM (SELECT id FROM (SELECT l_orderkey AS id, l_quantity AS q FROM lineitem WHERE l_quantity > 40) a WHERE q < 45) b WHERE id < 2000", None),
    "derived_limited": ("SELECT o_orderkey FROM (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50) AS d ORDER BY o_orderkey", None),
    "derived_in_join": ("SELECT c.c_custkey, o.n FROM customer c JOIN (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) o ON c.c_custkey = o.o_custkey", None),
    # fuzzy text
    "edit_distance": ("SELECT p_partkey, EDIT_DISTANCE(p_name, 'small ring') AS d FROM part", "SELECT p_partkey, CAST(levenshtein(p_name, 'small ring') AS INTEGER) AS d FROM part"),
    "edit_distance_filter": ("SELECT c_custkey FROM customer WHERE EDIT_DISTANCE(c_mktsegment, 'BUILDINGS') <= 2", "SELECT c_custkey FROM customer WHERE levenshtein(c_mktsegment, 'BUILDINGS') <= 2"),
}

SIMILARITY = """
WITH n AS (SELECT g, count(*) AS k FROM (SELECT substr('small ring', i, 3) AS g FROM range(1, 9) t(i)) GROUP BY g),
     h AS (SELECT p_partkey, g, count(*) AS k FROM (SELECT p_partkey, substr(p_name, i, 3) AS g FROM part, range(1, 200) t(i) WHERE i <= length(p_name) - 2) GROUP BY p_partkey, g),
     m AS (SELECT p_partkey, sum(least(h.k, n.k)) AS shared FROM h JOIN n USING (g) GROUP BY p_partkey),
     s AS (SELECT p_partkey, p_name, CASE WHEN length(p_name) < 3 THEN 0.0 ELSE coalesce(shared, 0)::DOUBLE / (length(p_name) - 2 + 8 - coalesce(shared, 0)) END AS s FROM part LEFT JOIN m USING (p_partkey))
"""
QUERIES |= {
    "similarity": ("SELECT p_partkey, SIMILARITY(p_name, 'small ring') AS s FROM part", f"{SIMILARITY} SELECT p_partkey, s FROM s"),
    "similarity_filter": ("SELECT p_partkey FROM part WHERE SIMILARITY(p_name, 'small ring') > 0.3", f"{SIMILARITY} SELECT p_partkey FROM s WHERE s > 0.3"),
    "similarity_topk": ("SELECT p_partkey, p_name FROM part ORDER BY SIMILARITY(p_name, 'small ring') DESC, p_partkey LIMIT 10", f"{SIMILARITY} SELECT p_partkey, p_name FROM s ORDER BY s DESC, p_partkey LIMIT 10"),
}


_schemas: dict[tuple[str, str], StructType] = {}


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table; its schema is read from the files once for each session and path."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _schemas:
        _schemas[key] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[key]).parquet(path)


def engine_over(spark: SparkSession, sf_dir: str, text: str) -> Engine:
    """An engine with those of the driver's tables attached that the text names."""
    named = [n for n in TABLES if re.search(rf"\b{n}\b", text)]
    return Engine.over(spark, {n: read_table(spark, f"{sf_dir}/{n}.parquet") for n in named})


def run(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    out = engine_over(spark, sf_dir, text).sql(text)
    doubles = [n for n, k in out.dtypes if n in ROUNDED and k == "double"]
    return out.withColumns({n: F.round(n, 2) for n in doubles}) if doubles else out


def approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the sketch is within three standard errors of the exact count, for every return flag."""
    e = engine_over(spark, sf_dir, "lineitem")
    return e.sql(
        "SELECT l_returnflag, APPROX_COUNT_DISTINCT(l_partkey) AS estimate FROM lineitem GROUP BY l_returnflag"
    ).join(e.sql("SELECT l_returnflag, COUNT(*) AS exact FROM (SELECT l_returnflag, l_partkey FROM lineitem GROUP BY l_returnflag, l_partkey) AS d GROUP BY l_returnflag"), "l_returnflag").select(
        "l_returnflag", (F.abs(F.col("estimate") - F.col("exact")) <= 3 * 1.04 / 32 * F.col("exact")).alias("within")
    )


def approx_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the approximate median is within 5% of the exact one, for every return flag."""
    e = engine_over(spark, sf_dir, "lineitem")
    got = e.sql("SELECT l_returnflag, APPROX_PERCENTILE(l_extendedprice, 0.5) AS p FROM lineitem GROUP BY l_returnflag")
    exact = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").agg(F.percentile("l_extendedprice", 0.5).alias("x"))
    return got.join(exact, "l_returnflag").select("l_returnflag", (F.abs(F.col("p") - F.col("x")) <= 0.05 * F.col("x")).alias("within"))


def column_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine_over(spark, sf_dir, "nation region").sql("SELECT table_name, column_name, ordinal, nullable FROM column_catalog")


def column_catalog_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All its columns, once ANALYZE has counted."""
    e = own_engine(spark)
    e.sql("create table p (id u32 primary key, name string8 not null check (name != 'zed')); create table c (k i64 unique, p u32 references p(id), x decimal(6,2)); create index by_p on c (p)")
    e.sql("insert into p values (1, 'a'), (2, 'b'), (3, 'b'); insert into c values (10, 1, 0.5), (11, null, null), (12, 1, 0.5); analyze")
    return e.sql("select * from column_catalog")


def describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine_over(spark, sf_dir, "lineitem").sql("DESCRIBE lineitem")


def describe_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = own_engine(spark)
    e.sql("create type hue as enum ('red', 'blue'); create table p (id u32 primary key, h hue, t timestamp); create table c (k u64 unique not null, p u32 references p(id), x decimal(6,2) check (x > 1)); create index by_x on c (x)")
    return e.sql("describe p").union(e.sql("describe c"))


def analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine_over(spark, sf_dir, "nation").sql("ANALYZE nation")


def explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which parts the plan of the flagship query has: its scans, joins, groups, limit, and the sizes that are expected."""
    plan = engine_over(spark, sf_dir, FLAGSHIP).sql(f"EXPLAIN {FLAGSHIP}")
    parts = F.array(*[F.struct(F.lit(x).alias("part"), F.contains("plan", F.lit(x)).alias("there")) for x in ("FileScan", "Join", "HashAggregate", "TakeOrderedAndProject", "sizeInBytes", "CartesianProduct")])
    return plan.select(F.inline(parts))


def explain_analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the whole query and its join gave, as EXPLAIN ANALYZE tells them, and any estimate or time that can't be."""
    ran = engine_over(spark, sf_dir, "nation region").sql("EXPLAIN ANALYZE SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey < 2")
    whole = ran.where("depth = 0").select(F.lit("whole").alias("what"), "rows")
    return whole.union(ran.where("trim(plan) LIKE '%Join %'").select(F.lit("join"), "rows")).union(ran.where("q_error < 1 OR millis < 0").select(F.lit("wrong"), "rows"))


def own_engine(spark: SparkSession) -> Engine:
    """An engine with a new database of its own in the warehouse."""
    out = Engine(spark, f"{spark.conf.get('spark.sql.warehouse.dir')}/brindle-queries/{uuid.uuid4().hex[:10]}")
    out.sql("create database q")
    return out


def import_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers written as CSV and imported again, types being inferred."""
    e = own_engine(spark)
    path = f"{e.catalog.folder}/customers"
    engine_over(spark, sf_dir, "customer").export_csv("customer", path)
    return e.sql(f"import into c from '{path}'; select c_custkey, c_name, c_acctbal, c_mktsegment from c where c_nationkey < 5").withColumn("c_acctbal", F.round(F.col("c_acctbal").cast("double"), 2))


def refused(e: Engine, text: str) -> None:
    """Runs a batch that a constraint stops."""
    try:
        e.sql(text)
    except ConstraintViolation:
        return
    raise AssertionError("no constraint was violated")


def insert_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = own_engine(spark)
    e.sql("create table p (id u32 primary key, name string8 not null, n i32 check (n > 3)); create table c (id u32, p u32 references p(id)); insert into p values (1, 'a', 4), (2, 'b', 5)")
    refused(e, "insert into p values (3, 'c', 9), (1, 'd', 9), (4, 'e', 9)")
    refused(e, "insert into p values (5, null, 9)")
    refused(e, "insert into p (id, name) values (6, 'f')")
    refused(e, "insert into c values (1, 2), (2, null), (3, 77)")
    return e.sql("select p.id, p.name, c.id as child from p left join c on p.id = c.p")


def delete_restrict(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = own_engine(spark)
    e.sql("create table p (id u32 unique, v i32); create table c (p u32 references p(id)); insert into p values (1, 10), (2, 20), (3, null), (4, 40); insert into c values (2), (null)")
    refused(e, "delete from p where v > 15")
    e.sql("delete from p where v > 25")
    return e.sql("select id, v from p")


def typed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = own_engine(spark)
    e.sql("create type size as enum ('small', 'middle', 'large'); create table t (s size, d date, x decimal(6,2), b bool); insert into t values ('large', '2024-02-31', 2.345, true), ('small', '2024-01-01', -2.345, false), ('middle', '2023-12-31', 0.5, true)")
    return e.sql("select s, d, x from t where s > 'small' and d >= '2023-12-31' and x != 99.5 and b = true order by s desc").select("s", F.col("d").cast("string").alias("d"), F.col("x").cast("double").alias("x"))


def altered_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = own_engine(spark)
    e.sql("create table t (a i32, b string8); insert into t values (1, 'x'); create index i on t (a); alter table t add column c i64; insert into t values (2, 'y', 5); alter table t drop column b; alter table t rename to u")
    return e.sql("select a, c from u")


def import_after_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that was renamed stays what it was when its former name is imported into."""
    e = own_engine(spark)
    for name in ("nation", "region"):
        engine_over(spark, sf_dir, name).export_csv(name, f"{e.catalog.folder}/{name}")
    e.sql(f"import into a from '{e.catalog.folder}/nation'; alter table a rename to b; import into a from '{e.catalog.folder}/region'")
    return e.sql("select n_name as name from b").union(e.sql("select r_name as name from a"))


def delete_with_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query made before a DELETE and a new layout still has the rows of its time."""
    e = own_engine(spark)
    e.sql("create table t (a i32, b string8); insert into t values (1, 'x'), (2, 'y'), (3, 'z')")
    before = e.sql("select a from t")
    e.sql("delete from t where a = 2; create index i on t (a)")
    return before.select("a", F.lit("before").alias("moment")).union(e.sql("select a from t").select("a", F.lit("after").alias("moment")))


def reloaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two databases, used in turn, and read again by another engine from their files; an index comes and goes."""
    e = own_engine(spark)
    e.sql("create table t (a i32); insert into t values (1), (2); create database r; create table t (a i32, b string8); insert into t values (7, 'other'); use q; create index i on t (a); insert into t values (3); drop index i on t; create index i on t (a)")
    again = Engine(spark, e.catalog.folder)
    again.sql("use r; insert into t values (8, null)")
    other = again.sql("select a, b from t")
    again.sql("use q")
    return again.sql("select a from t").select("a", F.lit(None).cast("string").alias("b")).union(other)


def csv_beyond_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells far down that the sampled lines don't foretell are kept: the column is text."""
    e = own_engine(spark)
    path = f"{e.catalog.folder}/mixed"
    orders = engine_over(spark, sf_dir, "orders").sql("select o_orderkey from orders order by o_orderkey")
    orders.coalesce(1).selectExpr("o_orderkey AS k", "if(o_orderkey > 900, concat('n', o_orderkey), cast(o_orderkey as string)) AS v").write.csv(path, header=True)
    return e.sql(f"import into c from '{path}'; select k, v from c").withColumn("k", F.col("k").cast("long"))


def indexed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of an indexed column in a table of one's own."""
    e = own_engine(spark)
    kind = e.catalog.kind("i64", ())
    e.changes.replace("t", engine_over(spark, sf_dir, "orders").sql("select o_orderkey, o_custkey from orders"), [("o_orderkey", kind), ("o_custkey", kind)])
    return e.sql("create index i on t (o_custkey); select o_orderkey, o_custkey from t where o_custkey >= 30 and o_custkey < 34")


def ordered_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last rows of a table by its indexed column: the scan is kept to the files at that end."""
    e = own_engine(spark)
    columns = [("l_partkey", e.catalog.kind("i64", ())), ("l_orderkey", e.catalog.kind("i64", ())), ("l_linenumber", e.catalog.kind("i64", ()))]
    e.changes.replace("t", engine_over(spark, sf_dir, "lineitem").sql("select l_partkey, l_orderkey, l_linenumber from lineitem"), columns)
    e.sql("create index i on t (l_partkey)")
    first = e.sql("select l_partkey, l_orderkey, l_linenumber from t order by l_partkey, l_orderkey, l_linenumber limit 20 offset 3")
    return first.union(e.sql("select * from t order by t.l_partkey desc, l_orderkey, l_linenumber limit 20"))


COLUMN_CATALOG = """
SELECT * FROM (VALUES
  ('p', 'id', 'u32', 0::BIGINT, 0::BIGINT, 0::BIGINT, 1::BIGINT, 0::BIGINT, '', '', 0::BIGINT, '', 0::BIGINT, '', 1::BIGINT, 3::BIGINT, 3::BIGINT, 0::BIGINT),
  ('p', 'name', 'string8', 1, 0, 0, 0, 0, '', '', 1, 'name != ''zed''', 0, '', 1, 3, 2, 0),
  ('c', 'k', 'i64', 0, 1, 1, 0, 0, '', '', 0, '', 0, '', 1, 3, 3, 0),
  ('c', 'p', 'u32', 1, 1, 0, 0, 1, 'p', 'id', 0, '', 1, 'by_p', 1, 3, 1, 1),
  ('c', 'x', 'decimal(6,2)', 2, 1, 0, 0, 0, '', '', 0, '', 0, '', 1, 3, 1, 1))
  t(table_name, column_name, type, ordinal, nullable, is_unique, is_primary_key, is_foreign_key, fk_ref_table, fk_ref_column, has_check, check_text, is_indexed, index_name, is_disk_backed, row_count, distinct_count, null_count)
"""

SPECIAL: dict[str, tuple[Callable, str | None]] = {
    "approx_count_distinct": (approx_distinct, "SELECT l_returnflag, true AS within FROM lineitem GROUP BY l_returnflag"),
    "approx_percentile": (approx_percentile, "SELECT l_returnflag, true AS within FROM lineitem GROUP BY l_returnflag"),
    "column_catalog": (column_catalog, "SELECT * FROM (VALUES ('nation', 'n_nationkey', 0::BIGINT, 1::BIGINT), ('nation', 'n_name', 1, 1), ('nation', 'n_regionkey', 2, 1), ('region', 'r_regionkey', 0, 1), ('region', 'r_name', 1, 1)) t(table_name, column_name, ordinal, nullable)"),
    "column_catalog_whole": (column_catalog_whole, COLUMN_CATALOG),
    "describe_constraints": (describe_constraints, "SELECT * FROM (VALUES ('id', 'u32', 'NO', 'PRI', ''), ('h', 'hue', 'YES', '', ''), ('t', 'timestamp', 'YES', '', ''), ('k', 'u64', 'NO', 'UNI', ''), ('p', 'u32', 'YES', '', 'references p(id)'), ('x', 'decimal(6,2)', 'YES', '', 'indexed(by_x), check(x > 1)')) t(\"Column\", \"Type\", \"Null\", \"Key\", \"Extra\")"),
    "explain_analyze": (explain_analyze, "SELECT 'whole' AS what, count(*) AS rows FROM nation WHERE n_regionkey < 2 UNION ALL SELECT 'join', count(*) FROM nation WHERE n_regionkey < 2"),
    "import_after_rename": (import_after_rename, "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region"),
    "delete_with_reader": (delete_with_reader, "SELECT a::INTEGER AS a, moment FROM (VALUES (1, 'before'), (2, 'before'), (3, 'before'), (1, 'after'), (3, 'after')) t(a, moment)"),
    "reloaded": (reloaded, "SELECT a::INTEGER AS a, b FROM (VALUES (1, NULL), (2, NULL), (3, NULL), (7, 'other'), (8, NULL)) t(a, b)"),
    "csv_beyond_sample": (csv_beyond_sample, "SELECT o_orderkey AS k, CASE WHEN o_orderkey > 900 THEN 'n' || o_orderkey ELSE o_orderkey::VARCHAR END AS v FROM orders"),
    "indexed_lookup": (indexed_lookup, "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey >= 30 AND o_custkey < 34"),
    "ordered_walk": (ordered_walk, "SELECT * FROM (SELECT l_partkey::BIGINT AS l_partkey, l_orderkey::BIGINT AS l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM lineitem ORDER BY l_partkey, l_orderkey, l_linenumber LIMIT 20 OFFSET 3) UNION ALL SELECT * FROM (SELECT l_partkey::BIGINT, l_orderkey::BIGINT, l_linenumber::BIGINT FROM lineitem ORDER BY l_partkey DESC, l_orderkey, l_linenumber LIMIT 20)"),
    "describe": (describe, "SELECT column_name AS \"Column\", CASE data_type WHEN 'BIGINT' THEN 'i64' WHEN 'INTEGER' THEN 'i32' WHEN 'DOUBLE' THEN 'f64' WHEN 'VARCHAR' THEN 'string8' WHEN 'TIMESTAMP' THEN 'timestamp' WHEN 'DATE' THEN 'date' ELSE data_type END AS \"Type\", 'YES' AS \"Null\", '' AS \"Key\", '' AS \"Extra\" FROM information_schema.columns WHERE table_name = 'lineitem'"),
    "analyze": (analyze, "SELECT 'nation' AS \"Table\", (SELECT count(*) FROM nation) AS \"Rows\", c AS \"Column\", d AS \"Distinct\", 0::BIGINT AS \"Nulls\" FROM (SELECT 'n_nationkey' AS c, count(DISTINCT n_nationkey) AS d FROM nation UNION ALL SELECT 'n_name', count(DISTINCT n_name) FROM nation UNION ALL SELECT 'n_regionkey', count(DISTINCT n_regionkey) FROM nation)"),
    "explain": (explain, "SELECT * FROM (VALUES ('FileScan', true), ('Join', true), ('HashAggregate', true), ('TakeOrderedAndProject', true), ('sizeInBytes', true), ('CartesianProduct', false)) t(part, there)"),
    "import_csv": (import_csv, "SELECT c_custkey, c_name, round(c_acctbal, 2) AS c_acctbal, c_mktsegment FROM customer WHERE c_nationkey < 5"),
    "insert_constraints": (insert_constraints, "SELECT * FROM (VALUES (1::BIGINT, 'a', NULL::BIGINT), (2, 'b', 1), (3, 'c', NULL)) t(id, name, child)"),
    "delete_restrict": (delete_restrict, "SELECT * FROM (VALUES (1::BIGINT, 10), (2, 20), (3, NULL)) t(id, v)"),
    "typed_columns": (typed_columns, "SELECT * FROM (VALUES ('large', '2024-03-02', 2.35::DOUBLE), ('middle', '2023-12-31', 0.5)) t(s, d, x)"),
    "altered_table": (altered_table, "SELECT * FROM (VALUES (1, NULL::BIGINT), (2, 5)) t(a, c)"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = {name: (lambda spark, sf_dir, text=text: run(spark, sf_dir, text)) for name, (text, _) in QUERIES.items()}
    return made | {name: f for name, (f, _) in SPECIAL.items()}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, (text, oracle) in QUERIES.items():
        sql = oracle or text
        rounded = [c for c in ROUNDED if re.search(rf"\bAS {c}\b(?!\.)", text)]
        out[name] = f"SELECT * REPLACE ({', '.join(f'{_round(c)} AS {c}' for c in rounded)}) FROM ({sql}) AS q" if rounded and name not in _WHOLE else sql
    return out | {name: sql for name, (_, sql) in SPECIAL.items() if sql}


#: Queries whose like-named columns hold no doubles, or that carry further clauses of their own.
_WHOLE = ("agg_sum_int", "win_row_number_unordered", "similarity_filter", "similarity_topk", "derived_nested", "cte_chain", "join_self_cte")


def _round(column: str) -> str:
    return f"round({column}, 2)"
