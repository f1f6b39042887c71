"""Runs the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Every query is run once to warm up; then each is run RUNS times and its median taken, its rows going nowhere. The Parquet scans are part of the time.
"larger" has a few shapes over generated tables of LARGER rows, where the cost of a job no longer hides the cost of a row: seconds by number of rows ($BENCH_LARGER=0 leaves them out).
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import SparkSession

from brindle import queries
from brindle.session import Engine

HEADLINE = [
    "revenue_by_nation", "point_lookup", "wide_filter", "filter_three_predicates", "filter_contains", "filter_string_cmp", "agg_global", "agg_sum_int", "agg_two_keys", "agg_dense_key",
    "agg_high_cardinality", "join_inner", "join_three_way", "join_agg_by_dimension", "semi_exists", "anti_not_exists", "not_in_subquery", "distinct_via_group", "having", "topn", "topn_over_groups",
    "sort_rows", "win_rank_dense", "win_running_sum_peers", "win_topk_per_group", "cte_chain", "edit_distance", "similarity_topk",
]
RUNS = 3
LARGER = (5_000_000, 50_000_000)
SHAPES = {
    "sums": "select sum(fee), min(fee), max(fee) from visits",
    "count_of_one_in_50": "select count(*) from visits where district = 7",
    "groups_50": "select district, count(*), sum(fee) from visits group by district order by district",
    "groups_10000": "select fee, count(*), sum(district) from visits group by fee order by fee desc",
    "one_row": "select id, fee from visits where mark = 123457",
    "join_50": "select count(*), sum(visits.fee) from visits join districts on visits.district = districts.district where districts.zone = 2",
    "join_large": "select count(*), sum(badges.weight) from visits join badges on visits.mark = badges.badge",
    "top_rows": "select id, mark from visits order by mark desc, id limit 100",
}


def larger(spark: SparkSession) -> dict:
    """Seconds of each shape by number of rows; every row's values follow from its number."""
    out: dict = {name: {} for name in SHAPES}
    for n in LARGER:
        with tempfile.TemporaryDirectory(prefix="brindle-bench-") as folder:
            spark.range(n).selectExpr("cast(id as int) as id", "cast(id % 50 as int) as district", "cast(id * 31 % 10000 as int) as fee", f"cast(id * 7919 % {n} as int) as mark").write.parquet(f"{folder}/visits")
            spark.range(50).selectExpr("cast(id as int) as district", "cast(id % 5 as int) as zone").write.parquet(f"{folder}/districts")
            spark.range(0, n, 100).selectExpr(f"cast(id * 7919 % {n} as int) as badge", "cast(id % 7 as int) as weight").write.parquet(f"{folder}/badges")
            e = Engine.over(spark, {t: spark.read.parquet(f"{folder}/{t}") for t in ("visits", "districts", "badges")})
            for name, text in SHAPES.items():
                took = []
                for _ in range(RUNS):
                    began = time.perf_counter()
                    e.sql(text).write.format("noop").mode("overwrite").save()
                    took.append(time.perf_counter() - began)
                out[name][str(n)] = round(min(took), 4)
    return out


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    made, took = queries.queries(), {}

    def seconds(name: str) -> float:
        began = time.perf_counter()
        made[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    for name in HEADLINE:
        seconds(name)
    for name in HEADLINE:
        took[name] = round(statistics.median(seconds(name) for _ in range(RUNS)), 4)
    found = {"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir).removeprefix("sf")}
    if os.environ.get("BENCH_LARGER") != "0":
        found["larger"] = larger(spark)
    print(json.dumps(found))
    spark.stop()


if __name__ == "__main__":
    main()
