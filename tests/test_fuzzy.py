from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brindle.functions.fuzzy import edit_distance_sql, similarity_sql


def grams(b):
    return [b[i : i + 3] for i in range(len(b) - 2)]


def plain_similarity(x, needle):
    a, b = x.encode(), needle.encode()
    if len(a) < 3 or len(b) < 3:
        return 1.0 if a == b else 0.0
    h, n = grams(a), grams(b)[:64]
    shared = sum((Counter(h) & Counter(n)).values())
    return shared / (len(h) + len(n) - shared)


def plain_distance(x, needle):
    a, b = x.encode(), needle.encode()[:64]
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return row[-1]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("abcé'\\ x", max_size=12), min_size=1, max_size=12), st.text("abcé'\\ x", max_size=80))
def test_against_plain_loops(spark, texts, needle):
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    got = df.select("x", F.expr(similarity_sql("x", needle)).alias("s"), F.expr(edit_distance_sql("x", needle)).alias("d")).collect()
    for r in got:
        assert abs(r.s - plain_similarity(r.x, needle)) < 1e-12
        assert r.d == plain_distance(r.x, needle)


def test_plain_grams_stay_in_generated_code(spark):
    df = spark.createDataFrame([("a small ring of gold",), ("ring",), ("ab",), ("",), ("smäll ring",), (None,)], "x string")
    for needle in ("small ring", "smäll rin", "aaaa small", "abcdefghijklmnopqrstuvwxyz0123456789"):
        got = df.select("x", F.expr(similarity_sql("x", needle)).alias("s"))
        assert all((r.s is None) == (r.x is None) and (r.x is None or abs(r.s - plain_similarity(r.x, needle)) < 1e-12) for r in got.collect())
        assert ("transform(" in similarity_sql("x", needle)) == (needle.startswith("aaaa") or len(needle) > 26)


def test_null(spark):
    df = spark.createDataFrame([(None,)], "x string")
    assert df.select(F.expr(similarity_sql("x", "abc")), F.expr(edit_distance_sql("x", "abc"))).first() == (None, None)
