"""Connected components of a table of links, by rounds of hooking to the least neighbour and jumping.

Every node points to its least neighbour if that is smaller, then to that one's pointer; links are
renamed to pointers, links inside a component fall away, and the rounds end when none is left.  A round's joins are on node ids and
its sums are pre-aggregated, so that no component or hub is gathered in one place; nothing but a count comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import stored, sweeping


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in links (a long, b long): component is the least id reachable."""
    with sweeping(links.sparkSession) as keep:
        now = stored(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
        named = None
        while not now.isEmpty():
            both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
            point = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("to"))
            point = stored(point, "points")
            jump = point.join(point.select(F.col("id").alias("to"), F.col("to").alias("to2")), "to", "left").select("id", F.coalesce("to2", "to").alias("to"))
            jump = stored(jump, "jumps", keep if named is None else None)
            if named is None:
                named = jump.select("id", F.col("to").alias("component"))
            else:
                keep.clear()
                named = stored(named.join(jump.select(F.col("id").alias("component"), "to"), "component", "left").select("id", F.coalesce("to", "component").alias("component")), "named", keep)
            at_a = now.join(jump.select(F.col("id").alias("a"), F.col("to").alias("x")), "a")
            at_b = at_a.join(jump.select(F.col("id").alias("b"), F.col("to").alias("y")), "b")
            now = stored(at_b.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        return named if named is not None else links.select(F.col("a").alias("id"), F.col("b").alias("component")).limit(0)
