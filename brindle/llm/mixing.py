"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents may belong to several sources.  They are aggregated by pattern (the set of their sources); a flow
network routes words from patterns to the sources' quotas: a pattern offers its size once for each allowed use, the first use
free and every further one dearer (convex costs), and an arc joins it to each source in the pattern.  The cheapest largest flow says
how many words each pattern gives.  Whole documents are then taken: full passes over a pattern, and for what is left
documents in the order of a seeded hash, found by a histogram of the hash, which is refined where the words run out until few documents are left there, so that no pattern is sorted in one place.
A document that is larger than what is left is passed over: what is left is filled in rounds from the unused documents that fit it, in
hash order again while it is wide, else from the largest candidates of each size class, a bounded number a round, until no unused document fits.

Defined cases: a null text has size 0 and is never taken; a null source is a source of its own, last in order; rows that repeat a doc_id are taken
alike; an empty table gives no row; documents of size 0 have taken 0.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import stored

WEIGHTS = (5, 2, 1)
MOST_USES = 3
SEED = 20_24
#: Bits of the seeded hash, and those by which each histogram refines the one before; documents of a cell that are sorted in one place.
DRAW_BITS, CELL_BITS = 60, 12
SORTED = 100_000
#: Candidates for the last gap in a round: so many of each pattern and size class (powers of two).  A gap of so many times the largest document that fits is wide.
CANDIDATES = 16
#: Patterns are planned on the driver; a mix has a configured set of sources, and more patterns than this are refused.
MOST_PATTERNS = 100_000

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cyclic_weights(sources: list[str | None]) -> dict[str | None, float]:
    """5, 2, 1 and so on over the sources by code point, null last."""
    ordered = sorted((s for s in sources if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sources)
    return {s: float(WEIGHTS[i % len(WEIGHTS)]) for i, s in enumerate(ordered)}


def targets_of(sizes: dict, weights: dict, most_uses: int = MOST_USES) -> dict:
    """Each source's share of all sizes by weight, stopped at most_uses times its size, the excess reshared until none is above."""
    total = float(sum(sizes.values()))
    fixed: dict = {}
    while True:
        free = [s for s in sizes if s not in fixed]
        left = total - sum(fixed.values())
        whole = sum(weights[s] for s in free)
        shares = {s: left * weights[s] / whole if whole else 0.0 for s in free}
        above = [s for s in free if shares[s] > most_uses * sizes[s]]
        if not above:
            return {s: fixed.get(s, shares.get(s, 0.0)) for s in sizes}
        fixed |= {s: float(most_uses * sizes[s]) for s in above}


def cheapest_flow(patterns: list[tuple[frozenset, int]], quotas: dict, most_uses: int = MOST_USES) -> list[dict]:
    """Words of each pattern that go to each source: a largest flow of least cost.

    The r-th use of a pattern costs r - 1 a word, so uses are spread before any is repeated.  By primal-dual phases: shortest distances by cost,
    then largest flows over the arcs on shortest ways, by levels; there are as many phases as there are lengths of shortest ways, which are few.
    """
    names = list(quotas)
    start, end, n = 0, 1, 2 + len(names) + len(patterns)
    node = {s: 2 + i for i, s in enumerate(names)}
    to: list[int] = []
    room: list[int] = []
    cost: list[int] = []
    arcs: list[list[int]] = [[] for _ in range(n)]  # an arc's number; that of its reverse differs in the last bit

    def arc(u: int, v: int, most: int, price: int) -> int:
        for a, b, r, c in ((u, v, most, price), (v, u, 0, -price)):
            arcs[a].append(len(to))
            to.append(b)
            room.append(r)
            cost.append(c)
        return len(to) - 2

    sent: list[dict] = []
    for i, (members, size) in enumerate(patterns):
        p = 2 + len(names) + i
        for use in range(most_uses):
            arc(start, p, size, use)
        sent.append({s: arc(p, node[s], most_uses * size, 0) for s in sorted(members, key=lambda s: (s is None, s))})
    for s in names:
        arc(node[s], end, max(0, int(quotas[s])), 0)

    def distances() -> list[int | None]:
        far: list[int | None] = [None] * n
        far[start], queue, waits = 0, deque([start]), [False] * n
        while queue:
            u = queue.popleft()
            waits[u] = False
            for e in arcs[u]:
                if room[e] and (far[to[e]] is None or far[u] + cost[e] < far[to[e]]):
                    far[to[e]] = far[u] + cost[e]
                    if not waits[to[e]]:
                        waits[to[e]] = True
                        queue.append(to[e])
        return far

    def levels(far: list) -> list[int]:
        found, queue = [-1] * n, deque([start])
        found[start] = 0
        while queue:
            u = queue.popleft()
            for e in arcs[u]:
                if room[e] and found[to[e]] < 0 and far[to[e]] == far[u] + cost[e]:
                    found[to[e]] = found[u] + 1
                    queue.append(to[e])
        return found

    def fill(far: list, level: list[int]) -> None:
        """Sends all that the levels allow; an arc once found useless isn't tried again."""
        tried = [0] * n
        way: list[int] = []
        u = start
        while True:
            if u == end:
                most = min(room[e] for e in way)
                for e in way:
                    room[e] -= most
                    room[e ^ 1] += most
                way, u = [], start
            while tried[u] < len(arcs[u]):
                e = arcs[u][tried[u]]
                if room[e] and level[to[e]] == level[u] + 1 and far[to[e]] == far[u] + cost[e]:
                    break
                tried[u] += 1
            if tried[u] < len(arcs[u]):
                way.append(arcs[u][tried[u]])
                u = to[way[-1]]
            elif way:
                u = to[way.pop() ^ 1]
                tried[u] += 1
            else:
                return

    while (far := distances())[end] is not None:
        while (level := levels(far))[end] >= 0:
            fill(far, level)
    return [{s: room[e ^ 1] for s, e in of.items()} for of in sent]


def in_hash_order(drawn: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Which rows of drawn (key, more, doc_id, draw, size) are the first in hash order that fit the key's ``more``, in a column extra.

    Also, for each key whose sizes are above it, the gap that is left up to the first that doesn't fit.
    """
    edge, shift = None, DRAW_BITS
    while edge is None or (shift and (edge.agg(F.max("n").alias("n")).first().n or 0) > SORTED):
        if edge is None:
            part = drawn.where("more > 0").withColumn("room", F.col("more"))
        else:
            part = drawn.join(F.broadcast(edge.select("key", "edge", "room")), "key").where(F.shiftright("draw", shift) == F.col("edge"))
        shift -= CELL_BITS
        by_cell = part.groupBy("key", "room", F.shiftright("draw", shift).alias("cell")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
        ordered = Window.partitionBy("key").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)  # at most 2 ** CELL_BITS rows a key
        first = by_cell.withColumn("upto", F.sum("words").over(ordered)).where("upto > room").groupBy("key", "room").agg(F.min(F.struct("cell", "upto", "words", "n")).alias("m"))
        edge = stored(first.select("key", F.col("m.cell").alias("edge"), (F.col("room") - F.col("m.upto") + F.col("m.words")).alias("room"), "m.n"), "edge")
    # Inside the cell where the words run out, documents follow in hash order as long as they fit; equal draws of one doc_id go together.
    cell = F.shiftright("draw", shift)
    units = drawn.join(F.broadcast(edge), "key").where(cell == F.col("edge")).groupBy("key", "doc_id", "draw", "room").agg(F.sum("size").alias("size"))
    within = Window.partitionBy("key").orderBy("draw", "doc_id").rowsBetween(Window.unboundedPreceding, 0)  # about SORTED rows a key, or those of one draw
    inside = stored(units.withColumn("upto", F.sum("size").over(within)), "inside")
    fits = inside.groupBy("key", "room").agg(F.max(F.when(F.col("upto") <= F.col("room"), F.struct("draw", "doc_id", "upto"))).alias("m")).select("key", F.col("m.draw").alias("last_draw"), F.col("m.doc_id").alias("last_id"), (F.col("room") - F.coalesce("m.upto", F.lit(0))).alias("gap"))
    fits = stored(edge.select("key", "edge").join(fits, "key"), "fits")
    at = drawn.join(F.broadcast(fits), "key", "left")
    chosen = F.when(F.col("more") <= 0, False).when(F.col("edge").isNull(), True).when(cell != F.col("edge"), cell < F.col("edge"))
    chosen = chosen.otherwise(F.coalesce(F.struct("draw", "doc_id") <= F.struct(F.col("last_draw"), F.col("last_id")), F.lit(False)))
    return at.withColumn("extra", chosen), fits


def filled(free: DataFrame, gaps: dict) -> list[tuple[DataFrame, bool]]:
    """Units (key, doc_id) of free (key, doc_id, size, draw) that fill the keys' gaps until none that is left fits, and whether they are few."""
    spark = free.sparkSession
    kind = dict(free.dtypes)["doc_id"]
    picks: list[tuple] = []
    many: DataFrame | None = None
    while gaps:
        now = free.join(F.broadcast(spark.createDataFrame(list(gaps.items()), "key string, more long")), "key").where("size <= more")
        # The largest of each size class in each of CANDIDATES parts of the hash: pre-aggregated, and at most so many a class.
        best = now.groupBy("key", F.floor(F.log2("size")).alias("class"), F.pmod(F.shiftright("draw", DRAW_BITS - CELL_BITS), F.lit(CANDIDATES)).alias("part")).agg(F.max(F.struct("size", "draw", "doc_id")).alias("m"))
        by_key: dict = {}
        for c in best.select("key", "m.*").collect():
            by_key.setdefault(c.key, []).append(c)
        gaps = {key: gap for key, gap in gaps.items() if key in by_key}
        wide = {key: gap for key, gap in gaps.items() if gap >= CANDIDATES * max(c.size for c in by_key[key])}
        fresh = []
        for key in gaps.keys() - wide.keys():
            for c in sorted(by_key[key], key=lambda c: (-c.size, c.draw)):
                if c.size <= gaps[key]:
                    fresh.append((key, c.doc_id))
                    gaps[key] -= c.size
        if not gaps:
            break
        picks += fresh
        used = spark.createDataFrame(fresh, f"key string, doc_id {kind}")
        if wide:
            at, _ = in_hash_order(now.where(F.col("key").isin(list(wide))))
            taken = stored(at.where("extra").select("key", "doc_id", "size"), "taken")
            for x in taken.groupBy("key").agg(F.sum("size").alias("size")).collect():
                gaps[x.key] -= x.size
            many = taken.select("key", "doc_id") if many is None else many.union(taken.select("key", "doc_id"))
            used = used.union(taken.select("key", "doc_id"))
        gaps = {key: gap for key, gap in gaps.items() if gap > 0}
        if gaps:
            used = used.select(F.col("key").alias("k"), F.col("doc_id").alias("d"))
            used = used if wide else F.broadcast(used)
            free = stored(now.drop("more").join(used, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")), "left_anti"), "free")
    return [(spark.createDataFrame(picks, f"key string, doc_id {kind}"), True)] * bool(picks) + [(many, False)] * (many is not None)


def mix(docs: DataFrame, members: Column, weights=cyclic_weights, most_uses: int = MOST_USES, seed: int = SEED) -> DataFrame:
    """How many words a mix takes of each row of ``docs`` (doc_id, text, ...).

    members: array of the row's sources, empty for none.  weights: from the list of sources, each one's weight.
    Returns docs with pattern, size, targets (a map from source, '' standing for null, to its target), uses and taken.
    """
    spark = docs.sparkSession
    sized = stored(docs.select(F.col("doc_id"), F.array_sort(F.array_distinct(members)).alias("pattern"), word_count(F.col("text")).alias("size")).withColumn("key", F.to_json(F.struct("pattern"), {"ignoreNullFields": "false"})), "sizes")
    totals = sized.groupBy("key").agg(F.first("pattern").alias("pattern"), F.sum("size").alias("size")).limit(MOST_PATTERNS + 1).collect()
    if len(totals) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} membership patterns")
    totals.sort(key=lambda r: r.key)
    sources: dict = {}
    for r in totals:
        for s in r.pattern:
            sources[s] = sources.get(s, 0) + r.size
    targets = targets_of(sources, weights(list(sources)), most_uses)
    flows = cheapest_flow([(frozenset(r.pattern), r.size) for r in totals], {s: round(t) for s, t in targets.items()}, most_uses)
    plan = []
    for r, flow in zip(totals, flows, strict=True):
        words = sum(flow.values())
        passes = min(most_uses, words // r.size) if r.size else 0
        plan.append((r.key, r.size, passes, words - passes * r.size if passes < most_uses else 0))
    planned = F.broadcast(spark.createDataFrame(plan, "key string, pattern_size long, passes long, more long"))  # at most MOST_PATTERNS rows

    drawn_from = F.xxhash64(F.lit(seed), F.col("doc_id"))
    draw = F.shiftleft(drawn_from.bitwiseAND(F.lit((1 << CELL_BITS) - 1)), DRAW_BITS - CELL_BITS) + F.shiftright(drawn_from, 64 - DRAW_BITS + CELL_BITS) + F.lit(1 << DRAW_BITS - CELL_BITS - 1)
    drawn = sized.join(planned, "key").withColumn("draw", draw)
    at, fits = in_hash_order(drawn)
    free = at.where("NOT extra AND gap > 0 AND size > 0 AND size <= gap").groupBy("key", "gap", "doc_id").agg(F.sum("size").alias("size"), F.first("draw").alias("draw")).where("size <= gap").drop("gap")
    out = at.drop("gap")
    gaps = {x.key: x.gap for x in fits.where("gap > 0").collect()}  # at most MOST_PATTERNS
    found = filled(stored(free, "free"), gaps)
    for n, (units, few) in enumerate(found):
        name = f"picked{n}"
        units = units.select(F.col("key").alias("k"), F.col("doc_id").alias("d"), F.lit(True).alias(name))
        out = out.join(F.broadcast(units) if few else units, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")), "left").drop("k", "d")
        out = out.withColumn("extra", F.col("extra") | F.coalesce(name, F.lit(False))).drop(name)
    uses = F.when(F.col("size") > 0, F.col("passes") + F.col("extra").cast("long")).otherwise(F.lit(0))
    names = spark.createDataFrame([(s, int(n), float(targets[s])) for s, n in sources.items()], "source string, source_size long, target double")
    return out.select("doc_id", "pattern", "size", uses.cast("long").alias("uses")).withColumn("taken", F.col("size") * F.col("uses")), names


def digest(docs: DataFrame) -> DataFrame:
    taken, names = mix(docs, F.array(F.col("source").cast("string")))
    one = taken.withColumn("source", F.element_at("pattern", 1)).alias("t").join(F.broadcast(names).alias("n"), F.col("t.source").eqNullSafe(F.col("n.source")))
    return one.select("doc_id", "size", "source_size", "target", "taken")
