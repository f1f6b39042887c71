"""Near-duplicate texts by ProbMinHash signatures, banding and verification.

A text is its set of five-word shingles (lower-cased, cut at white space), however often each occurs.  A ProbMinHash
signature has, for each of ``SLOTS`` slots, the shingle whose exponential clock of rate weight rang there first: a shingle's
arrivals are a Poisson process whose times and slots follow from its hash alone, and they are made only while
they can still be the first in some slot (early termination).  Two texts agree in a slot with the
chance of their probability Jaccard similarity.  All shingles weigh 1, so that this is the Jaccard similarity of the sets, by which
links are decided: weights by occurrences would part texts of which one repeats a passage.  Texts that agree in all ``ROWS`` slots of a band are candidates;
at 0.8 a pair is missed by all ``BANDS`` bands with a chance of 0.0002.

Texts with the same words are collapsed first.  Candidates are then verified on their whole shingle sets
(Jaccard similarity of ``THRESHOLD`` or more) in two passes that never emit all pairs of a bucket:

1. In each bucket every text is compared with one pivot, the text that meets most others over all its buckets
   (in a group of copies that is the one nearest to all), and the links give components.
2. In buckets that still hold several components, pairs of different components are compared, first by how many
   shingles each has in ``CELLS`` parts of the hashes (a pair is left only if the lesser counts don't add up to what the threshold
   asks, which loses nothing), then on their shingles.  Large buckets are cut into
   blocks that meet in pairs of blocks, so no task holds a bucket.

The result has each document's class (the least id with the same words) and its component: which documents belong together, not
how many links hold them.

Defined cases: a null text is a class of its own; texts without words are copies of each other; texts with fewer than five words have
one shingle of all their words; rows that repeat a doc_id count once, as one of its texts; a null doc_id is returned kept and alone;
an empty table gives no row; ties go to the least id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import prepare, shuffle_width, stored, sweeping
from brindle.llm.components import components

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 28, 6
SLOTS = BANDS * ROWS
#: Texts compared with one copy of a pivot's text, and members of a block of a bucket, at most about.
CHUNK, BLOCK = 128, 192
#: Parts of the hashes in which a text's shingles are counted, and the count that stands for any from there on.
CELLS, FULL = 128, 65_535
#: Bits of the filter that keeps texts which no pair needs from being shuffled: so many for each id, between these bounds (4 million words are broadcast at most).
BITS_AN_ID, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 28
#: Shingles signed together.
SIGN_TOGETHER = 100_000
#: Texts, and members of blocks, that a task of a verifying shuffle holds on average at most.
TASK_TEXTS, TASK_MEMBERS = 20_000, 100_000

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = x + _A
        x = (x ^ (x >> np.uint64(30))) * _B
        x = (x ^ (x >> np.uint64(27))) * _C
        return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def shingles(words: list[str]) -> np.ndarray:
    """Hashes of all runs of five words, repeats included; of fewer words, one of all."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - WORDS + 1)
    out = np.full(n, len(words) if len(words) < WORDS else WORDS, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(min(WORDS, len(words))):
            out = out * _C + h[i : i + n]
    return mixed(out)


def signatures(sets: list[np.ndarray], weights: list[np.ndarray]) -> np.ndarray:
    """ProbMinHash signatures, a row for each set of weighted element hashes (no set is empty)."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    element, weight = np.concatenate(sets), np.concatenate(weights)
    owner = np.repeat(np.arange(n), sizes)
    burst = np.maximum(1, SLOTS // sizes)  # arrivals of an element that are made at once: of small sets many are needed
    first = np.full(n * SLOTS, np.inf)
    who = np.zeros(n * SLOTS, np.uint64)
    clock = np.zeros(len(element))
    step = np.zeros(len(element), np.uint64)
    while len(element):
        times = burst[owner]
        at = np.repeat(np.arange(len(element)), times)
        turn = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
        with np.errstate(over="ignore"):
            draw = mixed(element[at] ^ mixed(step[at] + turn.astype(np.uint64)))
        wait = -np.log(((draw >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / weight[at]
        run = np.cumsum(wait)
        starts = np.cumsum(times) - times
        run -= np.repeat(run[starts] - wait[starts] - clock, times)
        slot = owner[at] * SLOTS + (mixed(draw) % np.uint64(SLOTS)).astype(np.int64)
        good = np.flatnonzero(run < first[slot])
        good = good[np.argsort(-run[good], kind="stable")]  # of equal slots the earliest is written last
        first[slot[good]] = run[good]
        who[slot[good]] = element[at[good]]
        clock = run[starts + times - 1]
        step = step + times.astype(np.uint64)
        late = first.reshape(n, SLOTS).max(axis=1)
        going = clock < late[owner]
        element, weight, owner, clock, step = element[going], weight[going], owner[going], clock[going], step[going]
    return who.reshape(n, SLOTS)


def cells_of(found: np.ndarray) -> bytes:
    """How many of a set's hashes are in each cell."""
    return np.minimum(np.bincount((found % np.uint64(CELLS)).astype(np.int64), minlength=CELLS), FULL).astype("<u2").tobytes()


def may_link(one: np.ndarray, others: np.ndarray, threshold: float) -> np.ndarray:
    """Which others (rows of counts) can reach the threshold with one: false only where no sets with these counts do."""
    shared = np.minimum(others, one).sum(axis=1)
    unknown = (others == FULL).any(axis=1) | (one == FULL).any()  # counts cut at FULL: more may be shared
    return unknown | (shared * (1 + threshold) >= threshold * (one.sum() + others.sum(axis=1)) - 1e-6)


SIGNED = pa.schema([("doc_id", pa.int64()), ("fp1", pa.int64()), ("fp2", pa.int64()), ("bands", pa.list_(pa.int64())), ("cells", pa.binary())])
SIGNED_DDL = "doc_id long, fp1 long, fp2 long, bands array<long>, cells binary"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        prints, todo = [], []
        bands: list = [None] * len(ids)
        cells: list = [None] * len(ids)
        sets: list[np.ndarray] = []

        def sign() -> None:
            if todo:
                got = signatures(sets, [np.ones(len(s)) for s in sets])
                with np.errstate(over="ignore"):
                    key = np.tile(np.arange(BANDS, dtype=np.uint64), (len(todo), 1))
                    for r in range(ROWS):
                        key = mixed(key ^ got[:, r::ROWS][:, :BANDS]) if r == 0 else mixed(key * _C + got[:, r::ROWS][:, :BANDS])
                for j, i in enumerate(todo):
                    bands[i] = key[j].view(np.int64)
            todo.clear()
            sets.clear()

        waiting = 0
        for i, text in enumerate(texts):
            words = words_of(text)
            digest = xxhash.xxh3_128_digest(" ".join(words))
            prints.append(np.frombuffer(digest, np.int64))
            if words:
                found = np.unique(shingles(words))
                todo.append(i)
                sets.append(found)
                cells[i] = cells_of(found)
                waiting += len(found)
                if waiting >= SIGN_TOGETHER:
                    sign()
                    waiting = 0
        sign()
        p = np.array(prints).reshape(len(ids), 2)
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(bands, pa.list_(pa.int64())), pa.array(cells, pa.binary())], schema=SIGNED)


def _verify(threshold: float):
    """Groups of (pivot, salt): first the pivot's text, then those that are compared with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, base = None, None
        for batch in batches:
            a, b = [], []
            for pivot, salt, other, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (pivot, salt) != now:
                    now, base = (pivot, salt), None
                if not other:
                    base = np.unique(shingles(words_of(text)))
                elif base is not None:
                    mine = np.unique(shingles(words_of(text)))
                    small, large = sorted((len(base), len(mine)))
                    if small >= threshold * large:
                        shared = len(np.intersect1d(base, mine, assume_unique=True))
                        if shared >= threshold * (len(base) + len(mine) - shared):
                            a.append(pivot)
                            b.append(doc_id)
            if a:
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _compare(threshold: float):
    """Groups of (key, i, j): members of two blocks of a bucket; pairs of different components that can reach the threshold by their counts.

    A pair that meets in several buckets is given in that of its first shared band alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        rows: list[tuple] = []

        def close() -> Iterator[pa.RecordBatch]:
            if not rows:
                return
            side = np.array([r[0] for r in rows])
            ids, component = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
            counts = np.frombuffer(b"".join(r[3] for r in rows), "<u2").reshape(len(rows), CELLS).astype(np.int64)
            bands = np.array([r[4] for r in rows], np.int64)
            key = now[0]
            left = np.flatnonzero(side == now[1])
            right = np.flatnonzero(side == now[2])
            a, b = [], []
            for x in left.tolist():
                others = right[(component[right] != component[x]) & ((ids[right] > ids[x]) | (now[1] != now[2]))]
                if len(others):
                    near = others[may_link(counts[x], counts[others], threshold)]
                    near = near[bands[x][np.argmax(bands[near] == bands[x], axis=1)] == key] if len(near) else near
                    a += [min(int(ids[x]), int(ids[y])) for y in near]
                    b += [max(int(ids[x]), int(ids[y])) for y in near]
            if a:
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["pivot", "id"])

        for batch in batches:
            for key, i, j, block, doc_id, component, cells, bands in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, i, j) != now:
                    yield from close()
                    now, rows = (key, i, j), []
                rows.append((block, doc_id, component, cells, bands))
        yield from close()

    return run


def needed_texts(texts: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """The texts (id, text) of the about n ids, and a few more: those that a bitmap of the ids' hashes, broadcast, lets through."""
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_AN_ID * max(n, 1)).bit_length()))
    place = F.pmod(F.xxhash64("id", F.lit(21)), F.lit(size))
    bits = ids.select(F.shiftright(place, 6).alias("word"), place.alias("place")).selectExpr("word", "shiftleft(1L, cast(place & 63 as int)) AS bit").groupBy("word").agg(F.bit_or("bit").alias("bits"))
    at = texts.withColumn("place", place).withColumn("word", F.shiftright("place", 6))
    return at.join(F.broadcast(bits), "word").where("shiftright(bits, cast(place & 63 as int)) & 1 = 1").select("id", "text")  # at most MOST_BITS / 64 rows are broadcast


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (pivot, id), stored, whose texts (id, text) reach the threshold, as (a, b).

    A pivot's text goes once to each group of about ``CHUNK`` that are compared with it.
    """
    spark, n = pairs.sparkSession, pairs.count()
    sizes = stored(pairs.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("salts")), "pivots")  # written, so that the join below has two exchanges and a hot pivot can be split
    asked = pairs.join(sizes, "pivot").select("pivot", F.pmod(F.xxhash64("id"), F.col("salts")).alias("salt"), F.lit(True).alias("other"), "id")
    bases = sizes.select("pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(False).alias("other"), F.col("pivot").alias("id"))
    found = needed_texts(texts, pairs.select("id").union(pairs.select("pivot")), 2 * n)
    needed = asked.union(bases).join(found.hint("merge"), "id").select("pivot", "salt", "other", "id", "text")
    dealt = needed.repartition(shuffle_width(spark, n, TASK_TEXTS), "pivot", "salt").sortWithinPartitions("pivot", "salt", "other", "id")
    return dealt.mapInArrow(_verify(threshold), "a long, b long")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, component_id, kept) for every doc_id of docs (doc_id, text).

    class_id: the least doc_id with the same words; component_id: the least that links reach.
    """
    prepare(docs.sparkSession)
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with sweeping(docs.sparkSession) as keep:
        prints, named = _named_classes(whole, threshold, keep)
    found = prints.join(named, ["fp1", "fp2"]).select("doc_id", "class_id", "component_id")
    alone = whole.where("text IS NULL OR doc_id IS NULL").select("doc_id").distinct().join(prints.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    return found.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _named_classes(whole: DataFrame, threshold: float, keep: set[str]) -> tuple[DataFrame, DataFrame]:
    """Each document's print (doc_id, fp1, fp2), and each print's class and component; both on paths in keep."""
    spark = whole.sparkSession
    signed = stored(whole.where("text IS NOT NULL AND doc_id IS NOT NULL").mapInArrow(_sign, SIGNED_DDL), "signed", keep)
    if not signed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():  # of rows that repeat a doc_id, one stays
        signed = stored(signed.groupBy("doc_id").agg(F.min(F.struct("fp1", "fp2", "bands", "cells")).alias("r")).select("doc_id", "r.*"), "signed-once", keep)
    prints = signed.select("doc_id", "fp1", "fp2")
    # Texts of a class have the same words, and so the same bands and counts: the least id stands for all.
    classes = stored(prints.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("id")), "classes", keep)
    reps = stored(signed.select(F.col("doc_id").alias("id"), "bands").join(classes.select("id"), "id", "left_semi"), "reps")

    texts = whole.withColumnRenamed("doc_id", "id").where("text IS NOT NULL AND id IS NOT NULL")
    spread = reps.select("id", F.explode("bands").alias("key"))
    shared = spread.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = stored(spread.join(shared, "key").select("key", "id", "n"), "buckets")
    popular = buckets.groupBy("id").agg(F.sum("n").alias("meets"))
    ranked = stored(buckets.join(popular, "id"), "ranked")
    pivots = ranked.groupBy("key").agg(F.max(F.struct("meets", (-F.col("id")).alias("less"))).alias("p")).select("key", (-F.col("p.less")).alias("pivot"))
    pairs = stored(ranked.join(pivots, "key").where("id <> pivot").select("pivot", "id").distinct(), "pairs")
    links = stored(verified(pairs, texts, threshold), "links")
    first = components(links)

    placed = stored(buckets.join(first, "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("component")), "placed")
    several = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max("n").alias("size")).where("low <> high").select("key", "size", F.ceil(F.col("size") / BLOCK).alias("blocks"))
    several = stored(several, "several")
    members = several.agg(F.sum(F.col("size") * F.col("blocks")).alias("n")).first().n or 0
    split = placed.select("key", "id", "component").join(several.drop("size"), "key").join(signed.select(F.col("doc_id").alias("id"), "cells", "bands"), "id").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    meets = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: F.struct(F.least(x, F.col("block")).alias("i"), F.greatest(x, F.col("block")).alias("j")))
    blocks = split.withColumn("m", F.explode(meets)).select("key", "m.i", "m.j", "block", "id", "component", "cells", "bands")
    dealt = blocks.repartition(shuffle_width(spark, members, TASK_MEMBERS), "key", "i", "j").sortWithinPartitions("key", "i", "j", "id")
    rest = dealt.mapInArrow(_compare(threshold), "pivot long, id long")
    rest = stored(rest.join(pairs, (rest.pivot == pairs.pivot) & (rest.id == pairs.id), "left_anti").join(pairs, (rest.pivot == pairs.id) & (rest.id == pairs.pivot), "left_anti"), "rest")
    more = stored(verified(rest, texts, threshold), "more")
    named = stored(components(links.union(more)), "components", keep)
    named = classes.join(named, "id", "left").select("fp1", "fp2", F.col("id").alias("class_id"), F.coalesce("component", "id").alias("component_id"))
    return prints, named


ORACLE = r"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
  joined AS (SELECT doc_id, w, array_to_string(w, ' ') AS t FROM words),
  classes AS (SELECT t, min(doc_id) AS class_id, any_value(w) AS w FROM joined GROUP BY t),
  shingles AS (SELECT DISTINCT class_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [t] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM classes),
  sizes AS (SELECT class_id, count(*) AS n FROM shingles GROUP BY class_id),
  pairs AS (SELECT a.class_id AS a, b.class_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.class_id <> b.class_id GROUP BY a.class_id, b.class_id),
  links AS (SELECT a, b FROM pairs JOIN sizes x ON x.class_id = a JOIN sizes y ON y.class_id = b WHERE 5 * k >= 4 * (x.n + y.n - k)),
  reach AS (SELECT a AS id, a AS root FROM links UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.id WHERE r.root < l.b),
  named AS (SELECT id, min(root) AS root FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id, coalesce(n.root, c.class_id, d.doc_id) AS component_id, coalesce(n.root, c.class_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN joined j USING (doc_id) LEFT JOIN classes c USING (t) LEFT JOIN named n ON n.id = c.class_id
"""
