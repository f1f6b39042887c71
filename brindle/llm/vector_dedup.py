"""Near-duplicate vectors by product quantisation over coarse inverted lists.

Vectors of one label are compared by cosine.  Equal vectors are collapsed first and counted.  A coarse k-means
and residual product codes are fitted on a sample of about ``SAMPLE`` unit vectors; every vector is indexed: its home list is that of
its nearest centroid, and it keeps the codes of its residual's subspaces and the length of what the codes miss.

As a query, a vector probes every list that may hold a partner.  A partner lies within r = sqrt(2 - 2 * threshold), and to be in
another list it must lie beyond the bisector of the two centroids; a list is left out only if the query is further than r from
that bisector, which loses nothing.  Of two lists the query goes from the lesser to the greater alone, and each link found there counts at both ends.
Inside a list, distances to the codes come from lookup tables (asymmetric: the query isn't coded); a
pair is left out only if that distance less what the member's code misses is over r, a bound that loses nothing.
What remains is reranked by the exact cosine in double precision.

Small lists of a label are put on shelves of about ``SHELF`` members, so that a query goes once to all of a shelf's lists that it probes.
Lists with more than ``BLOCK`` members are split by a hash of the id and queries go to each part, so a task holds one shelf or part and
streams its queries.  A list or part gives each vector's count of links and one edge to the least vector it is connected
with there, never all pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null
label, link with nothing and are components of their own, kept; labels of any type are compared by their text; vectors of different lengths aren't compared; rows that repeat a vec_id count once, as the
least (label, vector); an empty table gives no row; further columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import drawn, prepare, shuffle_width, stored, sweeping
from brindle.llm.components import components
from brindle.llm.topk_bsi import usable

THRESHOLD = 0.93
SAMPLE = 16_384
#: Vectors for each coarse centroid, and the most centroids.
PER_LIST, MOST_LISTS = 2048, 1024
SUBSPACES, CODES = 8, 64
BLOCK = 2048
SHELF = 1024
QUERIES = 256
#: Rows (members, and queries of a shelf or part) that a comparing task streams on average at most.
TASK_ROWS = 200_000
SLACK = 1e-5

FOUND = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(axis=1) - 2 * x @ centres.T, axis=1)


class Quantiser:
    """Coarse centroids and residual codebooks for unit vectors of one length."""

    def __init__(self, sample: np.ndarray, lists: int) -> None:
        sample = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        self.coarse = k_means(sample, lists, 8, 1)
        self.parts = [p for p in np.array_split(np.arange(sample.shape[1]), SUBSPACES) if len(p)]
        rest = sample - self.coarse[nearest(sample, self.coarse)]
        self.books = [k_means(rest[:, p], CODES, 6, 2 + i) for i, p in enumerate(self.parts)]
        c = self.coarse
        self.between = np.sqrt(np.maximum(((c[:, None] - c[None]) ** 2).sum(axis=2) if len(c) <= 256 else np.array([((c - one) ** 2).sum(axis=1) for one in c]), 1e-30))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Home lists, codes, and the lengths that the codes miss, of unit vectors."""
        home = nearest(x, self.coarse)
        rest = x - self.coarse[home]
        codes = np.empty((len(x), len(self.parts)), np.uint8)
        missed = np.zeros(len(x))
        for i, p in enumerate(self.parts):
            codes[:, i] = nearest(rest[:, p], self.books[i])
            missed += ((rest[:, p] - self.books[i][codes[:, i]]) ** 2).sum(axis=1)
        return home, codes, np.sqrt(missed)

    def probes(self, x: np.ndarray, home: np.ndarray, radius: float) -> list[np.ndarray]:
        """Lists, from each x's home on, that can hold a vector within the radius of it."""
        square = (self.coarse * self.coarse).sum(axis=1) - 2 * x @ self.coarse.T
        over = (square - np.take_along_axis(square, home[:, None], axis=1)) / (2 * self.between[home])
        over[np.arange(len(x)), home] = 0
        return [at + np.flatnonzero(row[at:] <= radius + SLACK) for at, row in zip(home.tolist(), over, strict=True)]

    def distances(self, x: np.ndarray, home: int, codes: np.ndarray) -> np.ndarray:
        """Distances of each x to the coded members of a list, by lookup tables."""
        rest = x - self.coarse[home]
        total = np.zeros((len(x), len(codes)), np.float32)
        for i, p in enumerate(self.parts):
            book = self.books[i]
            table = ((rest[:, p] ** 2).sum(axis=1)[:, None] - 2 * rest[:, p] @ book.T + (book * book).sum(axis=1)).astype(np.float32)
            total += table[:, codes[:, i]]
        return np.sqrt(np.maximum(total, 0))


def vectors_of(column: pa.ListArray) -> list[np.ndarray]:
    flat, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_pylist()
    return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _index(quantisers, radius: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, vectors = np.array(batch.column("dim").to_pylist()), vectors_of(batch.column("v"))
            n = len(dims)
            home, missed = np.zeros(n, np.int64), np.zeros(n)
            code: list = [b""] * n
            lists: list = [[]] * n
            for dim in np.unique(dims).tolist():
                at, q = np.flatnonzero(dims == dim), quantisers.value[dim]
                raw = np.array([vectors[i] for i in at], float)
                unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)
                home[at], codes, missed[at] = q.encode(unit)
                for j, (i, found) in enumerate(zip(at.tolist(), q.probes(unit, home[at], radius), strict=True)):
                    code[i], lists[i] = codes[j].tobytes(), found.tolist()
            more = [pa.array(home), pa.array(lists, pa.list_(pa.int64())), pa.array(code, pa.binary()), pa.array(missed)]
            yield pa.record_batch([*batch.columns, *more], [*batch.schema.names, "home", "lists", "code", "missed"])

    return run


class ListPart:
    """The members of a part of a list, and what its queries have found so far."""

    def __init__(self, quantiser: Quantiser, home: int, reps: list, ms: list, vectors: list, codes: list, missed: list) -> None:
        self.q, self.home = quantiser, home
        self.reps, self.ms = np.array(reps, np.int64), np.array(ms, np.int64)
        self.v = np.array(vectors, float)
        self.unit = self.v / np.linalg.norm(self.v, axis=1, keepdims=True)
        self.codes = np.frombuffer(b"".join(codes), np.uint8).reshape(len(reps), -1)
        self.missed = np.array(missed)
        self.root = self.reps.copy()  # the least vector each member is connected with here
        self.links = np.zeros(len(self.reps), np.int64)  # of each member with vectors of other lists

    def ask(self, reps: np.ndarray, ms: np.ndarray, homes: np.ndarray, vectors: np.ndarray, radius: float, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Each query's number of linked vectors, and a member it is connected with (-1: none); members ask their own list, others' links count here as well."""
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        near = self.q.distances(unit, self.home, self.codes) - self.missed <= radius + 1e-3
        links, member = np.zeros(len(reps), np.int64), np.full(len(reps), -1)
        for i in range(len(reps)):
            at = np.flatnonzero(near[i])
            if len(at):
                at = at[(self.unit[at] @ unit[i] >= threshold) & (self.reps[at] != reps[i])]
            if len(at):
                links[i] = self.ms[at].sum()
                if homes[i] != self.home:
                    self.links[at] += ms[i]
                member[i] = at[0]
                roots = np.unique(self.root[at])
                least = min(int(roots[0]), int(reps[i]))
                if len(roots) > 1 or least != roots[0]:
                    self.root[np.isin(self.root, roots)] = least
        return links, member


def _compare(quantisers, radius: float, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None
        held: dict[int, list] = {}
        parts: dict[int, ListPart] = {}
        waiting: dict[int, list] = {}
        asked: dict[int, list] = {}

        def ask(at: int) -> None:
            reps, ms, homes, vectors = zip(*waiting.pop(at), strict=True)
            links, member = parts[at].ask(np.array(reps, np.int64), np.array(ms, np.int64), np.array(homes, np.int64), np.array(vectors, float), radius, threshold)
            asked.setdefault(at, []).extend(zip(reps, links.tolist(), member.tolist(), strict=True))

        def close() -> Iterator[pa.RecordBatch]:
            for at in list(waiting):
                ask(at)
            for at, part in parts.items():
                rows = [(r, n, int(part.root[i]) if i >= 0 else r) for r, n, i in asked.get(at, []) if n]
                rows += [(r, n, t) for r, n, t in zip(part.reps.tolist(), part.links.tolist(), part.root.tolist(), strict=True) if n or r != t]
                if rows:
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=FOUND)
            held.clear()
            parts.clear()
            asked.clear()

        for batch in batches:
            names = batch.schema.names
            for *key, query, rep, m, v, home, lists, code, missed in zip(*(vectors_of(c) if name == "v" else c.to_pylist() for name, c in zip(names, batch.columns, strict=True)), strict=True):
                if key != now:
                    yield from close()
                    now = key
                if not query:
                    held.setdefault(home, []).append((rep, m, v, code, missed))
                    continue
                if held:
                    parts |= {at: ListPart(quantisers.value[key[1]], at, *zip(*rows, strict=True)) for at, rows in held.items()}
                    held.clear()
                for at in lists:
                    if at in parts:
                        waiting.setdefault(at, []).append((rep, m, home, v))
                        if len(waiting[at]) >= QUERIES:
                            ask(at)
        yield from close()

    return run


def fit(reps: DataFrame, sample: int = SAMPLE) -> dict[int, Quantiser]:
    """Quantisers by vector length, from about ``sample`` vectors."""
    n = reps.count()
    picked = reps.where(drawn(F.col("rep"), sample / max(1, n), 11))
    by_length: dict[int, list] = {}
    lists = int(min(MOST_LISTS, max(1, n // PER_LIST)))
    for r in picked.select("rep", "v").collect():  # about ``sample`` rows
        by_length.setdefault(len(r.v), []).append((r.rep, r.v))
    for r in reps.select(F.size("v").alias("dim"), "rep", "v").groupBy("dim").agg(F.min_by("v", "rep").alias("v")).collect():  # a vector for each length
        by_length.setdefault(r.dim, []).append((-1, r.v))
    return {d: Quantiser(np.array([v for _, v in sorted(rows, key=lambda x: x[0])], float), lists) for d, rows in by_length.items()}


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every vector of embeddings (vec_id, embedding, label)."""
    spark = embeddings.sparkSession
    prepare(spark)
    radius = float(np.sqrt(2 - 2 * threshold))
    row = F.struct(F.col("label").cast("string").alias("label"), F.col("embedding").alias("v"))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), row.alias("r")).groupBy("vec_id").agg(F.min("r").alias("r")).select("vec_id", "r.label", "r.v")
    good = usable(F.col("v")) & F.exists("v", lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    with sweeping(spark) as keep:
        rows = stored(rows.withColumn("good", F.coalesce(good, F.lit(False))), "vectors", keep)
        same = rows.where("good").groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("m"))
        reps = stored(same.select("label", F.size("v").cast("long").alias("dim"), "rep", "m", "v"), "reps")
        quantisers = spark.sparkContext.broadcast(fit(reps, sample))  # bounded by MOST_LISTS and CODES
        element = "float" if dict(reps.dtypes)["v"] == "array<float>" else "double"
        indexed = stored(reps.select("label", "dim", "rep", "m", F.col("v").cast(f"array<{element}>")).mapInArrow(_index(quantisers, radius), f"label string, dim long, rep long, m long, v array<{element}>, home long, lists array<long>, code binary, missed double"), "index")
        held = indexed.groupBy("label", "dim", F.col("home").alias("list")).agg(F.count(F.lit(1)).alias("n"))
        small = F.when(F.col("n") <= BLOCK, F.col("n")).otherwise(0)
        before = F.sum(small).over(Window.partitionBy("label", "dim").orderBy("list")) - small  # at most MOST_LISTS rows a window
        shelf = F.when(F.col("n") <= BLOCK, F.floor(before / SHELF)).otherwise(-1 - F.col("list"))
        shelved = held.select("label", "dim", "list", F.struct(shelf.alias("shelf"), F.ceil(F.col("n") / BLOCK).alias("parts")).alias("at"))
        by_list = shelved.groupBy("label", "dim").agg(F.map_from_entries(F.collect_list(F.struct("list", "at"))).alias("m"), F.max("list").alias("last"))  # at most MOST_LISTS entries
        places = stored(by_list.select("label", "dim", F.transform(F.sequence(F.lit(0).cast("long"), "last"), lambda x: F.col("m")[x]).alias("places")), "places")  # by the list's number, null for a list without members
        at = indexed.join(places, ["label", "dim"])
        place = lambda x: F.get("places", x.cast("int"))
        members = at.select("label", "dim", place(F.col("home"))["shelf"].alias("shelf"), F.pmod(F.xxhash64("rep", F.lit(7)), place(F.col("home"))["parts"]).alias("part"), F.lit(False).alias("query"), "rep", "m", "v", "home", F.array("home").alias("lists"), "code", "missed")
        shelves = F.array_compact(F.array_distinct(F.transform("lists", lambda x: place(x)["shelf"])))
        there = at.withColumn("shelf", F.explode(shelves)).withColumn("lists", F.filter("lists", lambda x: place(x)["shelf"] == F.col("shelf")))
        parts = F.sequence(F.lit(0).cast("long"), place(F.get("lists", F.lit(0)))["parts"] - 1)  # a shelf of several lists has one part
        queries = there.select("label", "dim", "shelf", F.explode(parts).alias("part"), F.lit(True).alias("query"), "rep", "m", "v", "home", "lists", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("double").alias("missed"))
        keys = ["label", "dim", "shelf", "part"]
        asked = shelved.join(indexed.select("label", "dim", F.explode("lists").alias("list")).groupBy("label", "dim", "list").agg(F.count(F.lit(1)).alias("probes")), ["label", "dim", "list"])
        rows_dealt = asked.agg(F.sum(F.col("probes") * F.col("at.parts")).alias("n")).first().n or 0  # at least as many as are dealt
        dealt = members.union(queries).repartition(shuffle_width(spark, rows_dealt, TASK_ROWS), *keys).sortWithinPartitions(*keys, "query", "rep")
        found = stored(dealt.mapInArrow(_compare(quantisers, radius, threshold), "rep long, links long, root long"), "found")
        links = found.groupBy("rep").agg(F.sum("links").alias("links"))
        named = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
        of_rep = stored(reps.select("label", "v", "rep", "m").join(links, "rep", "left").join(named.withColumnRenamed("id", "rep"), "rep", "left").select("label", "v", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "of_rep", keep)
    linked = rows.where("good").join(of_rep, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
  u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS size FROM v),
  links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) >= 0.93 * a.size * b.size),
  reach AS (SELECT a AS id, a AS root FROM links UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.id WHERE r.root < l.b),
  named AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
  degree AS (SELECT a AS id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(root, vec_id) AS component_id, coalesce(root, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN named ON named.id = vec_id LEFT JOIN degree ON degree.id = vec_id
"""
