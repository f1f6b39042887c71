"""Exact top-k inner-product search over a bit-sliced index.

Every quantised attribute (vector component) of a group of rows is held as bit slices, one bitmap
of rows for each binary digit.  A query weighs the attributes: the slices that its weights' binary
digits select are added by carry-save adders made of AND, OR and XOR over 64-bit words, which leaves
one bitmap for each binary digit of the score.  The top rows are taken from the most significant
score slice downward; once the rows at the boundary are few, or no slice is left, they are resolved
exactly, by the integer inner product and the smaller id.

Rows are dealt to groups by a hash of the id, about ``GROUP_ROWS`` in each, and every group has a partition of its own.  Queries are
laid together in blocks of about ``QUERY_BLOCK`` vectors, as narrow integers, and every block goes to every group
in a stream, so a task holds one group's slices and one block at a time.  The groups' best k meet
in a window that Spark limits before its shuffle.  Work is queries times rows, as it must be where every query asks all rows exactly; what is shuffled is
the query blocks times the groups, a ``GROUP_ROWS``-th of that.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part, nor
do rows with a null id, nor vectors whose length times the square of their largest component is 2**62 or more (below it, no product of two
vectors can leave 64 bits); vectors of other lengths than the query's are not compared; of rows with the
same id the smallest vector counts; fewer than k candidates give fewer rows; an empty table gives none; further columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import partitions_for, prepare, stored

GROUP_ROWS = 16_384
#: Queries that are shuffled as one row.
QUERY_BLOCK = 256
#: Boundary rows that are scored one by one instead of going through the remaining slices.
RESOLVE = 64

OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def usable(v: Column) -> Column:
    """Whether a vector is there, not empty, and finite throughout."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & ~bad, F.lit(False))


class SlicedGroup:
    """Bit slices of a group of integer vectors; ids ascend."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        self.ids, self.rows, self.n = ids, rows, len(ids)
        self.low = rows.min(axis=0)
        above = (rows - self.low).astype(np.uint64)
        self.width = [int(x).bit_length() for x in above.max(axis=0)]
        words = (self.n + 63) // 64
        self.first = np.concatenate([[0], np.cumsum(self.width)]).astype(np.int64)
        self.slices = np.zeros((int(self.first[-1]), words), np.uint64)
        for d, bits in enumerate(self.width):
            for b in range(bits):
                self.slices[self.first[d] + b] = self._bitmap((above[:, d] >> np.uint64(b)) & np.uint64(1))
        self.all = self._bitmap(np.ones(self.n, np.uint8))

    def _bitmap(self, bits: np.ndarray) -> np.ndarray:
        packed = np.packbits(bits.astype(np.uint8), bitorder="little")
        return np.pad(packed, (0, -len(packed) % 8)).view(np.uint64)

    def score_slices(self, query: np.ndarray) -> list[np.ndarray]:
        """Bitmaps of the digits of each row's score less a constant of the query, lowest first."""
        plain: dict[int, list[int]] = {}
        turned: dict[int, list[int]] = {}
        for d, q in enumerate(query.tolist()):
            at, size = int(self.first[d]), abs(q)
            for c in range(size.bit_length()):
                if size >> c & 1:
                    for b in range(self.width[d]):
                        (plain if q > 0 else turned).setdefault(b + c, []).append(at + b)
        out: list[np.ndarray] = []
        carried: list[np.ndarray] = []
        weight, top = 0, max([*plain, *turned, -1])
        while weight <= top or carried:
            parts = [self.slices[plain[weight]]] if weight in plain else []
            if weight in turned:
                parts.append(~self.slices[turned[weight]])
            parts += carried
            carried = []
            column = np.concatenate(parts) if parts else np.zeros((1, self.slices.shape[1]), np.uint64)
            while len(column) > 1:
                third = len(column) // 3
                if third:
                    a, b, c = column[:third], column[third : 2 * third], column[2 * third : 3 * third]
                    half = a ^ b
                    carried.append((a & b) | (c & half))
                    column = np.concatenate([half ^ c, column[3 * third :]])
                else:
                    carried.append((column[:1] & column[1:]))
                    column = column[:1] ^ column[1:]
            out.append(column[0])
            weight += 1
        return out

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows but the query's own, best first, ties to smaller ids."""
        boundary = self.all.copy()
        own = int(np.searchsorted(self.ids, query_id))
        if own < self.n and self.ids[own] == query_id:
            boundary[own // 64] &= ~(np.uint64(1) << np.uint64(own % 64))
        sure = np.zeros_like(boundary)
        n_sure, n_boundary = 0, int(np.bitwise_count(boundary).sum())
        if n_boundary > RESOLVE:
            for digit in reversed(self.score_slices(query)):
                with_digit = boundary & digit
                n = int(np.bitwise_count(with_digit).sum())
                if n_sure + n >= k:
                    boundary, n_boundary = with_digit, n
                else:
                    sure |= with_digit
                    n_sure += n
                    boundary = boundary & ~digit
                    n_boundary -= n
                if n_boundary <= RESOLVE or n_sure == k:
                    break
        near = self._places(sure)
        edge = self._places(boundary)
        if len(edge) > RESOLVE:  # all digits were used: these rows tie, and ids ascend
            edge = edge[: max(0, k - n_sure)]
        found = np.concatenate([near, edge])
        scores = self.rows[found] @ query
        best = np.lexsort((self.ids[found], -scores))[:k]
        return self.ids[found[best]], scores[best]

    def _places(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little", count=self.n))


BLOCKS = pa.schema([("dim", pa.int32()), ("ids", pa.binary()), ("kind", pa.string()), ("rows", pa.binary())])


def integers(column: pa.ListArray, dim: int) -> np.ndarray:
    """Vectors of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def narrowed(rows: np.ndarray) -> np.ndarray:
    for kind in ("<i2", "<i4"):
        if not len(rows) or (np.iinfo(kind).min <= rows.min() and rows.max() <= np.iinfo(kind).max):
            return rows.astype(kind)
    return rows.astype("<i8")


def _blocks(size: int):
    """Rows (dim, vec_id, v) to blocks of vectors of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def block(dim: int) -> pa.RecordBatch:
            ids, rows = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
            narrow = narrowed(rows)
            return pa.record_batch([pa.array([dim], pa.int32()), pa.array([ids.astype("<i8").tobytes()]), pa.array([narrow.dtype.str]), pa.array([narrow.tobytes()])], schema=BLOCKS)

        for batch in batches:
            dims = batch.column(0).to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                held.setdefault(dim, []).append((part.column(1).to_numpy(), integers(part.column(2), dim)))
                if sum(len(ids) for ids, _ in held[dim]) >= size:
                    yield block(dim)
        for dim in list(held):
            yield block(dim)

    return run


def _search(k: int):
    """Rows of (g, dim): first its members' blocks, then the queries'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members, group = None, [], None
        for batch in batches:
            for g, dim, query, raw_ids, kind, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (g, dim) != now:
                    now, members, group = (g, dim), [], None
                ids, rows = np.frombuffer(raw_ids, "<i8"), np.frombuffer(raw, kind).reshape(-1, dim)
                if not query:
                    members.append((ids, rows))
                    continue
                if group is None:
                    if not members:
                        continue
                    ids_held, rows_held = (np.concatenate(x) for x in zip(*members, strict=True))
                    order = np.argsort(ids_held, kind="stable")
                    group, members = SlicedGroup(ids_held[order], rows_held[order].astype(np.int64)), []
                found: list[tuple] = []
                for vec_id, vector in zip(ids.tolist(), rows.astype(np.int64), strict=True):
                    got, scores = group.top(vec_id, vector, k)
                    found += zip([vec_id] * len(got), got.tolist(), scores.tolist(), strict=True)
                if found:
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], schema=OUT)

    return run


def top_k_search(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k rows of ``vectors`` with the highest integer inner product for each row of ``queries``.

    Both have (vec_id long, v array<long>).  Returns (query_id, rank, vec_id, score).
    """
    spark = vectors.sparkSession
    prepare(spark)

    def once(rows: DataFrame) -> DataFrame:
        high = F.greatest(F.abs(F.array_max("v").cast("double")), F.abs(F.array_min("v").cast("double")))
        fits = F.col("vec_id").isNotNull() & (F.size("v") * high * high < 2.0**62)
        return rows.where(fits).groupBy("vec_id").agg(F.min("v").alias("v")).select(F.size("v").alias("dim"), "vec_id", "v")

    rows = stored(once(vectors), "bsi")
    groups = partitions_for(rows.count(), GROUP_ROWS)
    kinds = "dim int, ids binary, kind string, rows binary"
    # A group's rows first meet in its partition, then go as one block or a few to where the queries come.
    dealt = rows.withColumn("g", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")).repartitionById(groups, "g").select("dim", "vec_id", "v")
    members = stored(dealt.mapInArrow(_blocks(GROUP_ROWS), kinds).withColumn("g", F.spark_partition_id()), "bsi-groups").select("g", "dim", F.lit(False).alias("q"), "ids", "kind", "rows")
    asked = stored(once(queries).select("dim", "vec_id", "v").mapInArrow(_blocks(QUERY_BLOCK), kinds), "bsi-queries")
    probes = asked.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), "dim", F.lit(True).alias("q"), "ids", "kind", "rows")
    met = members.union(probes).repartitionById(groups, "g").sortWithinPartitions("g", "dim", "q")
    best = met.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantised(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v): each component x of a usable vector as floor(scale * x), x taken as double."""
    v = F.col("embedding")
    return embeddings.where(usable(v)).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")).alias("v"))
