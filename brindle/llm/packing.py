"""Lexical retrieval packing: windows filled with BM25 neighbours from a sharded inverted index.

Documents are encoded once and written to the shared folder.  Document frequencies of all token ids are counted on the way, over
all documents (one number for each id of the vocabulary, so the driver's share is bounded by the vocabulary).
Documents are then ranged by topic (see ``topics``; the quantiser is fitted on a sample) and, in a topic, by a signature of their token trigrams, which brings copies and close texts
together, and packed shard by shard: a shard is a stretch of about ``SHARD_TOKENS`` tokens of a partition.  Neighbours are sought in
the seed's own shard alone, never in others; a topic that fills several shards is split by signature, and
documents of ``SPREAD_FROM`` tokens or more, which fill windows by themselves, are dealt to the topics' ranges by signature, as long ones of a topic would crowd one task.  In a
shard, each seed document asks the shard's BM25 inverted index for unused neighbours, which follow it
in order of score and greedily fill its window; the document that a window's end cuts goes on in the next
window and is its seed.  So only a shard's last window is short, and it is split into sequences whose
lengths are powers of two: nothing is padded.

Defined cases: a null or empty text is the end id alone; repeated rows are packed as often as they come;
a document longer than a window takes several; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import prepare, shuffle_width, stored
from brindle.llm.tokens import crc32_of, default_path, encoder
from brindle.llm.topics import SAMPLE, SEED, Topics, counted

WINDOW = 4096
SHARD_TOKENS = 2_000_000
SHARD_DOCS = 8192
SPREAD_FROM = 2 * WINDOW
#: Terms of a seed document that ask the index, those of the highest BM25 weight over the whole document: the default of ``pack``; None asks with all.
QUERY_TERMS = 32
#: Tokens that a packing task reads on average at most: a few shards.
TASK_TOKENS = 4 * SHARD_TOKENS
K1, B = 1.2, 0.75

PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
PIECES_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("n", pa.int64()), ("sig", pa.int64()), ("topic", pa.int32())])
#: The topic of rows that are no documents but token ids (as doc_id), with the number of documents of a task that hold them (as n).
COUNT = -1
_MIX = np.uint64(0x9E3779B97F4A7C15)


def signature(ids: np.ndarray) -> int:
    """A hash of the least hash of a document's token trigrams: close texts mostly share it, and long texts, whose least is lower, are spread evenly."""
    x = ids.astype(np.uint64)
    with np.errstate(over="ignore"):
        h = x[:1] if len(x) < 3 else (x[:-2] * np.uint64(0x100000001B3) + x[1:-1]) * np.uint64(0x100000001B3) + x[2:]
        h = (h + _MIX) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        least = (h.min(keepdims=True) + _MIX) * np.uint64(0x94D049BB133111EB)
        least = (least ^ (least >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return int(least[0] >> np.uint64(1))


def _kind(vocabulary: int) -> str:
    """Little-endian ids of two bytes where the vocabulary allows."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def _counted(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(tokenizer)
        for batch in batches:
            found = [counted(ids) for ids in made.encode_documents(batch.column(0).to_pylist())]
            yield pa.record_batch([pa.array([at.astype("<u2").tobytes() for at, _ in found], pa.binary()), pa.array([root.tobytes() for _, root in found], pa.binary())], ["at", "root"])

    return run


def _topics(docs: DataFrame, tokenizer: str) -> Topics:
    """The quantiser, fitted on rows drawn one by one; a row's counts are at most 24 kB, however long its text."""
    share = min(1.0, SAMPLE / max(1, docs.count()))
    rows = docs.sample(share, SEED).select(F.col("text").cast("string")).mapInArrow(_counted(tokenizer), "at binary, root binary").collect()  # about SAMPLE at most
    return Topics([(np.frombuffer(r.at, "<u2").astype(np.int64), np.frombuffer(r.root, np.float32)) for r in rows])


def _encode(tokenizer: str, topics: Topics):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(tokenizer)
        kind, df = _kind(len(made.ends)), np.zeros(len(made.ends), np.int64)
        for batch in batches:
            doc_ids, blobs, ns, sigs, tops = batch.column(0).to_pylist(), [], [], [], []
            for ids in made.encode_documents(batch.column(1).to_pylist()):
                blobs.append(ids.astype(kind).tobytes())
                ns.append(len(ids))
                sigs.append(signature(ids))
                tops.append(topics.of(ids) if len(ids) < SPREAD_FROM else sigs[-1] % len(topics.centres))
                held = np.sort(ids.astype(kind))
                df[held[np.flatnonzero(np.append(True, held[1:] != held[:-1]))]] += 1
            yield pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(blobs, pa.binary()), pa.array(ns, pa.int64()), pa.array(sigs, pa.int64()), pa.array(tops, pa.int32())], schema=ENCODED)
        seen = np.flatnonzero(df)
        yield pa.record_batch([pa.array(seen, pa.int64()), pa.nulls(len(seen), pa.binary()), pa.array(df[seen], pa.int64()), pa.nulls(len(seen), pa.int64()), pa.array(np.full(len(seen), COUNT), pa.int32())], schema=ENCODED)

    return run


class Bm25Shard:
    """An inverted index over one shard's documents."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, average: float, query_terms: int | None = QUERY_TERMS) -> None:
        terms, owners, weights = [], [], []
        self.asks: list[np.ndarray] = []
        for i, ids in enumerate(docs):
            t, tf = np.unique(ids, return_counts=True)
            w = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ids) / average))
            terms.append(t)
            owners.append(np.full(len(t), i, np.int32))
            weights.append(w.astype(np.float32))
            self.asks.append(t[np.argpartition(-w, query_terms)[:query_terms]] if query_terms is not None and len(t) > query_terms else t)
        term, owner, weight = (np.concatenate(x) for x in (terms, owners, weights))
        order = np.argsort(term, kind="stable")
        self.owner, self.weight = owner[order], weight[order]
        at = np.searchsorted(term[order], np.arange(len(idf) + 1))
        self.at = at
        self.unused = np.ones(len(docs), bool)
        self.scores = np.zeros(len(docs), np.float32)

    def neighbours(self, seed: int) -> Iterator[int]:
        """Unused documents that share a term with the seed, best first, ties to the earlier."""
        scores = self.scores
        scores[:] = 0
        for t in self.asks[seed].tolist():
            a, b = self.at[t], self.at[t + 1]
            scores[self.owner[a:b]] += self.weight[a:b]
        scores[~self.unused] = 0
        found, taken = np.flatnonzero(scores > 0), 32
        if len(found) > taken:
            cut = found[np.argpartition(-scores[found], taken)[:taken]]
            yield from cut[np.lexsort((cut, -scores[cut]))].tolist()
            found = found[~np.isin(found, cut)]
        yield from found[np.lexsort((found, -scores[found]))].tolist()


def order_by_retrieval(docs: list[np.ndarray], idf: np.ndarray, average: float, query_terms: int | None = QUERY_TERMS) -> list[int]:
    """The order in which a shard's documents fill consecutive windows."""
    index, out, filled, next_seed = Bm25Shard(docs, idf, average, query_terms), [], 0, 0
    seed = -1
    while len(out) < len(docs):
        if seed < 0:
            while not index.unused[next_seed]:
                next_seed += 1
            seed = next_seed
            index.unused[seed] = False
            out.append(seed)
            filled += len(docs[seed])
        window, cut = filled // WINDOW, -1
        for other in index.neighbours(seed):
            index.unused[other] = False
            out.append(other)
            filled += len(docs[other])
            if filled // WINDOW > window:
                cut = other if filled % WINDOW else -1
                break
        seed = cut
    return out


def cut_into_sequences(order: list[int], keys: list, docs: list[np.ndarray], first_sequence: int) -> tuple[list[tuple], int]:
    """Pieces of documents laid end to end into full windows, the rest into sequences of powers of two."""
    total = sum(len(docs[i]) for i in order)
    sizes = [WINDOW] * (total // WINDOW) + [1 << b for b in range(WINDOW.bit_length() - 2, -1, -1) if total % WINDOW >> b & 1]
    out, s, used = [], 0, 0
    for i in order:
        ids, start = docs[i], 0
        while start < len(ids):
            n = min(sizes[s] - used, len(ids) - start)
            out.append((keys[i], start, n, crc32_of(ids[start : start + n]), len(ids), first_sequence + s, used))
            start += n
            used += n
            if used == sizes[s]:
                s, used = s + 1, 0
    return out, len(sizes)


def _pack(idf: np.ndarray, average: float, query_terms: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sequence, kind = TaskContext.get().partitionId() << 40, _kind(len(idf))
        keys: list = []
        docs: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence, keys, docs, held
            pieces, n = cut_into_sequences(order_by_retrieval(docs, idf, average, query_terms), keys, docs, sequence)
            sequence, keys, docs, held = sequence + n, [], [], 0
            return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*pieces, strict=True)], schema=PIECES)

        for batch in batches:
            for doc_id, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys.append(doc_id)
                docs.append(np.frombuffer(blob, kind).astype("<u4"))
                held += len(docs[-1])
                if held >= SHARD_TOKENS or len(docs) >= SHARD_DOCS:
                    yield flush()
        if docs:
            yield flush()

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, query_terms: int | None = QUERY_TERMS) -> DataFrame:
    """Packs (doc_id, text) into sequences of at most ``WINDOW`` tokens; one row for each piece.

    query_terms: how many of a seed's terms ask the index, the heaviest first; None: all.
    """
    spark = docs.sparkSession
    prepare(spark)
    path = tokenizer or default_path()
    made = stored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_encode(path, _topics(docs, path)), "doc_id long, ids binary, n long, sig long, topic int"), "encoded")
    vocabulary = len(encoder(path).ends)
    counts = made.where(F.col("topic") == COUNT).groupBy(F.col("doc_id").alias("token")).agg(F.sum("n").alias("df")).collect()  # at most the vocabulary
    encoded = made.where(F.col("topic") != COUNT).select("doc_id", "ids", "n", "sig", "topic")
    sums = encoded.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("tokens")).first()
    df = np.zeros(vocabulary)
    for r in counts:
        df[r.token] = r.df
    idf = np.log1p((sums.docs - df + 0.5) / (df + 0.5)).astype(np.float32)
    tokens = sums.tokens or 0
    # Repeated rows are dealt by a number as well: they may be many, and which of them comes first is all the same.
    dealt = encoded.withColumn("tie", F.xxhash64("doc_id")).withColumn("row", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(shuffle_width(spark, tokens, TASK_TOKENS), "topic", "sig", "tie", "row").sortWithinPartitions("topic", "sig", "tie", "doc_id", "ids")
    return dealt.select("doc_id", "ids").mapInArrow(_pack(idf, tokens / max(1, sums.docs) or 1.0, query_terms), PIECES_DDL)
