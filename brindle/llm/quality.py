"""Quality classification by nearest-neighbour voting over latent-semantic vectors.

A text becomes a bag of features: its words, the shapes of its words (letter cases, digits and signs, runs shortened), pairs of neighbouring
shapes, and graded shares of the whole text (distinct words, the commonest word, repeated lines, letters,
capitals, digits, signs, word and line lengths).  Features are hashed to ``FEATURES`` columns, weighed by log frequency and
inverse document frequency, and projected on ``RANK`` latent dimensions, found from a sample of labelled training
documents.  The sample's latent vectors are broadcast (``SAMPLE_DOCS`` a class at most, in expectation); each document's
exact cosines with all of them are computed in blocks, and its ``NEIGHBOURS`` nearest vote with weights that grow with
similarity and even out the classes' sizes in the sample.  Every word is read whole, whatever its length.

Defined cases: null, empty and word-less texts have features of their own (no words) and are scored like the rest; a text like none of the labelled scores 0.5;
with one class or none in training every text scores 0.5; rows without a label teach nothing; of
repeated labels the largest counts; equal texts of a class count once in the sample.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import held_out, prepare
from brindle.llm.toxicity import labelled_sample

SAMPLE_DOCS = 1500
FEATURES = 4096
RANK = 64
#: Weights of a word's and a shape pair's log frequency beside that of a shape.
WORD, PAIR = 0.25, 0.5
NEIGHBOURS = 25
SHARPNESS = 8
CACHE_WORDS = 300_000

_RUN = re.compile(r"(.)\1+")


def shape(word: str) -> str:
    """The word with A for capitals, a for other letters, 9 for digits, runs of a sign shortened to one."""
    s = "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in word)
    return _RUN.sub(r"\1", s)


def _column(feature: str) -> int:
    return zlib.crc32(feature.encode()) % FEATURES


def _graded(name: str, value: float, steps: int) -> list[tuple[int, float]]:
    """A share between 0 and 1 as two neighbouring grades, so that near values have near features."""
    x = min(max(value, 0.0), 1.0) * steps
    low = int(x)
    return [(_column(f"{name}:{low}"), 1 - (x - low)), (_column(f"{name}:{low + 1}"), x - low)]


class Features:
    def __init__(self) -> None:
        self.memo: dict[str, tuple[str, int]] = {}
        self.pairs: dict[tuple[str, str], int] = {}

    def of(self, text: str | None) -> dict[int, float]:
        text = text or ""
        words = text.split()
        n = len(words)
        if not n:
            return {_column("no words"): 3.0}
        if len(self.memo) + len(self.pairs) > CACHE_WORDS:
            self.memo, self.pairs = {}, {}
        memo, known, counts = self.memo, self.pairs, Counter(words)
        for w in counts:
            if w not in memo:
                memo[w] = (shape(w), _column("word " + w))
        out: dict[int, float] = {}
        for w, k in counts.items():
            c = memo[w][1]
            out[c] = out.get(c, 0.0) + WORD * log1p(20.0 * k / n)
        shapes = [memo[w][0] for w in words]
        for s, k in Counter(shapes).items():
            c = _column(s)
            out[c] = out.get(c, 0.0) + log1p(20.0 * k / n)
        for pair, k in Counter(zip(shapes, shapes[1:])).items():  # noqa: B905 (the second is shorter by one)
            c = known.get(pair)
            if c is None:
                c = known[pair] = _column(f"pair {pair[0]} {pair[1]}")
            out[c] = out.get(c, 0.0) + PAIR * log1p(20.0 * k / n)
        lines = text.split("\n")
        letters = sum(map(str.isalpha, text))
        size = len(text)
        graded = _graded("distinct", len(counts) / n, 10)
        graded += _graded("common", max(counts.values()) / n, 10)
        graded += _graded("lines", len(set(lines)) / len(lines), 5)
        graded += _graded("letters", letters / size, 20)
        graded += _graded("capitals", sum(map(str.isupper, text)) / max(1, letters), 10)
        graded += _graded("digits", sum(map(str.isdigit, text)) / size, 10)
        graded += _graded("word length", size / n / 20, 10)
        graded += _graded("line length", min(1.0, size / len(lines) / 1000), 5)
        graded += _graded("length", float(np.log10(n + 1)) / 5, 10)
        for c, v in graded:
            out[c] = out.get(c, 0.0) + 1.5 * v
        return out


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    made = Features()
    for batch in batches:
        rows = [made.of(t) for t in batch.column(1).to_pylist()]
        yield pa.record_batch([batch.column(0), pa.array([list(r) for r in rows], pa.list_(pa.int32())), pa.array([list(r.values()) for r in rows], pa.list_(pa.float32()))], ["y", "columns", "weights"])


class LatentVotes:
    """Projection to the latent space, and the labelled vectors in it."""

    def __init__(self, columns: list, weights: list, labels: np.ndarray) -> None:
        x = np.zeros((len(labels), FEATURES), np.float32)
        for i, (c, w) in enumerate(zip(columns, weights, strict=True)):
            x[i, c] = w
        df = (x > 0).sum(axis=0)
        self.idf = np.log((len(labels) + 1) / (df + 1)).astype(np.float32) + 0.5
        x *= self.idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        self.projection = self._leading(x)
        self.points = self._unit(x @ self.projection)
        self.labels = labels.astype(np.float32)
        share = np.bincount(labels, minlength=2) / max(1, len(labels))
        self.balance = np.where(labels == 1, 1 / max(share[1], 1e-9), 1 / max(share[0], 1e-9)).astype(np.float32)

    @staticmethod
    def _leading(x: np.ndarray, rounds: int = 8) -> np.ndarray:
        """The leading right singular vectors, by subspace iteration from a seeded start."""
        rank = min(RANK, *x.shape)
        basis = np.random.default_rng(1).normal(size=(x.shape[1], min(rank + 16, x.shape[1]))).astype(np.float32)
        for _ in range(rounds):
            basis, _ = np.linalg.qr(x.T @ (x @ basis))
        _, _, turn = np.linalg.svd(x @ basis, full_matrices=False)
        return np.ascontiguousarray((basis @ turn.T)[:, :rank])

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)).astype(np.float32)

    def votes(self, rows: list[dict[int, float]]) -> np.ndarray:
        """Scores of a block of documents: exact cosines with every labelled vector."""
        x = np.zeros((len(rows), FEATURES), np.float32)
        for i, r in enumerate(rows):
            x[i, list(r)] = list(r.values())
        near = self._unit((x * self.idf) @ self.projection) @ self.points.T
        k = min(NEIGHBOURS, near.shape[1])
        at = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, at, axis=1), 1e-3) ** SHARPNESS * self.balance[at]
        return np.where(near.max(axis=1) > 1e-3, (weight * self.labels[at]).sum(axis=1) / weight.sum(axis=1), 0.5)


def fit(docs: DataFrame, labels: DataFrame, training: Column) -> LatentVotes | None:
    """The model, or None without labelled documents of both classes."""
    sample = labelled_sample(docs, labels, "quality", training, SAMPLE_DOCS)
    rows = sample.mapInArrow(_sample_features, "y int, columns array<int>, weights array<float>").collect() if sample is not None else []
    rows.sort(key=lambda r: (r.y, r.columns, r.weights))
    if len({r.y for r in rows}) < 2:
        return None
    return LatentVotes([r.columns for r in rows], [r.weights for r in rows], np.array([r.y for r in rows]))


BLOCK = 256


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, made = model.value, Features()
        for batch in batches:
            texts = batch.column(2).to_pylist()
            scores: list = []
            for i in range(0, len(texts), BLOCK):
                part = texts[i : i + BLOCK]
                scores += [0.5] * len(part) if m is None else m.votes([made.of(t) for t in part]).astype(float).tolist()
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])

    return run


def score_documents(docs: DataFrame, model: LatentVotes | None, held: Column) -> DataFrame:
    """(doc_id, held_out, score) for every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    prepare(spark)
    sent = spark.sparkContext.broadcast(model)  # bounded by SAMPLE_DOCS, FEATURES and RANK
    return docs.select(F.col("doc_id").cast("long"), held.alias("held_out"), F.col("text").cast("string")).mapInArrow(_score(sent), "doc_id long, held_out boolean, score double")


def predicted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    prepare(docs.sparkSession)
    held = held_out(F.col("doc_id"), 3, 1)
    model = fit(docs, labels, ~held)
    return score_documents(docs, model, held).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier accepts, all columns kept; the text is scored in the same pass."""
    prepare(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, ~held_out(F.col("doc_id"), 3, 1)))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, made = model.value, Features()
        for batch in batches:
            texts = batch.column(at).to_pylist()
            good: list = []
            for i in range(0, len(texts), BLOCK):
                part = texts[i : i + BLOCK]
                good += [True] * len(part) if m is None else (m.votes([made.of(t) for t in part]) >= 0.5).tolist()
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
