"""Toxicity by maximum-scoring segments of token log-odds.

Each word has the log-odds of toxic against clean training texts, by the number of distinct texts that hold it, under an
informative Dirichlet prior (the words' overall frequencies, of a weight of ``PRIOR`` times the training counts); an unknown word stands for its longest known beginning
of ``BEGINNINGS`` letters; words whose log-odds are within ``Z`` standard errors of nothing score nothing, the others score their log-odds, above or below nothing,
and every word pays ``TOLL``, so that the expected score of clean text is negative.  A linear-time scan finds all maximal
scoring segments of a text.  By the extreme-value law a segment of score S in a text of n words is expected K n exp(-lambda S) times
by chance; lambda and K are fitted by maximum likelihood to the best segments of clean training texts held aside from the counts.  Every
segment with less than ``EXPECTED`` expected occurrences is significant.  A text's evidence is the sum of
lambda S - log(K n) over its significant segments; a logistic fit of its logarithm on the texts held aside gives the score.

A passage that many toxic texts share would make its words look toxic.  So a word's toxic texts count only as far as the words
beside it differ, on the side where they differ more: the neighbours are dealt to ``CELLS`` cells, and the number of filled cells says how many differ. At a text's end,
the text itself is the neighbour.

Counts come from a sample of about ``SAMPLE_DOCS`` labelled training documents of each class, drawn by a hash of the id; equal texts count once.
One in ``ASIDE`` is held aside; where that leaves fewer than ``ASIDE_LEAST`` of a class, all texts serve for both.
All words that are significant in the sample are kept, as many as there are.

Defined cases: null, empty and word-less texts, and all texts without a significant segment, score at most ``NO_EVIDENCE``; with one
class or none in training, every text scores 0; rows without a label teach nothing; of repeated labels the largest counts; a repeated doc_id's rows are texts of their own.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import drawn, held_out, prepare, stored, sweeping
from brindle.llm.words import cut_words, in_parts

SAMPLE_DOCS = 5000
PRIOR = 0.1
Z = 3.0
TOLL = 0.5
EXPECTED = 0.05
BEGINNINGS = (7, 6, 5, 4)
CACHE_WORDS = 400_000
#: Cells that tell a word's neighbours apart, one bit each.
CELLS = 63
ASIDE, ASIDE_LEAST = 4, 30
#: The most that a text without evidence scores.
NO_EVIDENCE = 0.25


def maximal_segments(places: list[int], before: list[float], after: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments, in linear time: (first place, last place, score).

    places: ascending positions of the words that score above nothing; before, after: the sum of all words' scores up to such a word, without it and with it.
    """
    out: list[list] = []  # first, last, sum before, sum after, the nearest earlier segment with a smaller sum before
    for at, low, total in zip(places, before, after, strict=True):
        first = at
        j = len(out) - 1
        while True:
            while j >= 0 and out[j][2] >= low:
                j = out[j][4]
            if j < 0 or out[j][3] >= total:
                out.append([first, at, low, total, j])
                break
            first, low, next_j = out[j][0], out[j][2], out[j][4]
            del out[j:]
            j = next_j
    return [(a, b, high - low) for a, b, low, high, _ in out]


class SegmentModel:
    def __init__(self, scores: dict[str, float], rate: float = 1.0, log_k: float = 0.0, slope: float = 1.0, base: float = -2.0, known: bool = True) -> None:
        self.scores, self.rate, self.log_k, self.slope, self.base, self.known = scores, rate, log_k, slope, base, known
        self.memo: dict[str, float] = {}

    def word_score(self, word: str) -> float:
        found = self.scores.get(word)
        if found is None:
            found = next((s for k in BEGINNINGS if len(word) > k and (s := self.scores.get("^" + word[:k])) is not None), 0.0)
        return found

    def segments(self, texts: list[str | None]) -> list[tuple[int, list[tuple[int, int, float]]]]:
        """Each text's number of words and its maximal segments (first word, last word, score)."""
        if len(self.memo) > CACHE_WORDS:
            self.memo = {}
        memo, cut = self.memo, cut_words(texts)
        scores = list(map(memo.get, cut.words))
        for i, s in enumerate(scores):
            if s is None:
                scores[i] = memo[cut.words[i]] = self.word_score(cut.words[i])
        net = np.asarray(scores, float)[cut.places] - TOLL if len(cut.places) else np.empty(0)
        hits = np.flatnonzero(net > 0)
        of_text = np.searchsorted(hits, cut.bounds)
        out = []
        for a, b, i, j in zip(cut.bounds[:-1].tolist(), cut.bounds[1:].tolist(), of_text[:-1].tolist(), of_text[1:].tolist(), strict=True):
            found = []
            if j > i:
                at = hits[i:j] - a
                total = np.concatenate([[0.0], np.cumsum(net[a:b])])
                found = maximal_segments(at.tolist(), total[at].tolist(), total[at + 1].tolist())
            out.append((b - a, found))
        return out

    def significant(self, texts: list[str | None]) -> list[list[tuple[int, int, float, float]]]:
        """(first word, last word, score, evidence) of each text's significant segments."""
        out = []
        for n, found in self.segments(texts):
            floor = math.log(max(n, 1)) + self.log_k
            rows = [(a, b, s, self.rate * s - floor) for a, b, s in found]
            out.append([r for r in rows if r[3] > -math.log(EXPECTED)])
        return out

    def score(self, texts: list[str | None]) -> list[float]:
        if not self.known:
            return [0.0] * len(texts)
        evidence = [math.log1p(sum(r[3] for r in rows)) for rows in self.significant(texts)]
        scores = [1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, self.base + self.slope * x)))) for x in evidence]
        return [s if x > 0 else min(s, NO_EVIDENCE) for s, x in zip(scores, evidence, strict=True)]


def log_odds(toxic: Column, clean: Column, all_toxic: float, all_clean: float) -> tuple[Column, Column]:
    """A word's log-odds under the Dirichlet prior, and its standard score."""
    prior, all_prior = (toxic + clean) * PRIOR, (all_toxic + all_clean) * PRIOR
    t, c = toxic + prior, clean + prior
    odds = F.log(t / (F.lit(all_toxic + all_prior) - t)) - F.log(c / (F.lit(all_clean + all_prior) - c))
    return odds, odds / F.sqrt(1 / t + 1 / c)


def extreme_value_fit(words: np.ndarray, tops: np.ndarray, guess: float) -> tuple[float, float]:
    """lambda and log K of the law by which a text of n words has a best segment of at most S with a chance of exp(-K n exp(-lambda S)).

    Maximum likelihood; a text without any segment tells only that its best is at most nothing.  guess: lambda, if no text has a segment.
    """
    found = tops > 0
    n_found, whole = int(found.sum()), float(words.sum())
    if not n_found:
        return guess, -math.log(whole + 1)

    def held(rate: float) -> float:
        return float((words * np.exp(-rate * tops)).sum())

    def likelihood(rate: float) -> float:
        return n_found * (math.log(rate) - math.log(held(rate))) - rate * float(tops.sum())

    low, high = guess / 20, guess * 20
    for _ in range(6):  # ever finer grids around the best rate
        grid = np.geomspace(low, high, 41)
        best = int(np.argmax([likelihood(x) for x in grid]))
        low, high = grid[max(0, best - 1)], grid[min(40, best + 1)]
    rate = float(grid[best])
    return rate, math.log(n_found / held(rate))


def chance_rate(shares: np.ndarray, scores: np.ndarray) -> float:
    """The positive root of sum p exp(rate (s - TOLL)) = 1, all other words scoring -TOLL."""
    rest = max(0.0, 1.0 - shares.sum())

    def value(x: float) -> float:
        return float(shares @ np.exp(np.minimum(x * (scores - TOLL), 600))) + rest * math.exp(-x * TOLL) - 1

    low, high = 1e-6, 1e-3
    while value(high) < 0 and high < 50:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return high


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, Counter] = {0: Counter(), 1: Counter()}
    lefts: dict[str, int] = {}
    rights: dict[str, int] = {}
    for batch in batches:
        labels, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for label in (0, 1):
            for part in in_parts([t for y, t in zip(labels, texts, strict=True) if y == label]):
                cut = cut_words(part)
                hashes = [zlib.crc32(w.encode()) for w in cut.words] if label else []
                for a, b in zip(cut.bounds[:-1].tolist(), cut.bounds[1:].tolist(), strict=True):
                    places, first = np.unique(cut.places[a:b], return_index=True)
                    items: dict[str, int] = {}
                    for place, at in zip(places.tolist(), first.tolist(), strict=True):
                        word = cut.words[place]
                        for item in (word, *("^" + word[:k] for k in BEGINNINGS if len(word) > k)):
                            items.setdefault(item, at)
                    found[label].update(items.keys())
                    if label:
                        own = [hashes[p] % CELLS for p in cut.places[a:b].tolist()]
                        start, end = (hashes[cut.places[b - 1]] + b - a) % CELLS if own else 0, (hashes[cut.places[a]] + b - a) % CELLS if own else 0
                        beside = [start, *own, end]
                        for item, at in items.items():
                            lefts[item] = lefts.get(item, 0) | 1 << beside[at]
                            rights[item] = rights.get(item, 0) | 1 << beside[at + 2]
    rows = [(w, found[1][w], found[0][w], lefts.get(w, 0), rights.get(w, 0)) for w in found[0].keys() | found[1].keys()]
    for i in range(0, len(rows), 20_000):
        part = list(zip(*rows[i : i + 20_000], strict=True))
        yield pa.record_batch([pa.array(part[0]), *(pa.array(x, pa.int64()) for x in part[1:])], ["word", "toxic", "clean", "lefts", "rights"])


def differing(count: Column, *sides: Column) -> Column:
    """A count as far as neighbours differ on the side where they differ more: by the number of filled cells (linear counting), never more than the count."""
    filled = F.greatest(*(F.bit_count(x) for x in sides))
    spread = F.lit(float(-CELLS)) * F.log(1 - F.least(filled, F.lit(CELLS - 1)) / F.lit(float(CELLS)))
    return F.when(filled >= CELLS - 3, count.cast("double")).otherwise(F.least(count.cast("double"), spread))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, training: Column, per_class: int) -> DataFrame | None:
    """(y, text) of about per_class training documents of each class; None without both classes."""
    marked = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).where(training)
    sizes = {r.y: r.n for r in marked.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return None
    share = F.when(F.col("y") == 1, min(1.0, per_class / sizes[1])).otherwise(min(1.0, per_class / sizes[0]))
    picked = marked.where(drawn(F.col("doc_id"), share, 5))
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("y", F.col("text").cast("string")).dropDuplicates()  # about 2 * per_class rows


def fit(docs: DataFrame, labels: DataFrame, training: Column) -> SegmentModel:
    with sweeping(docs.sparkSession):
        return _fitted(docs, labels, training)


def _fitted(docs: DataFrame, labels: DataFrame, training: Column) -> SegmentModel:
    sample = labelled_sample(docs, labels, "toxic", training, SAMPLE_DOCS)
    if sample is None:
        return SegmentModel({}, known=False)
    sample = stored(sample.withColumn("aside", F.pmod(F.xxhash64("text", F.lit(9)), F.lit(ASIDE)) == 0), "labelled")
    aside = {r.y: r.n for r in sample.where("aside").groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    apart = min(aside.get(0, 0), aside.get(1, 0)) >= ASIDE_LEAST
    counted = (sample.where("NOT aside") if apart else sample).select("y", "text").mapInArrow(_count, "word string, toxic long, clean long, lefts long, rights long")
    counted = counted.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").cast("double").alias("clean"), F.bit_or("lefts").alias("lefts"), F.bit_or("rights").alias("rights"))
    counted = stored(counted.select("word", differing(F.col("toxic"), F.col("lefts"), F.col("rights")).alias("toxic"), "clean"), "word-counts")
    sums = counted.agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).first()
    odds, z = log_odds(F.col("toxic"), F.col("clean"), sums.t or 0.0, sums.c or 0.0)
    # Each of these words is in many texts of the sample, or it would not stand out: the sample bounds their number.
    rows = counted.select("word", "clean", odds.alias("odds"), z.alias("z")).where(F.abs("z") > Z).orderBy("word").collect()
    if not any(r.odds > TOLL for r in rows):
        return SegmentModel({}, known=False)
    scores = {r.word: r.odds for r in rows}
    guess = chance_rate((np.array([r.clean for r in rows]) + 0.5) / ((sums.c or 0.0) + 1), np.array([r.odds for r in rows]))
    model = SegmentModel(scores)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for part in in_parts(batch.column(1).to_pylist()) for x in sent.value.segments(part)]
            yield pa.record_batch([batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([[s for *_, s in rows] for _, rows in found], pa.list_(pa.float64()))], ["y", "n", "scores"])

    tried = (sample.where("aside") if apart else sample).select("y", "text")
    seen = tried.mapInArrow(best, "y int, n long, scores array<double>").collect()  # the sample, without texts
    seen.sort(key=lambda r: (r.y, r.n, r.scores))
    clean = [r for r in seen if r.y == 0 and r.n]
    model.rate, model.log_k = extreme_value_fit(np.array([r.n for r in clean], float), np.array([max(r.scores, default=0.0) for r in clean]), guess)
    x = np.log1p([sum(e for s in r.scores if (e := model.rate * s - math.log(max(r.n, 1)) - model.log_k) > -math.log(EXPECTED)) for r in seen])
    model.slope, model.base = _logistic(x, np.array([r.y for r in seen], float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and base of a lightly penalised logistic fit, by Newton's steps."""
    scale = max(1e-9, float(np.abs(x).max(initial=0.0)))
    design = np.column_stack([x / scale, np.ones(len(x))])
    w, penalty = np.zeros(2), np.diag([1e-3, 1e-3])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        h = design.T @ (design * (p * (1 - p) + 1e-9)[:, None]) + penalty
        step = np.linalg.solve(h, design.T @ (y - p) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 0.0) / scale), float(w[1])


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            scores = [x for part in in_parts(batch.column(2).to_pylist()) for x in m.score(part)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])

    return run


def score_documents(docs: DataFrame, model: SegmentModel, held: Column) -> DataFrame:
    """(doc_id, held_out, score) for every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    prepare(spark)
    sent = spark.sparkContext.broadcast(model)  # bounded by SAMPLE_DOCS
    return docs.select(F.col("doc_id").cast("long"), held.alias("held_out"), F.col("text").cast("string")).mapInArrow(_score(sent), "doc_id long, held_out boolean, score double")


def predicted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    prepare(docs.sparkSession)
    held = held_out(F.col("doc_id"), 4, 2)
    model = fit(docs, labels, ~held)
    return score_documents(docs, model, held).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
