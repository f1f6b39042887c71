"""Language identification by word-first backoff.

Known words are scored by their log frequency in each language.  An unseen word falls back to its longest known
character n-grams: at each place of the word the longest n-gram (``LONGEST`` down to one character) that the
model knows speaks, each step down being discounted.  Counts come from a sample of the training rows of about ``SAMPLE_DOCS`` documents a
language, drawn by a hash of the id (where it is null, of the text); the tables keep the ``MOST_WORDS`` and ``MOST_GRAMS`` most frequent entries that are found
``LEAST`` times or more, which bounds what is broadcast (all are parameters of ``fit``, None standing for all entries).  Every whole text is scored,
and a word of any length is walked to its end, in training and in scoring: without spaces it can be a whole text.

Defined cases: a text that is null or has no letter is `und` with score 0, as is every text when nothing could be
learnt; a null doc_id counts as not held out; rows with a null lang teach nothing, each value of lang is a language; ties go to the lesser language name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import drawn, held_out, prepare, stored, sweeping
from brindle.llm.words import cut_words, in_parts, sums_of

SAMPLE_DOCS = 2000
MOST_WORDS = 60_000
MOST_GRAMS = 60_000
LEAST = 2
LONGEST = 5
BACKOFF = 0.4
#: Words whose evidence counts in full in the score; more words share it, as they are not independent.
EVIDENCE_WORDS = 20
CACHE_WORDS = 300_000
#: Places of a long word that are scored together.
PIECE = 10_000

def grams_of(word: str) -> Iterator[str]:
    held = f"\x02{word}\x03"
    for n in range(1, LONGEST + 1):
        for i in range(len(held) - n + 1):
            yield held[i : i + n]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: dict[str, Counter] = {}
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang in sorted(set(langs)):
            for part in in_parts([t for own, t in zip(langs, texts, strict=True) if own == lang]):
                cut = cut_words(part)
                times = np.bincount(cut.places, minlength=len(cut.words))
                words.setdefault(lang, Counter()).update({w: n for w, n in zip(cut.words, times.tolist(), strict=True) if n})
    for lang, found in words.items():
        grams: Counter = Counter()
        for word, n in found.items():
            for g in grams_of(word):
                grams[g] += n
        for kind, table in (("w", found), ("g", grams)):
            rows = list(table.items())
            for i in range(0, len(rows), 20_000):
                part = rows[i : i + 20_000]
                yield pa.record_batch([pa.array([lang] * len(part)), pa.array([kind] * len(part)), pa.array([r[0] for r in part]), pa.array([r[1] for r in part], pa.int64())], ["lang", "kind", "item", "n"])


class BackoffModel:
    def __init__(self, langs: list[str], words: dict[str, np.ndarray], grams: dict[str, np.ndarray]) -> None:
        """words, grams: from the item, its count in each language."""
        self.langs = langs
        self.words = self._logs(words)
        discounted: dict[str, np.ndarray] = {}
        for n in range(1, LONGEST + 1):
            discounted |= {g: x * BACKOFF ** (LONGEST - n) for g, x in self._logs({g: c for g, c in grams.items() if len(g) == n}).items()}
        self.grams = {g: i for i, g in enumerate(discounted)}
        self.gram_scores = np.array(list(discounted.values())).reshape(len(discounted), len(langs))
        self.memo: dict[str, int] = {}
        self.rows = np.zeros((0, len(langs)))

    def _logs(self, table: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        if not table:
            return {}
        counts = np.array(list(table.values()), float)
        logs = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * len(counts)))
        return dict(zip(table, logs, strict=True))

    def word_scores(self, word: str) -> np.ndarray:
        found = self.words.get(word)
        if found is not None:
            return found
        held, known = f"\x02{word}\x03", self.grams.get
        size, total, n = len(held), np.zeros(len(self.langs)), 0
        for start in range(0, size, PIECE):
            parts = []
            for at in range(start, min(start + PIECE, size)):
                for end in range(min(at + LONGEST, size), at, -1):
                    g = known(held[at:end])
                    if g is not None:
                        parts.append(g)
                        break
            total += self.gram_scores[parts].sum(axis=0)
            n += len(parts)
        return total / max(1, n)

    def _places(self, words: list[str]) -> np.ndarray:
        """Rows of the words' scores; unknown words are scored and remembered."""
        if len(self.memo) > CACHE_WORDS:
            self.memo, self.rows = {}, self.rows[:0]
        memo = self.memo
        places = list(map(memo.get, words))
        fresh = []
        for i, p in enumerate(places):
            if p is None:
                places[i] = memo[words[i]] = len(memo)
                fresh.append(self.word_scores(words[i]))
        if fresh:
            self.rows = np.concatenate([self.rows, np.array(fresh)])
        return np.asarray(places, np.int64)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        cut = cut_words(texts)
        n = np.diff(cut.bounds)
        if not self.langs:
            return [("und", 0.0)] * len(texts)
        rows = self._places(cut.words)[cut.places]
        total = np.column_stack([sums_of(self.rows[rows, i], cut.bounds) for i in range(len(self.langs))])
        total = (total - total.max(axis=1, keepdims=True)) * np.minimum(1.0, EVIDENCE_WORDS / np.maximum(n, 1))[:, None]
        chance = np.exp(total)
        chance /= chance.sum(axis=1, keepdims=True)
        best = np.argmax(chance, axis=1)
        return [(self.langs[b], float(c[b])) if k else ("und", 0.0) for k, b, c in zip(n.tolist(), best.tolist(), chance, strict=True)]


def fit(docs: DataFrame, training: Column, sample_docs: int | None = SAMPLE_DOCS, most_words: int | None = MOST_WORDS, most_grams: int | None = MOST_GRAMS, least: int = LEAST) -> BackoffModel:
    """The model of the training rows with a language; a limit of None takes all documents of a language, or all words or n-grams."""
    known = docs.where(training & F.col("lang").isNotNull())
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a language
    langs = sorted(counts)
    if not langs:
        return BackoffModel([], {}, {})
    if sample_docs is not None:
        share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, sample_docs / counts[lang]))])
        known = known.where(drawn(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.xxhash64("text").cast("string"))), F.element_at(share, F.col("lang")), 3))
    with sweeping(docs.sparkSession):
        counted = known.select("lang", "text").mapInArrow(_count, "lang string, kind string, item string, n long")
        counted = stored(counted.groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")), "language-counts")
        by_item = counted.groupBy("kind", "item").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by")).where(F.col("n") >= least)
        tables = []
        for kind, most in (("w", most_words), ("g", most_grams)):
            top = by_item.where(F.col("kind") == kind).orderBy(F.desc("n"), "item")
            rows = (top if most is None else top.limit(most)).select("item", "by").collect()
            tables.append({r.item: np.array([r.by.get(lang, 0) for lang in langs]) for r in rows})
    return BackoffModel(langs, *tables)


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            got = [x for part in in_parts(batch.column(2).to_pylist()) for x in m.predict(part)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: BackoffModel, held: Column) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    prepare(spark)
    sent = spark.sparkContext.broadcast(model)  # bounded by MOST_WORDS and MOST_GRAMS
    return docs.select(F.col("doc_id").cast("long"), held.alias("held_out"), F.col("text").cast("string")).mapInArrow(_predict(sent), "doc_id long, held_out boolean, lang_pred string, score double")


def predicted(docs: DataFrame) -> DataFrame:
    prepare(docs.sparkSession)
    held = held_out(F.col("doc_id"), 4, 2)
    return identify(docs, fit(docs, ~held), held)
