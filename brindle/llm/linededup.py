"""Line deduplication over levelled sorted runs of line hashes, by DataFrame functions alone.

A store holds runs: tables bucketed and sorted by a 128-bit line hash.  A new batch is grouped to rows of a hash, the number of
documents that hold the line and the largest of their ids, and merge-anti-joined with every
run (which needs no shuffle of the run, as runs lie in the batch's buckets): the lines that it is first to bring
become a run of level 0, so no two runs share a line; those that some run has already are put by as further sightings of it.
``FANOUT`` runs of a level are compacted into one of the next.

``drop_repeated_lines`` feeds a table to a store in batches, adds the sightings to the runs' counts, takes the lines found in enough
documents, and drops those lines from every document but the largest id that holds them.

Defined cases: a null or empty text is one empty line, which is never long enough to be dropped; a null doc_id keeps
all its lines and counts in no run; rows that repeat a doc_id count as one document and are treated alike;
an empty table gives no row; further columns are carried along unless they clash with the result's names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import removed, scratch, shuffle_width, stored, sweeping

MIN_CHARS = 40
MIN_DOCS = 5
BATCHES = 3
FANOUT = 2
#: Long lines for each bucket of the runs, at most.
RUN_ROWS = 2_000_000
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased; other letters keep their case."""
    bare = F.trim(line, F.lit(BLANKS))
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def long_line_hash(line: Column, min_chars: int) -> Column:
    """A 128-bit hash of the key, null for lines whose key is too short.

    xxhash64 seeds each argument's hash with the one before: the constant stands first, so that b isn't made from a.
    """
    key = line_key(line)
    return F.when(F.length(F.trim(line, F.lit(BLANKS))) >= min_chars, F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b")))


class LineRuns:
    """Levelled sorted runs of line hashes in the shared folder."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fanout: int = FANOUT) -> None:
        self.spark, self.fanout, self.buckets = spark, fanout, buckets or shuffle_width(spark)
        self.levels: list[list[str]] = []
        self.seen: list[DataFrame] = []
        self.dropped: list[str] = []
        self.folder, self.tag = scratch(spark, "runs"), uuid.uuid4().hex[:10]
        self.written = 0

    def _write(self, rows: DataFrame) -> str:
        name = f"brindle_run_{self.tag}_{self.written}"
        self.written += 1
        path = f"{self.folder}/{name}"
        (rows.select("a", "b", "n", "last").repartition(self.buckets, "a", "b").write.bucketBy(self.buckets, "a", "b").sortBy("a", "b").option("compression", "zstd").option("path", path).saveAsTable(name))
        return name

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def first_seen(self, batch: DataFrame) -> DataFrame:
        """Rows (a, b, ...) of the batch whose line no run holds: one merge anti-join for each run."""
        for run in self.runs():
            batch = batch.join(run.hint("merge"), ["a", "b"], "left_anti")
        return batch

    def add(self, batch: DataFrame) -> DataFrame:
        """Adds a batch of (a, b, doc_id), rows may repeat; returns the run of its lines that no earlier batch had."""
        grouped = batch.groupBy("a", "b").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("last"))
        first = not self.runs()
        grouped = grouped if first else stored(grouped, "batch")
        name = self._write(self.first_seen(grouped))
        if not first:
            self.seen.append(stored(grouped.join(self.spark.table(name).hint("merge"), ["a", "b"], "left_anti"), "seen"))
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(name)
        fresh = self.spark.table(name)
        self._compact()
        return fresh

    def _compact(self) -> None:
        level = 0
        while level < len(self.levels):
            names = self.levels[level]
            if len(names) >= self.fanout:
                merged = self._write(self._together([self.spark.table(n) for n in names]))
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append(merged)
                self.levels[level] = []
                self.dropped += names
            level += 1

    @staticmethod
    def _together(tables: list[DataFrame]) -> DataFrame:
        out = tables[0]
        for more in tables[1:]:
            out = out.unionByName(more)
        return out

    def lines(self) -> DataFrame:
        """(a, b, n, last) of every line ever added: the runs' rows, which no two runs share, with the sightings of later batches."""
        found = self.runs()
        if not found:
            return self.spark.createDataFrame([], "a long, b long, n long, last long")
        own = self._together(found)
        if not self.seen:
            return own
        more = self._together(self.seen).groupBy("a", "b").agg(F.sum("n").alias("n2"), F.max("last").alias("last2"))
        return own.join(more, ["a", "b"], "left").select("a", "b", (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"), F.greatest("last", "last2").alias("last"))

    def close(self) -> None:
        """Forgets the tables' names; their files go with the shared folder."""
        for name in [*self.dropped, *(n for level in self.levels for n in level)]:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """Adds ``kept_text``, ``n_lines`` and ``n_dropped`` to ``docs`` (doc_id, text, ...)."""
    spark = docs.sparkSession
    text = F.col("text")
    with sweeping(spark) as keep:
        hashes = F.filter(F.transform(lines_of(text), lambda x, i: F.struct(i.alias("pos"), long_line_hash(x, min_chars).alias("h"))), lambda x: x["h"].isNotNull())
        held = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("_of"), F.inline(hashes)).select("doc_id", "_of", "pos", "h.a", "h.b")
        held = stored(held, "lines")
        store = LineRuns(spark, shuffle_width(spark, held.count(), RUN_ROWS))
        keep.add(store.folder)  # its tables are dropped by name
        part = F.pmod(F.xxhash64("doc_id"), F.lit(batches))
        for i in range(batches):
            store.add(held.where(part == i).select("a", "b", "doc_id"))
        common = stored(store.lines().where(F.col("n") >= min_docs).select("a", "b", "last"), "common")
        store.close()
        # Places of a row's dropped lines; rows of one doc_id are told apart by a hash of the text.
        gone = held.join(common, ["a", "b"]).where(F.col("doc_id") < F.col("last")).groupBy("doc_id", "_of").agg(F.array_sort(F.collect_set("pos")).alias("_gone"))
        gone = stored(gone, "gone", keep)
    removed(spark, store.folder)
    taken = {"_gone", "_of", "_lines", "_cut", "kept_text", "n_lines", "n_dropped"}
    base = docs.select([docs[f"`{c}`"] for c in docs.columns if c not in taken])
    joined = base.withColumn("_of", F.xxhash64("text")).join(gone.hint("merge"), ["doc_id", "_of"], "left")  # one plan at every size
    at = joined.withColumn("_lines", F.array(lines_of(text)))

    def without(lines: Column) -> Column:
        """What lies between dropped lines, laid together: in all as long as the text, however many are dropped."""
        ends = F.arrays_zip(F.concat(F.array(F.lit(-1)), F.col("_gone")).alias("low"), F.concat(F.col("_gone"), F.array(F.size(lines))).alias("high"))
        return F.flatten(F.transform(ends, lambda x: F.slice(lines, x["low"] + 2, x["high"] - x["low"] - 1)))

    # A transform over an array of one binds the text's lines, so that a text is split once.
    cut = F.transform("_lines", lambda lines: F.struct(F.size(lines).alias("n"), F.when(F.col("_gone").isNull(), lines).otherwise(without(lines)).alias("kept")))
    return at.withColumn("_cut", F.get(cut, F.lit(0))).select(
        *[F.col(f"`{c}`") for c in base.columns],
        F.array_join("_cut.kept", "\n").alias("kept_text"),
        F.col("_cut.n").cast("long").alias("n_lines"),
        (F.col("_cut.n") - F.size("_cut.kept")).cast("long").alias("n_dropped"),
    )


SQL_LINES = r"""
lines AS (SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM docs)),
common AS (SELECT key, max(doc_id) AS last FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT l.*, coalesce(l.doc_id < c.last, false) AS gone FROM lines l LEFT JOIN common c USING (key))
"""

ORACLE = f"""
WITH docs AS (SELECT doc_id, text FROM documents), {SQL_LINES}
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def digest(docs: DataFrame) -> DataFrame:
    out = drop_repeated_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "utf-8"), 256).alias("kept_sha256"))
