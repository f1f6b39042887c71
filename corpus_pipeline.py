"""A training corpus from raw documents: quality, line dedup, near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Stages are written as Parquet and read again by whoever runs them one by one; ``run`` does so in the shared folder.
Every stage works on empty tables, null texts and repeated rows as its operator defines; rows with a null doc_id
pass through the dedup stages; of rows that repeat a doc_id the near-dedup keeps the least by text, then by all columns; rows that repeat a
doc_id in a source are used alike by the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import linededup, mixing, packing, probminhash, quality
from brindle.llm.common import removed, stored, sweeping, table


def keep_good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated long lines go from all documents but the last that holds them; n_chars follows the text."""
    out = linededup.drop_repeated_lines(docs)
    text = F.when(F.col("text").isNull(), F.col("text")).otherwise(F.col("kept_text"))
    return out.withColumn("text", text).withColumn("n_chars", F.coalesce(F.length(text), F.lit(0)).cast("long")).select(docs.columns)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows with a doc_id, one for each: the least by text, then by all columns."""
    known = docs.where("doc_id IS NOT NULL")
    if known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return known
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return stored(known.groupBy("doc_id").agg(F.min_by(row, F.struct("text", F.to_json(row))).alias("row")).select("row.*"), "one-of-each")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the least doc_id."""
    one = one_of_each(docs)
    found = probminhash.near_duplicates(one.select("doc_id", "text")).where("kept").select("doc_id")
    return one.join(found, "doc_id", "left_semi").select(docs.columns).union(docs.where("doc_id IS NULL"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources uses it."""
    taken, _ = mixing.mix(docs, F.array(F.col("source").cast("string")))
    uses = taken.groupBy("doc_id", F.element_at("pattern", 1).alias("source")).agg(F.max("uses").cast("int").alias("uses")).where("uses > 0")
    same = F.col("d.doc_id").eqNullSafe(F.col("u.doc_id")) & F.col("d.source").cast("string").eqNullSafe(F.col("u.source"))
    at = docs.alias("d").join(uses.alias("u"), same)
    return at.select("d.*", F.explode(F.array_repeat(F.lit(1), F.col("u.uses"))).alias("use")).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of tokens, filled with lexical neighbours."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("quality_classifier", keep_good_documents),
    ("line_dedup", drop_repeated_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("retrieval_packing", pack_sequences),
]

#: SQL can express neither the classifier nor the signatures; the stages' rows are tested against brute-force versions or their operators' own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with sweeping(spark) as keep:  # a stage's own scratch goes with it, and then the table it read
            docs = stored(stage(spark, docs, sf_dir), name, keep)
        if last:
            removed(spark, last)
        last = next(iter(keep))
    return STAGES[-1][1](spark, docs, sf_dir)
