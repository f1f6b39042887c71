"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import langid, linededup, mixing, packing, probminhash, quality, token_planes, topk_bsi, toxicity, vector_dedup
from brindle.llm.common import table


def op1_bitsliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk_bsi.quantised(table(spark, sf_dir, "embeddings"))
    return topk_bsi.top_k_search(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


def op2_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_planes.round_trip(table(spark, sf_dir, "documents"))


def op3_word_backoff_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predicted(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest(table(spark, sf_dir, "documents"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(table(spark, sf_dir, "documents"))


def op6_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.predicted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_pq_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_probminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_segment_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predicted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = (op1_bitsliced_topk, op2_token_planes, op3_word_backoff_langid, op4_line_dedup, op5_source_mix, op6_neighbour_quality, op7_pq_vector_dedup, op8_probminhash_dedup, op9_retrieval_packing, op10_segment_toxicity)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
           FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
     r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_bitsliced_topk": TOPK_SQL, "op4_line_dedup": linededup.ORACLE, "op7_pq_vector_dedup": vector_dedup.ORACLE, "op8_probminhash_dedup": probminhash.ORACLE}
