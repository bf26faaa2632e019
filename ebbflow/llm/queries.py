"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, forest, jaccard, licenses, mixing, neardup, pii, spans, suffixes, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """Default vocabulary file; every operator takes another path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.scan(_table(spark, sf_dir, "documents")))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"), toxicity.LABELS)
    return toxicity.score(docs, model).select("doc_id", "p_low_quality", "p_toxic", F.col("is_toxic").alias("toxic"))


def op4_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.removed_spans(spans.find(_table(spark, sf_dir, "documents")))


def op5_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "embeddings")
    return forest.search(table, table.where("vec_id % 50 = 0"))


def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(suffixes.dedup(_table(spark, sf_dir, "documents")))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(_table(spark, sf_dir, "documents")).drop("digest")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), vocabulary())


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_neardup": op1_embedding_neardup,
    "op2_pii": op2_pii,
    "op3_toxicity": op3_toxicity,
    "op4_sentence_spans": op4_sentence_spans,
    "op5_prefix_forest": op5_prefix_forest,
    "op6_suffix_array": op6_suffix_array,
    "op7_license_scan": op7_license_scan,
    "op8_mixing": op8_mixing,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_jaccard_join": op10_jaccard_join,
}

ORACLE_SQL: dict[str, str] = {
    "op1_embedding_neardup": neardup.oracle(),
    "op7_license_scan": licenses.oracle(),
    "op8_mixing": mixing.oracle(),
}
