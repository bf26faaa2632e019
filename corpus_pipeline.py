"""A training corpus from the table ``documents``, stage by stage.

Each stage takes all that its predecessor kept; what it returns is written as Parquet to the shared folder and read
again. All stages but the last return the columns of ``documents``, whatever further columns there are and whatever
their names: a row travels as one value through joins, and decisions add no column. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbflow.llm import bpe, jaccard, mixing, pii, toxicity
from ebbflow.llm.common import store
from ebbflow.llm.queries import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain rejects go; all others stay as they are. A null text is scored as an empty one; repeated rows
    share their fate; without labels of both kinds nothing goes."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), toxicity.LABELS)
    return docs.where(~toxicity.rejected(model, "toxic"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: the one with the smallest doc_id (null last), then the smallest digest
    of its text. Null and blank texts are in no class and stay; of rows equal in doc_id and text one stays."""
    return jaccard.keep_one(docs)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind, disclosing terms go; n_chars follows the text. A null text stays null, an empty
    one empty; all rows stay, repeated ones with the same result."""
    out = pii.sanitise(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the proportions of the target weights; one that is taken in two epochs comes twice. Null domains,
    languages and sources are values of their own; a text without tokens goes with its leaf at no cost; equal rows are
    counted and taken row by row, in the seeded order that breaks all ties."""
    return mixing.mix(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each document, however often it comes; a null text is empty."""
    return bpe.round_trip(docs, vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("pii", sanitise),
    ("source_mixing", mix_sources),
    ("byte_bpe", tokenise),
]

#: Classifier training, min-hash joins and BPE aren't SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
