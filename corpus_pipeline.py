"""The corpus pipeline: quality rules, near-dedup, personal data, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Defined cases are those of the operators: nulls in any column, empty and very long texts, repeated rows, empty tables
and further columns (which are left behind) don't stop a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import mixing, near_dedup, pieces, pii, quality_rules
from plumbline.llm.common import n_words, table, text_of
from plumbline.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep(docs.select(*COLUMNS))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: shingles of five words, similarity 0.8 or more."""
    return near_dedup.deduplicate(docs.select(*COLUMNS)).select(*COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to their kind in angle brackets."""
    return pii.clean(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix written out: whole copies, and the last document of each source cut to its exact budget."""
    mixed = mixing.mix(docs.select(*COLUMNS), n_words(text_of()))
    return mixing.write_out(mixed).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document's text, checked by decoding them."""
    return pieces.encode_checked(docs.select(*COLUMNS)).select("doc_id", "lang", "source", "n_chars", "n_ids", "ids", "ids_sha256", "round_trip")


STAGES = [
    ("quality_rules", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", encoding_stage),
]

#: Hashing, learning and encoding stages have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
