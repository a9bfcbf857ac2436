"""A training corpus from raw documents: line cleaning, near-dedup, decontamination, secret redaction, packing.

Each stage works on all rows that the one before kept and returns the columns of documents, the last one the packing.
Defined results for nulls, empty texts, ties, repeated rows and empty tables are those of the operators. Stages work on
rows: identifiers may be null or repeated. Other columns of the input are left out; those of documents must exist.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsight.llm import decontamination, near_dedup, packing, quality_rules, secrets
from twinsight.llm._shared import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go; documents that the rules reject go, null and empty texts among them. n_chars counts what is left."""
    # The row number is there for the filter only: one that needs it stays above the verdict, else its conditions would
    # be pushed below and every rule would run twice.
    kept = quality_rules.clean_lines(docs).withColumn("__row", F.monotonically_increasing_id()).where("kept and __row >= 0")
    return kept.select("doc_id", F.col("clean_text").alias("text"), "lang", "source", F.char_length("clean_text").cast("long").alias("n_chars"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays, that of the smallest identifier, null last: five-word shingles, similarity 0.8 or more."""
    # Identifiers can be null or repeated, so rows get a key; it is written, since a key made anew could differ.
    keyed = materialise(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "near-rows")
    groups = near_dedup.near_duplicates(keyed.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id")
    rows = materialise(keyed.select("row", "doc_id").join(groups, "row"), "near-groups")
    first = rows.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")).select("first.row")
    gone = rows.select("row").join(first, "row", "left_anti")
    return keyed.join(gone, "row", "left_anti").select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null texts hold none; of repeated rows all stay or all go."""
    return decontamination.without_leaks(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every finding in a text is replaced by its kind in brackets; all documents stay."""
    clean = secrets.redact(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.char_length("text").cast("long"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, each with its sequence and offset."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", rules_stage),
    ("MinHash near-dedup", dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("best-fit packing", packing_stage),
]

#: Near-duplicate groups and token ids can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name.replace(" ", "-"))
    return docs
