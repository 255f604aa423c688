"""A training-corpus pipeline: quality rules, near copies, benchmark leaks, secrets, mixing.

Each stage takes the documents that the one before it kept, as Parquet, and returns documents; the
last one returns the training order: the columns of documents with epoch, slot and position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.llm import decontam, mixing, neardup, quality, secrets
from factgraph.runtime import drop_materialised, materialise, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy rejects go.

    A null, empty or blank text has no words and is rejected; repeated rows are judged alike, each;
    columns of any further name are carried along; an empty table stays empty.
    """
    verdicts = quality.quality(docs.withColumn("whole_", F.struct(*docs.columns)), id_col="whole_")
    # A filter would be pushed below the measurements and repeat them; one on a generated row is not.
    kept = verdicts.select(F.explode_outer(F.when(F.col("kept"), F.array("whole_"))).alias("row_"))
    return kept.where("row_ is not null").select("row_.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group (five-word shingles, similarity 0.8) stays: the one with the smallest id.

    Null and blank texts are copies of each other; rows are told apart by all of their columns, so
    rows that share an id with another text, or have none, lose nothing; rows equal in every column
    are one document; an id of null comes after all others.
    """
    return neardup.representatives(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go.

    Rows are marked one by one, so a row that shares its id with a leaked one stays, and a leaked row
    without an id goes; null texts contain nothing; without usable items every row stays.
    """
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; the documents stay, with n_chars brought up to date.

    A null text stays null (its n_chars too becomes null); repeated rows are masked alike, each.
    """
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The order of training: every document, sources interleaved at their target weights.

    The columns of the documents, then epoch, slot and position (with a trailing underscore if the
    documents have such a column). A null source is a source of its own; repeated rows are separate
    documents.
    """
    return mixing.mix(docs, keep=tuple(docs.columns))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("secret_scan", secret_scan),
    ("source_mixing", source_mixing),
]

#: Near copies, latent retrieval and the random secrets cannot be expressed in SQL;
#: tests/llm/test_pipeline.py compares run() with a plain-Python version of all five stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs)
            if i:
                drop_materialised(spark, before)
    return docs
