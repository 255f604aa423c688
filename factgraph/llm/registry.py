"""The queries of this subpackage, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factgraph.runtime import table


def op1_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factgraph.llm import fixity

    pages = table(spark, sf_dir, "pages")
    return fixity.audit(pages, fixity.damaged(pages)).withColumnRenamed("id", "page_id")


def op2_toxicity_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factgraph.llm import toxicity

    return toxicity.contract(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factgraph.llm import quality

    return quality.quality(table(spark, sf_dir, "documents")).select(*quality.COLUMNS)


def op3_quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per rule of the policy: how many documents fail it, and how many only it rejects."""
    from factgraph.llm import quality

    return quality.ablate(quality.ledger(table(spark, sf_dir, "documents")))


def op4_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factgraph.llm import mixing

    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_language_bigru(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factgraph.llm import langid

    return langid.contract(table(spark, sf_dir, "documents"))


def op6_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factgraph.llm import simhash

    return simhash.digest(table(spark, sf_dir, "documents"))


def op7_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factgraph.llm import backoff

    return backoff.score(table(spark, sf_dir, "documents"))


def op8_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factgraph.llm import decontam

    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factgraph.llm import secrets

    return secrets.digest(table(spark, sf_dir, "documents"))


def op10_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factgraph.llm import pii

    return pii.digest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from factgraph.llm import backoff, fixity, quality

    return {"op1_merkle_fixity": fixity.ORACLE_SQL, "op3_quality_ledger": quality.ORACLE_SQL, "op3_quality_ablation": quality.ABLATION_SQL, "op7_stupid_backoff": backoff.ORACLE_SQL}
