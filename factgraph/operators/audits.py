"""Audits and dashboards: coupling, coverage, diagnostics, health."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.operators.search import first_per_key


def coupling(uses: DataFrame, members: DataFrame, *, min_efferent: int = 20, min_members: int = 20, limit: int | None = 20) -> DataFrame:
    """Types that use many types and have many members, by a weighted score.

    Efferent counts what a type uses, afferent who uses it; both come from one set of distinct edges.
    """
    edges = uses.where("owner_id <> used_id").distinct()
    out = edges.groupBy(F.col("owner_id").alias("id")).agg(F.count(F.lit(1)).alias("efferent"))
    into = edges.groupBy(F.col("used_id").alias("id")).agg(F.count(F.lit(1)).alias("afferent"))
    size = members.groupBy(F.col("owner_id").alias("id")).agg(F.count(F.lit(1)).alias("members"))
    found = out.where(F.col("efferent") >= min_efferent).join(size.where(F.col("members") >= min_members), "id").join(into, "id", "left")
    found = found.withColumn("afferent", F.coalesce("afferent", F.lit(0)))
    score = F.bround(0.4 * F.col("efferent") + 0.4 * F.col("members") + 0.2 * F.col("afferent"), 2)
    found = found.select("id", "efferent", "afferent", "members", score.alias("score"))
    return found if limit is None else found.orderBy(F.desc("score"), "id").limit(limit)


def diagnostics(found: DataFrame, *, severity: str | None = None, include_hidden: bool = False) -> DataFrame:
    """Distinct diagnostics (document, id, message), first occurrence; hidden ones on request."""
    out = first_per_key(found, ["doc_id", "id", "message"], ["ordinal"])
    if severity:
        return out.where(F.lower("severity") == severity.lower())
    return out if include_hidden else out.where("severity <> 'Hidden'")


def top(found: DataFrame, column: str, section: str, n: int = 5) -> DataFrame:
    """The n most frequent values as (section, key, n)."""
    counts = found.groupBy(F.col(column).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "key").limit(n).select(F.lit(section).alias("section"), "key", "n")


def health(sections: list[DataFrame]) -> DataFrame:
    """A dashboard as one tall table; each section is small by construction."""
    return reduce(DataFrame.unionByName, sections)


def sync(known: DataFrame, listed: DataFrame) -> DataFrame:
    """(path, action): insert, update, delete or keep, by comparing content hashes on the path."""
    both = known.select("path", F.col("hash").alias("old")).join(listed.select("path", F.col("hash").alias("new")), "path", "full_outer")
    action = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").when(F.col("old") != F.col("new"), "update").otherwise("keep")
    return both.select("path", action.alias("action"))
