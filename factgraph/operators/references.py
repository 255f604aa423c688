"""Reference facts: classification, callers, impact, unused symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.operators.rules import reference_kind
from factgraph.operators.search import first_per_key, per_group

def reference_counts(refs: DataFrame) -> DataFrame:
    """Per symbol and kind; one shuffle with partial counts, so a hot symbol costs one row a task."""
    return refs.withColumn("kind", reference_kind()).groupBy("symbol_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs"))


def callers(refs: DataFrame, locations: int = 3) -> DataFrame:
    """Per symbol and caller: how many locations, and the first few of them as one text.

    Only the locations that are shown are gathered; the others are counted.
    """
    keys = ["symbol_id", "in_symbol_id"]
    counts = refs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    first = per_group(refs.select(*keys, "doc_id", "line").distinct(), keys, ["doc_id", "line"], locations)
    spots = F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "line"))), lambda s: F.concat_ws(":", s["doc_id"].cast("string"), s["line"].cast("string")))
    return counts.join(first.groupBy(*keys).agg(F.array_join(spots, ",").alias("first_spots")), keys)


def outgoing(refs: DataFrame, limit: int = 50) -> DataFrame:
    """Distinct symbols that each caller reaches, in order of their first use."""
    first = first_per_key(refs, ["in_symbol_id", "symbol_id"], ["doc_id", "line"])
    return first.select("in_symbol_id", "symbol_id", "doc_id", "line")


def unused(symbols: DataFrame, refs: DataFrame, max_refs: int = 1, exempt: DataFrame | None = None) -> DataFrame:
    """Symbols with at most ``max_refs`` references that no exemption covers."""
    counts = refs.groupBy("symbol_id").agg(F.count(F.lit(1)).alias("n_refs"))
    out = symbols.join(counts, "symbol_id", "left").withColumn("n_refs", F.coalesce("n_refs", F.lit(0))).where(F.col("n_refs") <= max_refs)
    return out if exempt is None else out.join(exempt, "symbol_id", "left_anti")


#: Severity of each kind of change; a change of accessibility breaks public symbols only.
IMPACT = {"rename": "info", "changetype": "warning", "addparameter": "error", "removeparameter": "error", "delete": "error"}


def change_impact(symbols: DataFrame, refs: DataFrame, change: str) -> DataFrame:
    """Per symbol: how many references a change touches, how severe it is for each, and whether it is safe; symbols without references are safe."""
    key = change.lower().replace("_", "")
    if key == "changeaccessibility":
        severity = F.when(F.col("accessibility") == "Public", "error").otherwise("warning")
    else:
        severity = F.lit(IMPACT.get(key, "info"))
    counts = refs.groupBy("symbol_id").agg(F.count(F.lit(1)).alias("n_refs"), F.countDistinct("doc_id").alias("n_docs"))
    found = symbols.join(counts, "symbol_id", "left").na.fill(0, ["n_refs", "n_docs"])
    # Without references nothing breaks.
    return found.withColumn("severity", severity).withColumn("safe", (F.col("severity") != "error") | (F.col("n_refs") == 0))
