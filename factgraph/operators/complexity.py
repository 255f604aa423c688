"""Complexity of methods from their syntax nodes: cyclomatic, nesting, cognitive, lines, totals per file.

A node has a kind and the kinds of its ancestors, outermost first, so that depth is a count over an
array and every metric is one aggregation per method with partial results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factgraph.runtime import materialise

# The kinds of nodes that count for each metric.
CYCLOMATIC = ("if", "conditional", "case", "pattern_case", "while", "for", "foreach", "catch", "conditional_access", "and", "or", "coalesce")
AUDIT = ("if", "while", "for", "foreach", "case", "pattern_case", "conditional", "catch")
NESTING = ("if", "while", "for", "foreach", "switch", "try", "lock", "using")
RAISING = ("if", "while", "for", "foreach", "switch", "catch")
#: Above these a method gets a hint.
MAX_CYCLOMATIC, MAX_NESTING = 10, 4


def ancestors(nodes: DataFrame) -> DataFrame:
    """Add ``above``, the kinds of each node's ancestors from the root down.

    ``nodes``: (doc_id, node_id, parent_id, kind); the parent of a root is null. One round a level of
    the tree; a node whose parent does not exist has no place in the tree and is left out.
    """
    none = F.array().cast("array<string>")
    level = materialise(nodes.where("parent_id is null").withColumn("above", none))
    found = level
    while not level.isEmpty():
        parents = level.select("doc_id", F.col("node_id").alias("parent_id"), F.concat("above", F.array("kind")).alias("above"))
        level = materialise(nodes.join(parents, ["doc_id", "parent_id"]).select(*nodes.columns, "above"))
        found = found.unionByName(level)
    return found


def _among(kind: Column, kinds: tuple[str, ...]) -> Column:
    return kind.isin(*kinds)


def _depth(kinds: tuple[str, ...]) -> Column:
    return F.size(F.filter("above", lambda k: _among(k, kinds)))


def method_metrics(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Per method (``keys``): cyclomatic, the audit's estimate of it, nesting and cognitive complexity, and hints."""
    kind = F.col("kind")
    level = F.lit(1) + _depth(RAISING)
    cognitive = F.when(_among(kind, (*RAISING, "conditional")), level).when(_among(kind, ("and", "or", "else")), 1).otherwise(0)
    nesting = F.when(_among(kind, NESTING), _depth(NESTING) + 1).otherwise(0)
    out = nodes.groupBy(*keys).agg(
        (1 + F.count_if(_among(kind, CYCLOMATIC))).alias("cyclomatic"), (1 + F.count_if(_among(kind, AUDIT))).alias("estimate"),
        F.max(nesting).cast("long").alias("nesting"), F.sum(cognitive).alias("cognitive"),
    )
    hint = F.concat_ws(";", F.when(F.col("cyclomatic") > MAX_CYCLOMATIC, "split the method"), F.when(F.col("nesting") > MAX_NESTING, "reduce nesting"))
    return out.withColumn("hint", hint)


def file_totals(methods: DataFrame, keys: list[str]) -> DataFrame:
    """Per file: mean cyclomatic complexity (two digits, half to even), the largest values, and all lines; a file without methods has no row."""
    return methods.groupBy(*keys).agg(
        F.bround(F.avg("cyclomatic"), 2).alias("avg_cyclomatic"), F.max("cyclomatic").alias("max_cyclomatic"), F.max("nesting").alias("max_nesting"),
        F.sum("loc").alias("total_loc"), F.count(F.lit(1)).alias("n_methods"),
    )
