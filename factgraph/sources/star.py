"""Fact tables over the driver's star-schema tables: an analogy that exercises every operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factgraph.runtime import table


def symbols(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("symbol_id"), F.col("p_name").alias("name"), F.col("p_type").alias("type_kind"), F.col("p_brand").alias("namespace"), F.when(F.col("p_size") > 10, "Public").otherwise("Internal").alias("accessibility"), F.col("p_size").alias("size"))


def refs(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "lineitem")
    nearest = F.get(F.array(*map(F.lit, ("attribute", "typeof", "cast", "invocation"))), F.col("l_linenumber") % 5)
    side = F.when(nearest == "cast", F.when(F.col("l_quantity") > 25, "type").otherwise("operand")).otherwise(F.when(F.col("l_quantity") > 25, "callee").otherwise("argument"))
    return x.select(
        F.col("l_partkey").alias("symbol_id"), F.col("l_suppkey").alias("in_symbol_id"), F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line"), F.col("l_quantity").cast("int").alias("col"),
        ((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")).alias("is_write"), nearest.alias("nearest"), side.alias("side"), F.when(F.col("l_suppkey") % 3 == 0, "nameof").otherwise("Run").alias("callee"),
    )


def type_edges(spark: SparkSession, sf: str) -> DataFrame:
    """customer and supplier -> nation -> region: a chain of bases."""
    c, s, n = (table(spark, sf, t) for t in ("customer", "supplier", "nation"))
    key = lambda prefix, col: F.concat(F.lit(prefix), F.col(col).cast("string"))
    relation = lambda name: F.lit(name).alias("relation")
    one = c.select(key("c", "c_custkey").alias("type_id"), key("n", "c_nationkey").alias("base_id"), relation("interface"))
    two = s.select(key("s", "s_suppkey").alias("type_id"), key("n", "s_nationkey").alias("base_id"), relation("base"))
    return one.unionByName(two).unionByName(n.select(key("n", "n_nationkey").alias("type_id"), key("r", "n_regionkey").alias("base_id"), relation("base")))


def type_uses(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "lineitem")
    return x.select(F.col("l_partkey").alias("owner_id"), F.col("l_suppkey").alias("used_id")).distinct()


def calls(spark: SparkSession, sf: str) -> DataFrame:
    """Which event type follows which, per user."""
    e = table(spark, sf, "events")
    after = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.col("event_type").alias("src"), after.alias("dst")).where("dst is not null").distinct()


def diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    severity = F.when(F.col("value") > 75, "Error").when(F.col("value") > 50, "Warning").when(F.col("value") > 25, "Info").otherwise("Hidden")
    return e.select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("id"), severity.alias("severity"), F.col("props").alias("message"), F.col("event_id").alias("ordinal"))
