"""Data and control flow of regions of code, from facts about variables and jumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def data_flow(regions: DataFrame, accesses: DataFrame) -> DataFrame:
    """Per region the sorted variable names of each set, as a flow analysis names them.

    ``regions``: (region_id, doc_id, region_start, region_end); ``accesses``: (doc_id, variable, pos,
    action, conditional, captured), where ``action`` is declare, read, write or address. Positions of one
    document are compared with its regions only. In the order of the text: a variable flows in if it
    is declared before the region and its first use inside is a read or conditional write; it flows out
    if it is written inside and read after; it is always assigned if some write inside is unconditional.
    """
    inside = (F.col("pos") >= F.col("region_start")) & (F.col("pos") < F.col("region_end"))
    after, action = F.col("pos") >= F.col("region_end"), F.col("action")
    at = regions.join(accesses, "doc_id")
    use = F.when(inside & action.isin("read", "write"), F.struct("pos", (action == "write").alias("late"), ((action == "write") & ~F.col("conditional")).alias("sets")))
    some = lambda test: F.coalesce(F.bool_or(test), F.lit(False))
    variables = at.groupBy("region_id", "variable").agg(
        some(inside & (action == "declare")).alias("declared"), some((F.col("pos") < F.col("region_start")) & (action == "declare")).alias("known"),
        some(inside & (action == "read")).alias("read_inside"), some(inside & (action == "write")).alias("written_inside"),
        some(~inside & (action == "read")).alias("read_outside"), some(~inside & (action == "write")).alias("written_outside"),
        some(inside & (action == "write") & ~F.col("conditional")).alias("always_assigned"), some(after & (action == "read")).alias("read_after"),
        F.min(use).alias("first"), some(F.col("captured")).alias("captured"), some(F.col("captured") & inside).alias("captured_inside"),
        some(F.col("captured") & ~inside).alias("captured_outside"), some(inside & (action == "address")).alias("address_taken"),
    )
    flows = variables.withColumns({"flows_in": F.col("known") & F.col("first").isNotNull() & ~F.coalesce(F.col("first.sets"), F.lit(False)), "flows_out": F.col("written_inside") & F.col("read_after")})

    def names(test: str) -> Column:
        return F.sort_array(F.collect_set(F.when(F.col(test), F.col("variable")))).alias(test)

    sets = ("declared", "always_assigned", "flows_in", "flows_out", "read_inside", "written_inside", "read_outside", "written_outside", "captured", "captured_inside", "captured_outside", "address_taken")
    found = flows.groupBy("region_id").agg(*[names(s) for s in sets])
    none = F.array().cast("array<string>")
    return regions.select("region_id").join(found, "region_id", "left").select("region_id", *[F.coalesce(s, none).alias(s) for s in sets])


def control_flow(regions: DataFrame, jumps: DataFrame, statements: DataFrame) -> DataFrame:
    """Per region: jumps that enter and leave it, returns, and whether its start and end can be reached.

    ``jumps``: (doc_id, pos, kind, target), where a return has no target; ``statements``: (doc_id, pos,
    reachable, completes), of which the first and last inside the region decide.
    """
    within = lambda c: (F.col(c) >= F.col("region_start")) & (F.col(c) < F.col("region_end"))
    at = regions.join(jumps, "doc_id")
    inside, to = within("pos"), F.coalesce(within("target"), F.lit(False))
    exits = inside & ((F.col("kind") == "return") | ~to)
    found = at.groupBy("region_id").agg(F.count_if(~inside & to).alias("n_entries"), F.count_if(exits).alias("n_exits"), F.count_if(inside & (F.col("kind") == "return")).alias("n_returns"))
    body = regions.join(statements, "doc_id").where(within("pos")).groupBy("region_id").agg(F.min_by("reachable", "pos").alias("start_reachable"), F.max_by(F.col("reachable") & F.col("completes"), "pos").alias("end_reachable"))
    return regions.select("region_id").join(found, "region_id", "left").na.fill(0, ["n_entries", "n_exits", "n_returns"]).join(body, "region_id", "left").na.fill(True, ["start_reachable", "end_reachable"])
