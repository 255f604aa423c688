"""Filtered, paged and counted symbol queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factgraph.functions import predicates as P


def page(found: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """A page in a total order; the driver never sees more than the page."""
    return found.orderBy(*order).offset(offset).limit(limit)


def with_total(paged: DataFrame, found: DataFrame, name: str = "total") -> DataFrame:
    """The page with the exact number of rows found, joined as a one-row aggregate."""
    return paged.join(F.broadcast(found.agg(F.count(F.lit(1)).alias(name))), F.lit(True), "left")


def search_symbols(symbols: DataFrame, query: str, *, kind: str | None = None, namespace: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    where: Column = P.name_matches(F.col("name"), query)
    if kind:
        where &= P.equals(F.col("type_kind"), kind)
    if namespace:
        where &= P.namespace_matches(F.col("namespace"), namespace)
    found = symbols.where(where)
    paged = with_total(page(found, ["name", "symbol_id"], limit, offset), found)
    more = F.col("total") > offset + limit
    return paged.withColumns({"has_more": more, "next_offset": F.when(more, F.lit(offset + limit))})


def count_by(found: DataFrame, column: str) -> DataFrame:
    return found.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def first_per_key(frame: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Keep-first by an explicit order, which a bare dropDuplicates does not promise.

    The comparison with the limit is pushed below the shuffle, so that a task sends one row a key.
    """
    return frame.withColumn("rn_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("rn_ = 1").drop("rn_")


def per_group(frame: DataFrame, keys: list[str], order: list, limit: int, name: str = "ordinal") -> DataFrame:
    """The first rows of each key, numbered from 0; a task keeps no more of a key than that before anything is shuffled."""
    ranked = frame.withColumn("rn_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rn_") <= limit)
    return ranked.withColumn(name, F.col("rn_") - 1).drop("rn_")


def overload(frame: DataFrame, keys: list[str], order: list, index: int) -> DataFrame:
    """The overload with an index per key; an index that is out of range falls back to the first."""
    ranked = frame.withColumn("ordinal", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    best = ranked.withColumn("rn_", F.row_number().over(Window.partitionBy(*keys).orderBy((F.col("ordinal") != index).cast("int"), "ordinal")))
    return best.where("rn_ = 1").drop("rn_")


#: Characters of a stretch of a document; positions meet the spans of their stretch only.
STRETCH = 4096


def enclosing(positions: DataFrame, spans: DataFrame) -> DataFrame:
    """For each (doc_id, pos) the smallest span that holds it.

    Spans are sent to every stretch of the document that they touch, so a document with very many
    positions and spans is split over many tasks, and a position is compared with few spans.
    """
    block = lambda c: F.floor(c / STRETCH)
    cut = spans.where("span_start < span_end").withColumn("block_", F.explode(F.sequence(block(F.col("span_start")), block(F.col("span_end") - 1))))
    hit = positions.withColumn("block_", block(F.col("pos"))).join(cut, ["doc_id", "block_"]).where("span_start <= pos and pos < span_end").drop("block_")
    return first_per_key(hit, ["doc_id", "pos"], [F.col("span_end") - F.col("span_start"), "span_start", "node_id"])
