"""Telling rows apart that share an id or have none, and taking rows out of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_type(docs: DataFrame, id_col: str) -> str:
    """The SQL type of the id column, which operators pass through."""
    return docs.select(id_col).schema[0].dataType.simpleString()


def row_key(docs: DataFrame) -> Column:
    """A hash of every column."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])


def without(docs: DataFrame, lost: DataFrame, id_col: str, *, how: str = "left_anti") -> DataFrame:
    """The rows of ``docs`` that are not in ``lost`` (id, row), by id and ``row_key``; with ``left_semi`` those that are."""
    keyed = docs.withColumn("row_key_", row_key(docs)).alias("d")
    gone = lost.select(F.col("id").alias("gone_id_"), F.col("row").alias("gone_row_")).distinct()
    same = (F.col("row_key_") == F.col("gone_row_")) & F.col(f"d.`{id_col}`").eqNullSafe(F.col("gone_id_"))
    return keyed.join(gone, same, how).select(*[F.col(f"d.`{c}`") for c in docs.columns])
