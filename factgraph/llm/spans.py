"""Native regular-expression spans: code-point offsets of every match, with DataFrame functions only.

Spark extracts the matched strings but not where they are. Splitting the text by the same pattern
gives the pieces between the matches, and the running sum of both lengths gives the offsets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLOCK = 64


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0).cast("long"), lambda t, x: t + x)


def _folds(array: Column, fold: Callable[[Column], Column]) -> Column:
    """At i ``fold`` of all elements before i; in blocks, so that long arrays cost about n * 64 steps."""

    def within(starts: Column, values: Column) -> Column:
        def at(i: Column) -> Column:
            block = F.floor(i / _BLOCK).cast("int")
            return fold(F.concat(F.array(F.get(starts, block)), F.slice(values, block * _BLOCK + 1, i % _BLOCK)))

        return F.transform(values, lambda _, i: at(i))

    def blocks(values: Column) -> Column:
        folded = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _BLOCK).cast("int")), lambda b: fold(F.slice(values, b * _BLOCK + 1, F.lit(_BLOCK))))
        return bind(bind(folded, starts), lambda s: within(s, values))

    def starts(folded: Column) -> Column:
        # The same a level up: blocks of blocks.
        tops = F.transform(F.sequence(F.lit(0), F.floor((F.size(folded) - 1) / _BLOCK).cast("int")), lambda b: fold(F.slice(folded, b * _BLOCK + 1, F.lit(_BLOCK))))

        def at(tops: Column, i: Column) -> Column:
            top = F.floor(i / _BLOCK).cast("int")
            return fold(F.concat(F.slice(tops, F.lit(1), top), F.slice(folded, top * _BLOCK + 1, i % _BLOCK)))

        return bind(tops, lambda t: F.transform(folded, lambda _, i: at(t, i)))

    return F.when(F.size(array) > 0, bind(array, blocks)).otherwise(F.slice(array, F.lit(1), F.lit(0)))


def prefix_sums(array: Column) -> Column:
    """At i the sum of all elements, longs, before i."""
    return _folds(array, total)


def prefix_maxima(array: Column) -> Column:
    """At i the largest of all elements before i (none of them negative), 0 at the first."""
    return _folds(array, lambda a: F.coalesce(F.array_max(a), F.lit(0)))


def matches(frame: DataFrame, text: str, name: str, pattern: str, *, guard: str | Column | None = None, group: int = 0) -> DataFrame:
    """Add ``name``: array<struct<start, end, found, value, before, after>> of the leftmost non-overlapping matches.

    ``value`` is the capture group ``group``; ``before`` the last 40 characters between the match and
    the one before it, ``after`` the character behind it. ``guard`` is a cheaper pattern or condition that any
    text with a match meets; other texts are not split. The order of the array is by start.
    """
    column = F.col(text)
    wanted = column.rlike(guard) if isinstance(guard, str) else column.rlike(pattern) if guard is None else guard & column.rlike(pattern)
    none = F.array().cast("array<string>")
    frame = frame.withColumns({
        f"{name}_m": F.when(wanted, F.regexp_extract_all(column, F.lit(pattern), F.lit(0))).otherwise(none),
        f"{name}_p": F.when(wanted, F.split(column, pattern, -1)).otherwise(none),
        f"{name}_g": F.when(wanted, F.regexp_extract_all(column, F.lit(pattern), F.lit(group))).otherwise(none) if group else none,
    })
    found, pieces, groups = F.col(f"{name}_m"), F.col(f"{name}_p"), F.col(f"{name}_g")
    frame = frame.withColumns({f"{name}_a": F.transform(found, lambda m: F.length(m)), f"{name}_b": F.transform(F.slice(pieces, F.lit(1), F.size(found)), lambda p: F.length(p))})
    frame = frame.withColumn(f"{name}_s", prefix_sums(F.zip_with(f"{name}_a", f"{name}_b", lambda a, b: (a + b).cast("long"))))

    def one(m: Column, i: Column) -> Column:
        start = F.get(F.col(f"{name}_s"), i).cast("int") + F.get(F.col(f"{name}_b"), i)
        return F.struct(start.alias("start"), (start + F.get(F.col(f"{name}_a"), i)).alias("end"), m.alias("found"), (F.get(groups, i) if group else m).alias("value"), F.substring(F.get(pieces, i), -40, 40).alias("before"), F.substring(F.concat(F.get(pieces, i + 1), F.coalesce(F.get(found, i + 1), F.lit(""))), 1, 1).alias("after"))

    frame = frame.withColumn(name, F.transform(found, one))
    return frame.drop(*[f"{name}_{x}" for x in "mpgabs"])


def label(spans: Column, kind: str, rank: int) -> Column:
    """The spans as array<struct<rank, kind, start, end>>."""
    return F.transform(spans, lambda s: F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def by_start(spans: Column) -> Column:
    return F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).when(a["rank"] != b["rank"], a["rank"] - b["rank"]).otherwise(a["end"] - b["end"]))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each, comma-joined in the order given."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def overlaps(span: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o["start"] < span["end"]) & (span["start"] < o["end"]))


def redact(text: Column, spans: Column, mark: Column) -> Column:
    """``text`` with every stretch that the spans cover replaced by one ``mark``."""

    def merge(ordered: Column) -> Column:
        # A span that begins after all earlier ones have ended starts a stretch.
        before = prefix_maxima(F.transform(ordered, lambda s: s["end"].cast("int")))
        return bind(F.zip_with(ordered, before, lambda s, b: F.struct(s["start"].alias("start"), s["end"].alias("end"), b.alias("before"))), stretches)

    def stretches(ends: Column) -> Column:
        first = F.filter(ends, lambda s: s["start"] >= s["before"])
        return bind(first, lambda f: F.transform(f, lambda s, i: F.struct(s["before"].alias("from"), s["start"].alias("to"))))

    def build(gaps: Column) -> Column:
        tail = F.array_max(F.transform(spans, lambda s: s["end"]))
        parts = F.transform(gaps, lambda g: F.substring(text, g["from"] + 1, g["to"] - g["from"]))
        return F.concat(F.array_join(F.transform(parts, lambda p: F.concat(p, mark)), ""), F.substring(text, tail + 1, F.length(text)))

    return F.when(F.size(spans) > 0, bind(bind(spans, merge), build)).otherwise(text)
