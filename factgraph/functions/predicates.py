"""Column predicates for names: substring, wildcard and exact matching without regard to case."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def contains(column: Column, text: str) -> Column:
    return F.contains(F.lower(column), F.lit(text.lower()))


def glob_regex(pattern: str) -> str:
    """A wildcard pattern (``*``, ``?``) as an anchored regular expression; other characters are literal."""
    parts = re.split(r"([*?])", pattern)
    return "(?i)^" + "".join({"*": ".*", "?": "."}.get(p, "" if not p else rf"\Q{p}\E") for p in parts) + "$"


def glob(column: Column, pattern: str) -> Column:
    """An empty pattern matches everything."""
    return F.lit(True) if not pattern else column.rlike(glob_regex(pattern))


def name_matches(column: Column, query: str) -> Column:
    """Wildcards make the query a glob, otherwise it is a substring."""
    return glob(column, query) if re.search(r"[*?]", query) else contains(column, query)


def equals(column: Column, text: str) -> Column:
    return F.lower(column) == F.lit(text.lower())


def attribute_named(column: Column, name: str) -> Column:
    """Equality with or without the customary suffix."""
    return column.isin(name, f"{name}Attribute", name.removesuffix("Attribute"))


def namespace_matches(column: Column, pattern: str) -> Column:
    """An anchored wildcard pattern over the whole namespace, also without a wildcard in it."""
    return glob(column, pattern)


def clip(column: Column, size: int = 200) -> Column:
    return F.when(F.length(column) > size, F.concat(F.substring(column, 1, size), F.lit("..."))).otherwise(column)
