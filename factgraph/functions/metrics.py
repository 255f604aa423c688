"""Text metrics of source text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What adds a branch. The audit estimate leaves out the short-circuit operators.
BRANCHES = r"\b(?:if|while|for|foreach|case|catch)\b|\?(?![.?\]])"
SHORT_CIRCUIT = r"&&|\|\||\?\?|\?\."


def code_lines(text: Column) -> Column:
    """Lines that are not blank and do not begin with a comment mark."""
    return F.size(F.filter(F.split(text, "\n"), lambda x: ~x.rlike(r"^\s*(//|/\*|\*|$)"))).cast("long")


def cyclomatic(code: Column, short_circuit: bool = True) -> Column:
    """One plus the branches of a stretch of code."""
    base = 1 + F.regexp_count(code, F.lit(BRANCHES))
    return (base + F.regexp_count(code, F.lit(SHORT_CIRCUIT)) if short_circuit else base).cast("long")


#: A using directive: plain, static, global or an alias; group 1 is the name that it is sorted by.
USING = r"^(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?([\w.:]+(?:<[^;]*>)?)\s*;"


def sort_usings(text: Column) -> Column:
    """The using directives of the file itself in order, System first and then by name as people sort; the rest stays.

    Directives behind the first open brace belong to an inner scope and stay there.
    """
    lines = F.split(text, "\n")
    inner = F.array_position(F.transform(lines, lambda x: F.contains(x, F.lit("{"))), True)
    head = F.when(inner > 0, F.slice(lines, F.lit(1), (inner - 1).cast("int"))).otherwise(lines)
    tail = F.when(inner > 0, F.slice(lines, inner.cast("int"), F.size(lines))).otherwise(F.array().cast("array<string>"))
    using = lambda x: x.rlike(USING)
    name = lambda x: F.regexp_extract(x, USING, 1)
    keyed = F.transform(F.filter(head, using), lambda x, i: F.struct((~F.startswith(name(x), F.lit("System"))).alias("later"), F.collate(name(x), "UNICODE").alias("name"), i.alias("i"), x.alias("line")))
    return F.array_join(F.concat(F.transform(F.array_sort(keyed), lambda s: s["line"]), F.filter(head, lambda x: ~using(x)), tail), "\n")
