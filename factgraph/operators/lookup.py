"""What stands at a position, how a method is used, the state of a solution, and edits of source text.

Positions and requests come as tables, so that one plan answers any number of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factgraph.functions import metrics
from factgraph.functions import predicates as P
from factgraph.operators.search import enclosing, per_group

IDENTIFIER = r"^@?[\p{L}_][\p{L}\p{N}_]*$"


def symbol_at(positions: DataFrame, nodes: DataFrame, refs: DataFrame, declared: DataFrame) -> DataFrame:
    """(doc_id, pos, node_id, symbol_id): of the smallest node there the symbol it refers to, else the one it declares.

    ``positions``: (doc_id, pos); ``nodes``: (doc_id, node_id, span_start, span_end); ``refs`` and
    ``declared``: (doc_id, node_id, symbol_id), one row a node. Without a node or symbol these are null.
    """
    at = enclosing(positions, nodes).select("doc_id", "pos", "node_id")
    keys = ["doc_id", "node_id"]
    found = at.join(refs.withColumnRenamed("symbol_id", "ref_"), keys, "left").join(declared.withColumnRenamed("symbol_id", "own_"), keys, "left")
    found = found.select("doc_id", "pos", "node_id", F.coalesce("ref_", "own_").alias("symbol_id"))
    return positions.distinct().join(found, ["doc_id", "pos"], "left")


def definitions(found: DataFrame, declarations: DataFrame) -> DataFrame:
    """The first declaration in source of each symbol found, or why there is none.

    ``declarations``: (symbol_id, in_source, def_doc, def_start, def_end).
    """
    source = per_group(declarations.where("in_source and symbol_id is not null"), ["symbol_id"], ["def_doc", "def_start"], 1).drop("ordinal", "in_source")
    error = F.when(F.col("symbol_id").isNull(), "no symbol").when(F.col("def_doc").isNull(), "not in source")
    return found.join(source, "symbol_id", "left").withColumn("error", error)


def method_usage(refs: DataFrame, *, max_callers: int = 20, max_locations: int = 3) -> DataFrame:
    """Per symbol its first callers with their first locations; ``n_callers`` counts all distinct callers.

    ``refs``: (symbol_id, in_symbol_id, doc_id, line).
    """
    keys = ["symbol_id", "in_symbol_id"]
    pairs = refs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_locations"))
    totals = pairs.groupBy("symbol_id").agg(F.count(F.lit(1)).alias("n_callers"))
    callers = per_group(pairs, ["symbol_id"], ["in_symbol_id"], max_callers).drop("ordinal")
    first = per_group(refs.select(*keys, "doc_id", "line"), keys, ["doc_id", "line"], max_locations)
    shown = F.sort_array(F.collect_list(F.struct("ordinal", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("line").cast("string")).alias("at"))))
    first = first.groupBy(*keys).agg(F.array_join(F.transform(shown, lambda x: x["at"]), ";").alias("locations"))
    return callers.join(first, keys).join(totals, "symbol_id")


def health(projects: DataFrame, documents: DataFrame, diagnostics: DataFrame, *, sample: int = 5) -> DataFrame:
    """One row: whether anything is loaded, counts, and the errors and warnings of the first projects.

    ``projects``: (project, ordinal); ``documents``: (project, doc_id); ``diagnostics``: (project, severity).
    """
    head = projects.orderBy("ordinal", "project").limit(sample).select("project")
    # The broadcast side has ``sample`` rows at most.
    bad = diagnostics.join(F.broadcast(head), "project").agg(F.count_if(F.col("severity") == "Error").alias("n_errors"), F.count_if(F.col("severity") == "Warning").alias("n_warnings"))
    n = lambda frame, name: frame.agg(F.count(F.lit(1)).alias(name))
    # All three are one row.
    row = n(projects, "n_projects").join(n(documents, "n_documents"), F.lit(True)).join(bad, F.lit(True))
    return row.withColumn("status", F.when(F.col("n_projects") > 0, "Ready").otherwise("Not Ready"))


def organised(documents: DataFrame, *, pattern: str = "", changed_only: bool = False) -> DataFrame:
    """The documents whose name fits, with their using directives in order and whether that changes them."""
    after = documents.where(P.glob(F.col("name"), pattern)).withColumn("organised", metrics.sort_usings(F.col("text")))
    after = after.withColumn("changed", ~F.col("organised").eqNullSafe(F.col("text")))
    return after.where("changed") if changed_only else after


def interface_text(members: DataFrame) -> DataFrame:
    """Per type the text of an interface with its public instance methods, properties and events.

    ``members``: (type_id, namespace, interface_name, ordinal, name, kind, value_type, parameters,
    has_getter, has_setter, accessibility, is_static). The text of one type is one value, as its source is.
    """
    accessors = F.concat_ws(" ", F.when(F.col("has_getter"), "get;"), F.when(F.col("has_setter"), "set;"))
    line = F.when(F.col("kind") == "Method", F.concat("value_type", F.lit(" "), "name", F.lit("("), "parameters", F.lit(");")))
    line = line.when(F.col("kind") == "Property", F.concat("value_type", F.lit(" "), "name", F.lit(" { "), accessors, F.lit(" }")))
    line = line.when(F.col("kind") == "Event", F.concat(F.lit("event "), "value_type", F.lit(" "), "name", F.lit(";")))
    kept = members.where((F.col("accessibility") == "Public") & ~F.col("is_static")).withColumn("line_", line).where("line_ is not null")
    found = kept.groupBy("type_id", "namespace", "interface_name").agg(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "line_"))), lambda x: x["line_"]).alias("lines_"))

    def block(head: Column, body: Column) -> Column:
        return F.concat(F.array(head, F.lit("{")), F.transform(body, lambda x: F.concat(F.lit("    "), x)), F.array(F.lit("}")))

    inner = block(F.concat(F.lit("public interface "), "interface_name"), F.col("lines_"))
    whole = F.when(F.coalesce("namespace", F.lit("")) == "", inner).otherwise(block(F.concat(F.lit("namespace "), "namespace"), inner))
    return found.select("type_id", "interface_name", F.concat(F.array_join(whole, "\n"), F.lit("\n")).alias("text"))


def rename_edits(renames: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(symbol_id, doc_id, span_start, span_length, new_text) of every occurrence of the symbols to rename.

    ``renames``: (symbol_id, new_name); a name that is no identifier gives no edits. ``occurrences``:
    (symbol_id, doc_id, span_start, span_length), declarations and references.
    """
    valid = renames.where(F.col("new_name").rlike(IDENTIFIER))
    return occurrences.join(valid, "symbol_id").select("symbol_id", "doc_id", "span_start", "span_length", F.col("new_name").alias("new_text"))


def edit_summary(edits: DataFrame, *, max_changes: int = 20) -> DataFrame:
    """Per symbol and document: how many edits there are, and where the first of them start."""
    keys = ["symbol_id", "doc_id"]
    totals = edits.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_changes"))
    first = per_group(edits.select(*keys, "span_start", "new_text"), keys, ["span_start"], max_changes)
    starts = F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "span_start"))), lambda x: x["span_start"].cast("string"))
    return totals.join(first.groupBy(*keys).agg(F.array_join(starts, ",").alias("starts"), F.min("new_text").alias("new_text")), keys)


def apply_edits(documents: DataFrame, edits: DataFrame) -> DataFrame:
    """Documents with the edits spliced into the text, from the last to the first; edits must not overlap.

    Documents without edits, or with a null text, stay as they are; equal edits count once.
    """
    ordered = F.sort_array(F.collect_set(F.struct("span_start", "span_length", "new_text")), asc=False).alias("edits_")

    def splice(text: Column, e: Column) -> Column:
        return F.concat(F.substring(text, F.lit(1), e["span_start"]), e["new_text"], F.substring(text, e["span_start"] + e["span_length"] + 1, F.length(text)))

    both = documents.join(edits.groupBy("doc_id").agg(ordered), "doc_id", "left")
    text = F.when(F.col("edits_").isNull(), F.col("text")).otherwise(F.aggregate("edits_", F.col("text"), splice))
    return both.withColumn("text", text).drop("edits_")
