"""Questions about declarations: attributes, members, sources, packages, fixes, ways to make a value.

All operators are joins, filters and windows over fact tables; a limit is a rank within a group or
the page that the caller asked for, never a cap on what is examined.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factgraph.functions import metrics
from factgraph.operators.graph import closure
from factgraph.operators.search import first_per_key, per_group

#: Name prefixes of methods that make a value of some type.
FACTORY_PREFIXES = ("Create", "Build", "New")
#: A diagnostic that starts less than this many characters away still counts as near.
NEAR = 50
# Method prefixes that register a service.
REGISTRATION_PREFIXES = (
    "AddScoped", "AddTransient", "AddSingleton", "AddHostedService",
    "TryAddScoped", "TryAddTransient", "TryAddSingleton",
    "AddKeyedScoped", "AddKeyedTransient", "AddKeyedSingleton",
)
#: The lifetime goes by the first of these words in the method's name; a hosted service is a singleton.
LIFETIMES = {"Scoped": "Scoped", "Transient": "Transient", "Singleton": "Singleton", "Hosted": "Singleton"}
# What to suggest for a diagnostic id.
SUGGESTIONS = {
    "CS0168": ["Remove unused variable", "Use the variable", "Prefix with underscore to indicate intentionally unused"],
    "CS0219": ["Remove unused variable", "Use the variable in an expression"],
    "CS1998": ["Add await keyword to async operation", "Remove async modifier if method doesn't need to be async", "Return Task.CompletedTask or Task.FromResult()"],
    "CS0162": ["Remove unreachable code", "Fix control flow logic"],
    "CS0649": ["Initialize the field", "Remove unused field", "Mark as obsolete if legacy code"],
    "CS8019": ["Remove unnecessary using directive", "Run 'Organize Usings'"],
    "CS0246": ["Add missing using directive", "Check type name spelling", "Add assembly reference"],
    "CS0103": ["Add missing using directive", "Check name spelling", "Declare the variable or method"],
    "CS4012": ["Move Utf8JsonReader to non-async context", "Use synchronous JSON parsing", "Wrap in Task.Run() for async operation"],
    "CS1503": ["Cast argument to expected type", "Change parameter type", "Fix argument expression"],
}
DEFAULT_SUGGESTIONS = ["Review diagnostic message for fix guidance", "Consult C# documentation for "]
# The implicit numeric conversions of the C# language specification.
WIDENING = {
    "sbyte": ("short", "int", "long", "float", "double", "decimal"),
    "byte": ("short", "ushort", "int", "uint", "long", "ulong", "float", "double", "decimal"),
    "short": ("int", "long", "float", "double", "decimal"),
    "ushort": ("int", "uint", "long", "ulong", "float", "double", "decimal"),
    "int": ("long", "float", "double", "decimal"),
    "uint": ("long", "ulong", "float", "double", "decimal"),
    "long": ("float", "double", "decimal"),
    "ulong": ("float", "double", "decimal"),
    "char": ("ushort", "int", "uint", "long", "ulong", "float", "double", "decimal"),
    "float": ("double",),
    "double": (),
    "decimal": (),
}


def any_of(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def attribute_usages(attributes: DataFrame, name: str, *, column: str = "attribute") -> DataFrame:
    """Rows whose attribute class is called by the name given, in either case: whole, with ``Attribute`` behind the name, or with ``Attribute`` taken out of the class's."""
    lower, wanted = F.lower(column), name.lower()
    bare = F.lower(F.replace(F.col(column), F.lit("Attribute"), F.lit("")))
    return attributes.where(lower.isin(wanted, f"{wanted}attribute") | (bare == wanted))


def members(own: DataFrame, bases: DataFrame, *, inherited: bool = True, limit: int | None = None) -> DataFrame:
    """Members per type, inherited ones included; a name and kind that a nearer type declares hides the farther.

    ``own``: (type_id, name, kind, ordinal); ``bases``: (src, dst, depth), each type's bases at their depth.
    """
    found = own.withColumn("depth", F.lit(0)).withColumn("declared_in", F.col("type_id"))
    if inherited:
        up = bases.select(F.col("src").alias("type_id"), F.col("dst").alias("declared_in"), "depth")
        found = found.unionByName(up.join(own.withColumnRenamed("type_id", "declared_in"), "declared_in").select(*found.columns))
    found = first_per_key(found, ["type_id", "name", "kind"], ["depth", "ordinal", "declared_in"])
    return found if limit is None else per_group(found, ["type_id"], ["depth", "ordinal", "name", "kind"], limit, "rank").drop("rank")


def hierarchy(types: DataFrame, edges: DataFrame, bases: DataFrame, *, max_derived: int = 50, root: str = "object") -> DataFrame:
    """Per type: its base chain up to but without ``root``, all interfaces, how many types derive from it directly, and the first of those.

    ``edges``: (type_id, base_id, relation), relation ``base`` or ``interface``; ``bases``: (src, dst,
    depth), the closure over all edges. A base type is reached over base edges only; whatever else
    is reached is an interface.
    """
    chain = closure(edges.where("relation = 'base'"), "type_id", "base_id").where(F.col("dst") != root)
    up = chain.groupBy(F.col("src").alias("type_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("depth", "dst"))), lambda b: b["dst"]).alias("bases"))
    interfaces = bases.where(F.col("dst") != root).join(chain.select("src", "dst"), ["src", "dst"], "left_anti").groupBy(F.col("src").alias("type_id")).agg(F.sort_array(F.collect_set("dst")).alias("interfaces"))
    classes = edges.where("relation = 'base'")
    # A task keeps the first few of each base before anything is shuffled.
    ranked = per_group(classes.select("base_id", "type_id"), ["base_id"], ["type_id"], max_derived)
    first = ranked.groupBy(F.col("base_id").alias("type_id")).agg(F.sort_array(F.collect_list("type_id")).alias("derived"))
    count = classes.groupBy(F.col("base_id").alias("type_id")).agg(F.count(F.lit(1)).alias("n_derived"))
    none = F.array().cast("array<string>")
    found = types.join(up, "type_id", "left").join(interfaces, "type_id", "left").join(count, "type_id", "left").join(first, "type_id", "left")
    return found.select("type_id", *[F.coalesce(c, none).alias(c) for c in ("bases", "interfaces")], F.coalesce("n_derived", F.lit(0)).alias("n_derived"), F.coalesce("derived", none).alias("derived"))


def registrations(calls: DataFrame, prefixes: Sequence[str] = REGISTRATION_PREFIXES, container: str = "ServiceCollection") -> DataFrame:
    """Calls that register a service: method name by prefix, receiver by substring; one type argument names both sides.

    ``calls``: (method, receiver, type_args array<string>) and any other columns.
    """
    named = any_of([F.startswith("method", F.lit(p)) for p in prefixes])
    lifetime = F.coalesce(*[F.when(F.contains("method", F.lit(word)), name) for word, name in LIFETIMES.items()], F.lit("Unknown"))
    service, implementation = F.get("type_args", F.lit(0)), F.get("type_args", F.lit(1))
    return calls.where(named & F.contains("receiver", F.lit(container))).withColumns({"lifetime": lifetime, "service": service, "implementation": F.coalesce(implementation, service)})


def packages(projects: DataFrame, *, xml: str = "xml") -> DataFrame:
    """(project, package, version, private_assets, exclude_assets) of every ``PackageReference``, as attribute or child element; projects without one keep a row.

    An element that is no valid XML is skipped.
    """
    element = r"(?s)<PackageReference\b[^>]*?/>|<PackageReference\b.*?</PackageReference>"
    found = F.filter(F.regexp_extract_all(F.col(xml), F.lit(element), F.lit(0)), _well_formed)
    items = projects.select("project", F.explode_outer(found).alias("item"))

    def part(name: str) -> Column:
        return F.coalesce(*[F.nullif(F.xpath_string("item", F.lit(f"/PackageReference/{path}")), F.lit("")) for path in (f"@{name}", name)])

    version = F.when(F.col("item").isNotNull(), F.coalesce(part("Version"), F.lit("unknown")))
    return items.select("project", part("Include").alias("package"), version.alias("version"), part("PrivateAssets").alias("private_assets"), part("ExcludeAssets").alias("exclude_assets"))


def _well_formed(element: Column) -> Column:
    """Whether a short element is valid XML: tags that nest, attributes in quotes, no bare ampersand or bracket."""
    attributes = r"(?:\s+[\w:.-]+\s*=\s*(?:\"[^\"<&]*\"|'[^'<&]*'))*+\s*"
    child = rf"\s*<([\w:.-]+){attributes}(?:/>|>[^<>&]*</\1\s*>)"
    return F.regexp_replace(element, r"&(?:amp|lt|gt|quot|apos|#[0-9]+|#x[0-9a-fA-F]+);", "").rlike(rf"^<PackageReference{attributes}(?:/>|>(?:{child})*\s*[^<>&]*</PackageReference\s*>)$")


def generated(documents: DataFrame, written: DataFrame, *, key: str = "path") -> DataFrame:
    """Documents of a compilation that no project file lists."""
    return documents.join(written.select(key), key, "left_anti")


def first_containing(documents: DataFrame, text: str, *, keys: list[str], column: str = "path") -> DataFrame:
    """Per project the first document whose path holds ``text``, in either case."""
    return first_per_key(documents.where(F.contains(F.lower(column), F.lit(text.lower()))), keys, [column])


def nearest_diagnostic(positions: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Per (doc_id, id, pos) one diagnostic of that id: one whose span, without its end, holds the position, else one that starts near, else any; first in source order."""
    both = positions.join(diagnostics, ["doc_id", "id"])
    tier = F.when((F.col("span_start") <= F.col("pos")) & (F.col("pos") < F.col("span_end")), 1).when(F.abs(F.col("span_start") - F.col("pos")) < NEAR, 2).otherwise(3)
    return first_per_key(both.withColumn("tier", tier), ["doc_id", "id", "pos"], ["tier", "span_start", "ordinal"])


def suggestions(found: DataFrame) -> DataFrame:
    """The fixed suggestions for each diagnostic id, or general advice that names it."""
    listed = [F.when(F.col("id") == id_, F.array(*map(F.lit, texts))) for id_, texts in SUGGESTIONS.items()]
    general, consult = DEFAULT_SUGGESTIONS
    return found.withColumn("suggestions", F.coalesce(*listed, F.array(F.lit(general), F.concat(F.lit(consult), "id"))))


def external_members(symbols: DataFrame, *, limit: int = 200) -> DataFrame:
    """Per external type the visible members with the summary of their XML documentation (raw text where it has none).

    ``symbols``: (type_id, name, accessibility, in_source, doc_xml, ordinal).
    """
    summary = F.regexp_extract("doc_xml", r"(?s)<summary>(.*?)</summary>", 1)
    visible = symbols.where(~F.col("in_source") & F.col("accessibility").isin("Public", "Protected"))
    ranked = per_group(visible, ["type_id"], ["ordinal", "name"], limit, "rank").drop("rank")
    return ranked.withColumn("summary", F.regexp_replace(F.when(F.contains("doc_xml", F.lit("<summary>")), summary).otherwise(F.col("doc_xml")), r"^\s+|\s+$", ""))


def factories(methods: DataFrame, *, limit: int = 5, prefixes: Sequence[str] = FACTORY_PREFIXES) -> DataFrame:
    """Per value type the first methods of other types that make it, with how many there are in all.

    ``methods``: (method_id, name, owner_id, value_type).
    """
    found = methods.where(any_of([F.startswith("name", F.lit(p)) for p in prefixes]) & (F.col("owner_id") != F.col("value_type")))
    whole = Window.partitionBy("value_type")
    ranked = found.withColumn("n_factories", F.count(F.lit(1)).over(whole))
    return per_group(ranked, ["value_type"], ["owner_id", "name", "method_id"], limit)


def conversion(pairs: DataFrame, bases: DataFrame) -> DataFrame:
    """How a value of type ``source`` converts to ``target``: Identity, ImplicitNumeric, ExplicitNumeric, Boxing, Unboxing, ImplicitReference, Explicit or None.

    ``bases`` is the closure (src, dst, depth) of the type hierarchy; each pair is looked up both ways.
    """
    wide = any_of([(F.col("source") == a) & F.col("target").isin(*b) for a, b in WIDENING.items() if b])
    numeric = F.col("source").isin(*WIDENING) & F.col("target").isin(*WIDENING)
    up = bases.select(F.col("src").alias("source"), F.col("dst").alias("target"), F.lit(True).alias("up_"))
    down = bases.select(F.col("src").alias("target"), F.col("dst").alias("source"), F.lit(True).alias("down_"))
    kind = F.when(F.col("source") == F.col("target"), "Identity").when(wide, "ImplicitNumeric").when(numeric, "ExplicitNumeric").when(F.col("source").isin(*WIDENING) & (F.col("target") == "object"), "Boxing").when(F.col("target").isin(*WIDENING) & (F.col("source") == "object"), "Unboxing").when(F.col("up_"), "ImplicitReference").when(F.col("down_"), "Explicit").otherwise("None")
    return pairs.join(up, ["source", "target"], "left").join(down, ["source", "target"], "left").withColumn("conversion", kind).drop("up_", "down_")


def sources(requests: DataFrame, declared: DataFrame, documents: DataFrame) -> DataFrame:
    """The text of each requested member, its number of lines, or why there is none.

    ``requests``: (request_id, type_id, name, index); ``declared``: (type_id, name, ordinal, doc_id,
    span_start, span_length); ``documents``: (doc_id, text). An index out of range is an error.
    """
    known = declared.select("type_id", "name").distinct().withColumn("known_", F.lit(True))
    hit = requests.join(declared.withColumnRenamed("ordinal", "index"), ["type_id", "name", "index"], "left").join(known, ["type_id", "name"], "left").join(documents.select("doc_id", "text"), "doc_id", "left")
    text = F.substring(F.col("text"), F.col("span_start") + 1, F.col("span_length"))
    error = F.when(F.col("known_").isNull(), "not found").when(F.col("span_start").isNull(), "index out of range")
    return hit.select("request_id", text.alias("source"), F.size(F.split(text, "\n", -1)).alias("n_lines"), error.alias("error")).withColumn("n_lines", F.when(F.col("error").isNull(), F.col("n_lines")))


def sources_batch(requests: DataFrame, declared: DataFrame, documents: DataFrame, *, max_methods: int = 20) -> DataFrame:
    """``sources`` for batches of requests; a batch of more than ``max_methods`` gets an error for each request and no text.

    ``requests``: (batch_id, request_id, type_id, name, index).
    """
    sizes = requests.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_requests"))
    found = requests.select("batch_id", "request_id").join(sizes, "batch_id").join(sources(requests.drop("batch_id"), declared, documents), "request_id")
    over = F.col("n_requests") > max_methods
    hide = lambda c: F.when(~over, F.col(c)).alias(c)
    return found.select("batch_id", "request_id", hide("source"), hide("n_lines"), F.when(over, "too many methods").otherwise(F.col("error")).alias("error"))


def file_overview(documents: DataFrame, diagnostics: DataFrame, types: DataFrame) -> DataFrame:
    """Per document its lines, using directives, first namespace, type declarations and diagnostics by severity."""
    severities = diagnostics.groupBy("doc_id").agg(F.count_if(F.col("severity") == "Error").alias("n_errors"), F.count_if(F.col("severity") == "Warning").alias("n_warnings"), F.count_if(F.col("severity") == "Info").alias("n_infos"))
    declared = types.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_types"))
    usings = F.size(F.filter(F.split("text", "\n", -1), lambda x: F.trim(x).rlike(metrics.USING))).cast("long")
    namespace = F.nullif(F.regexp_extract("text", r"(?m)^\s*namespace\s+([\w.]+)", 1), F.lit(""))
    lines = documents.select("doc_id", F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"), usings.alias("n_usings"), namespace.alias("namespace"))
    return lines.join(severities, "doc_id", "left").join(declared, "doc_id", "left").na.fill(0, ["n_errors", "n_warnings", "n_infos", "n_types"])


def listing(items: DataFrame, *, limit: int) -> DataFrame:
    """(project, n, items): the first items of each project in order, and a mark for how many more there are.

    ``items``: (project, item).
    """
    totals = items.groupBy("project").agg(F.count(F.lit(1)).alias("n"))
    first = per_group(items.select("project", "item"), ["project"], ["item"], limit).groupBy("project").agg(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", F.col("item").cast("string").alias("item")))), lambda x: x["item"]).alias("items"))
    more = F.when(F.col("n") > limit, F.array(F.concat(F.lit("... and "), (F.col("n") - limit).cast("string"), F.lit(" more")))).otherwise(F.array().cast("array<string>"))
    return totals.join(first, "project").withColumn("items", F.concat("items", more))


def owning_project(paths: DataFrame, projects: DataFrame, *, separator: str = "/") -> DataFrame:
    """Each path's project: the one with the longest directory that holds it.

    A path is exploded into its directories and joined on equality, so there is no prefix comparison
    of every path with every project.
    """
    parts = F.split("path", separator, -1)
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), separator))
    hit = paths.select("path", F.explode(prefixes).alias("dir")).join(projects.select("dir", "project"), "dir")
    best = hit.groupBy("path").agg(F.max_by("project", F.struct(F.length("dir"), F.col("project"))).alias("project"))
    return paths.join(best, "path", "left")
