"""Rules that decide what a fact means: kinds of references, unused code, reflection, missing members, queries by predicate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factgraph.functions import predicates as P
from factgraph.operators.search import per_group

# Names whose implementers and heirs a framework finds by itself, by part of the name.
FRAMEWORK_TYPES = (
    "Microsoft.Extensions.Hosting.IHostedService", "Microsoft.Extensions.Hosting.BackgroundService",
    "Microsoft.AspNetCore.Mvc.Filters.IActionFilter", "Microsoft.AspNetCore.Mvc.Filters.IAsyncActionFilter",
    "Microsoft.AspNetCore.Mvc.Filters.IAuthorizationFilter", "Microsoft.AspNetCore.Mvc.Filters.IAsyncAuthorizationFilter",
    "Microsoft.AspNetCore.Mvc.Filters.IResourceFilter", "Microsoft.AspNetCore.Mvc.Filters.IAsyncResourceFilter",
    "Microsoft.AspNetCore.Mvc.Filters.IExceptionFilter", "Microsoft.AspNetCore.Mvc.Filters.IAsyncExceptionFilter",
    "Microsoft.AspNetCore.Mvc.Filters.IResultFilter", "Microsoft.AspNetCore.Mvc.Filters.IAsyncResultFilter",
    "Microsoft.AspNetCore.Builder.IMiddleware", "Microsoft.AspNetCore.Mvc.IActionResult", "Microsoft.AspNetCore.Mvc.IUrlHelper",
    "Microsoft.AspNetCore.Mvc.ModelBinding.IModelBinder", "Microsoft.AspNetCore.Mvc.ModelBinding.IValueProvider",
    "Microsoft.EntityFrameworkCore.DbContext", "Microsoft.EntityFrameworkCore.IEntityTypeConfiguration",
    "MediatR.IRequestHandler", "MediatR.INotificationHandler", "MediatR.IPipelineBehavior",
    "FluentValidation.IValidator", "AutoMapper.Profile", "System.IDisposable", "System.IAsyncDisposable",
)
# Attributes by which a framework finds a type, by part of the name.
FRAMEWORK_ATTRIBUTES = (
    "ApiController", "Controller", "Route", "Authorize", "ApiExplorerSettings", "ServiceFilter", "TypeFilter",
    "TestClass", "TestFixture", "Collection", "Trait", "DataContract", "JsonConverter", "XmlRoot", "Export", "Import", "PartCreationPolicy",
)
# Members of System.Type that inspect or call by name.
REFLECTION_MEMBERS = (
    "GetType", "GetMethod", "GetProperty", "GetField", "GetEvent", "GetMember", "GetMembers", "GetMethods", "GetProperties", "GetFields",
    "CreateInstance", "Invoke", "GetValue", "SetValue", "DynamicInvoke", "MakeGenericType", "MakeGenericMethod",
)


def reference_kind() -> Column:
    """The kind of a reference from its syntax: ``is_write``, the nearest deciding ancestor ``nearest``, the side of it the node is on, and the callee's name.

    A write is a write whatever stands around it; then the nearest ancestor decides.
    """
    nearest, side = F.col("nearest"), F.col("side")
    invocation = F.when(F.col("callee") == "nameof", "nameof").when(side == "callee", "invocation").otherwise("read")
    return F.when(F.col("is_write"), "write").when(nearest.isin("attribute", "typeof"), nearest).when((nearest == "cast") & (side == "type"), "cast").when(nearest == "invocation", invocation).otherwise("read")


def reference_locations(refs: DataFrame, *, kind: str | None = None, limit: int = 100) -> DataFrame:
    """The first locations of each symbol's references with their kind, the number of all references, and of those of the kind asked for.

    ``refs``: (symbol_id, doc_id, line, col) and the columns of ``reference_kind``. Counts are partial
    sums, and each task keeps ``limit`` rows of a symbol before anything is shuffled.
    """
    found = refs.withColumn("kind", reference_kind())
    wanted = P.equals(F.col("kind"), kind) if kind else F.lit(True)
    totals = found.groupBy("symbol_id").agg(F.count(F.lit(1)).alias("n_all"), F.count_if(wanted).alias("n_found"))
    first = per_group(found.where(wanted).select("symbol_id", "doc_id", "line", "col", "kind"), ["symbol_id"], ["doc_id", "line", "col", "kind"], limit)
    return first.join(totals, "symbol_id")


def named_like(names: str, listed: tuple[str, ...]) -> Column:
    """Whether any of an array of names holds any of the listed ones, in either case."""
    return F.exists(names, lambda n: reduce(lambda a, b: a | b, [F.contains(F.lower(n), F.lit(x.lower())) for x in listed]))


def _shown(accessibility: Column, include_private: bool, include_internal: bool) -> Column:
    hidden = [name for name, shown in (("Private", include_private), ("Internal", include_internal)) if not shown]
    return ~accessibility.isin(*hidden) if hidden else F.lit(True)


def _counts(refs: DataFrame) -> DataFrame:
    return refs.groupBy("symbol_id").agg(F.count(F.lit(1)).alias("n_refs"))


def unused_types(types: DataFrame, members: DataFrame, refs: DataFrame, *, max_refs: int = 1, include_private: bool = True, include_internal: bool = False) -> DataFrame:
    """Types with at most ``max_refs`` references of which no member is referenced more often.

    ``types``: (symbol_id, accessibility, in_source, is_implicit, is_extern, base_names, attributes);
    ``members``: (symbol_id, owner_id, method_kind). Implicit, external and framework types are left
    out; constructors do not save a type.
    """
    counts = _counts(refs)
    saved = members.where("method_kind is distinct from 'Constructor'").join(counts, "symbol_id").where(F.col("n_refs") > max_refs).select(F.col("owner_id").alias("symbol_id")).distinct()
    usable = types.where(F.col("in_source") & ~F.col("is_implicit") & ~F.col("is_extern") & _shown(F.col("accessibility"), include_private, include_internal))
    usable = usable.where(~named_like("base_names", FRAMEWORK_TYPES) & ~named_like("attributes", FRAMEWORK_ATTRIBUTES))
    out = usable.join(counts, "symbol_id", "left").withColumn("n_refs", F.coalesce("n_refs", F.lit(0))).where(F.col("n_refs") <= max_refs)
    return out.join(saved, "symbol_id", "left_anti").select("symbol_id", "n_refs")


def unused_members(members: DataFrame, refs: DataFrame, *, max_refs: int = 1, include_private: bool = True, include_internal: bool = False) -> DataFrame:
    """Ordinary methods that neither override nor can be overridden, properties and fields with at most ``max_refs`` references.

    ``members``: (symbol_id, member_kind, method_kind, accessibility, is_override, is_virtual, is_implicit, is_extern, in_source).
    """
    method = (F.col("method_kind") == "Ordinary") & ~F.col("is_override") & ~F.col("is_virtual")
    usable = members.where(F.col("in_source") & ~F.col("is_implicit") & ~F.col("is_extern") & _shown(F.col("accessibility"), include_private, include_internal))
    usable = usable.where(F.col("member_kind").isin("Property", "Field") | (F.col("member_kind") == "Method") & method)
    out = usable.join(_counts(refs), "symbol_id", "left").withColumn("n_refs", F.coalesce("n_refs", F.lit(0)))
    return out.where(F.col("n_refs") <= max_refs).select("symbol_id", "member_kind", "n_refs")


def is_reflection() -> Column:
    """Whether a call (``namespace``, ``type_name``, ``method``) inspects or calls by name."""
    name, method = F.col("type_name"), F.col("method")
    own = (name == "Type") & method.isin(*REFLECTION_MEMBERS) | (name == "Activator") | (name == "Delegate") & (method == "DynamicInvoke")
    return F.coalesce(F.startswith("namespace", F.lit("System.Reflection")) | (F.col("namespace") == "System") & own, F.lit(False))


def reflection_usage(calls: DataFrame) -> DataFrame:
    """The calls that use reflection, with the api as ``Type.Method`` and their text clipped to 200 characters."""
    found = calls.where(is_reflection())
    return found.withColumns({"api": F.concat_ws(".", "type_name", "method"), "context": P.clip(F.col("context"))})


def missing_members(interfaces: DataFrame, bases: DataFrame, members: DataFrame, implemented: DataFrame) -> DataFrame:
    """(type_id, declared_in, name, source): what a type must still write.

    ``interfaces`` and ``bases``: (type_id, base_id), all interfaces and all abstract base types up
    the chain; ``members``: (member_id, owner_id, name, is_static, is_abstract, is_override,
    accessibility); ``implemented``: (type_id, member_id). An interface member counts if it is neither
    static nor private. An abstract member is overridden by name, by a member of the type itself that
    is not abstract, so one override hides all overloads.
    """
    wanted = interfaces.join(members.withColumnRenamed("owner_id", "base_id"), "base_id").where(~F.col("is_static") & (F.col("accessibility") != "Private"))
    open_ = wanted.join(implemented, ["type_id", "member_id"], "left_anti").select("type_id", F.col("base_id").alias("declared_in"), "name", F.lit("interface").alias("source"))
    abstract = bases.join(members.withColumnRenamed("owner_id", "base_id"), "base_id").where("is_abstract")
    own = members.where("is_override and not is_abstract").select(F.col("owner_id").alias("type_id"), "name")
    left = abstract.join(own.distinct(), ["type_id", "name"], "left_anti").select("type_id", F.col("base_id").alias("declared_in"), "name", F.lit("abstract").alias("source"))
    return open_.unionByName(left).distinct()


def semantic_predicates(
    *, kinds: list[str] | None = None, is_async: bool | None = None, namespace: str | None = None, accessibility: str | None = None, is_static: bool | None = None, value_type: str | None = None,
    return_type: str | None = None, attributes: list[str] | None = None, parameter_includes: list[str] | None = None, parameter_excludes: list[str] | None = None,
) -> list[Column]:
    """The predicates that are given, each a column over symbols.

    Asynchrony, return type and parameters concern methods only, the type concerns properties and
    fields only; other kinds pass. Types go by their type kind, all else by symbol kind. Every attribute
    asked for must be there, by its class's own or full name.
    """
    kind = F.col("symbol_kind")
    method = lambda test: F.when(kind == "Method", test).otherwise(F.lit(True))
    valued = lambda test: F.when(kind.isin("Property", "Field"), test).otherwise(F.lit(True))
    has = lambda text: F.exists("parameter_types", lambda p: P.contains(p, text))
    tests = []
    if kinds:
        tests.append(F.lower(F.when(kind == "NamedType", F.col("type_kind")).otherwise(kind)).isin(*[k.lower() for k in kinds]))
    if is_async is not None:
        tests.append(method(F.col("is_async") == is_async))
    if namespace:
        tests.append(P.namespace_matches(F.col("namespace"), namespace))
    if accessibility:
        spelling = {"protectedinternal": "protectedorinternal", "privateprotected": "protectedandinternal"}
        tests.append(P.equals(F.col("accessibility"), spelling.get(accessibility.lower(), accessibility)))
    if is_static is not None:
        tests.append(F.col("is_static") == is_static)
    if value_type:
        tests.append(valued(P.contains(F.col("value_type"), value_type)))
    if return_type:
        tests.append(method(P.contains(F.col("value_type"), return_type)))
    named = lambda a: F.exists("attributes", lambda x: (F.lower(x) == a) | (F.lower(F.substring_index(x, ".", -1)) == a))
    tests += [named(a.lower()) for a in attributes or ()]
    tests += [method(has(t)) for t in parameter_includes or ()]
    tests += [method(~has(t)) for t in parameter_excludes or ()]
    return tests


def semantic_query(symbols: DataFrame, **predicates) -> DataFrame:
    """The symbols that meet all predicates given; see ``semantic_predicates``."""
    return symbols.where(reduce(lambda a, b: a & b, semantic_predicates(**predicates), F.lit(True)))


def attributes_like(attributes: DataFrame, text: str, *, scope: str | None = None, hints: bool = True) -> DataFrame:
    """Rows whose attribute name holds the text, in a scope ``project:X`` or ``file:suffix``; the first argument of an export as its hint.

    ``attributes``: (symbol_id, attribute, project, path, arguments).
    """
    where = P.contains(F.col("attribute"), text)
    if scope:
        name, _, value = scope.partition(":")
        if name not in ("project", "file"):
            raise ValueError("the scope must be project:X or file:suffix")
        where &= P.equals(F.col("project"), value) if name == "project" else F.endswith(F.lower("path"), F.lit(value.lower()))
    found = attributes.where(where)
    hint = F.when(F.contains(F.lower("attribute"), F.lit("export")), F.get("arguments", F.lit(0))) if hints else F.lit(None).cast("string")
    return found.withColumn("hint", hint)
