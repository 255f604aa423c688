"""Further registered queries: rules, metrics, flow, generated code and edits, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph import sinks
from factgraph.functions import metrics
from factgraph.operators import complexity, declarations, flow, graph, lookup, rewrite, rules, search
from factgraph.runtime import table
from factgraph.sources import solution, star

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _pick(names: tuple, index):
    """The element of a fixed list at an index, null beyond it."""
    return F.get(F.array(*[F.lit(n) for n in names]), index.cast("int"))


def _sql_pick(names: tuple, index: str) -> str:
    return f"[{', '.join(repr(n) if n is not None else 'NULL' for n in names)}][({index}) + 1]"


# --- references and symbols -------------------------------------------------------------------------------------

_KIND = """CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'write' WHEN l_linenumber % 5 = 0 THEN 'attribute' WHEN l_linenumber % 5 = 1 THEN 'typeof' WHEN l_linenumber % 5 = 2 AND l_quantity > 25 THEN 'cast'
WHEN l_linenumber % 5 = 3 AND l_suppkey % 3 = 0 THEN 'nameof' WHEN l_linenumber % 5 = 3 AND l_quantity > 25 THEN 'invocation' ELSE 'read' END"""


@query(f"""WITH r AS (SELECT l_partkey AS symbol_id, l_orderkey AS doc_id, l_linenumber AS line, l_quantity::INT AS col, {_KIND} AS kind FROM lineitem),
t AS (SELECT symbol_id, count(*) AS n_all, count(*) FILTER (kind = 'nameof') AS n_found FROM r GROUP BY 1)
SELECT symbol_id, doc_id, line, kind, n_all, n_found FROM r JOIN t USING (symbol_id) WHERE kind = 'nameof' QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY doc_id, line, col) <= 5""")
def find_reference_locations(spark, sf):
    return rules.reference_locations(star.refs(spark, sf), kind="NameOf", limit=5).select("symbol_id", "doc_id", "line", "kind", "n_all", "n_found")


_KINDS = ("Method", "Property", "Field", "NamedType")
_ACCESS = ("Public", "Internal", "Private", "ProtectedOrInternal")
_SYMBOLS = f"""SELECT p_partkey AS symbol_id, p_brand AS namespace, {_sql_pick(_KINDS, "p_partkey % 4")} AS symbol_kind, CASE WHEN p_size % 2 = 0 THEN 'Class' ELSE 'Struct' END AS type_kind, p_size % 3 = 0 AS is_async, p_size % 5 = 0 AS is_static,
{_sql_pick(_ACCESS, "p_size % 4")} AS accessibility, p_type AS value_type, string_split(p_name, ' ') AS parameter_types, ['Core.' || string_split(p_name, ' ')[2], CASE WHEN p_size > 20 THEN 'Obsolete' ELSE 'Serializable' END] AS attributes FROM part"""


def _symbols(spark, sf):
    p = table(spark, sf, "part")
    key, size = F.col("p_partkey"), F.col("p_size")
    return p.select(
        key.alias("symbol_id"), F.col("p_brand").alias("namespace"), _pick(_KINDS, key % 4).alias("symbol_kind"), F.when(size % 2 == 0, "Class").otherwise("Struct").alias("type_kind"), (size % 3 == 0).alias("is_async"),
        (size % 5 == 0).alias("is_static"), _pick(_ACCESS, size % 4).alias("accessibility"), F.col("p_type").alias("value_type"), F.split("p_name", " ").alias("parameter_types"),
        F.array(F.concat(F.lit("Core."), F.get(F.split("p_name", " "), F.lit(1))), F.when(size > 20, "Obsolete").otherwise("Serializable")).alias("attributes"),
    )


@query(f"""SELECT CASE symbol_kind WHEN 'NamedType' THEN type_kind ELSE symbol_kind END AS kind, count(*) AS n FROM ({_SYMBOLS}) WHERE (CASE symbol_kind WHEN 'NamedType' THEN type_kind ELSE symbol_kind END) IN ('Method', 'Property', 'Struct')
AND regexp_matches(namespace, '^brand#.*$', 'i') AND list_contains(attributes, 'Obsolete') AND (symbol_kind <> 'Method' OR (NOT is_async AND contains(lower(value_type), 'um') AND len(list_filter(parameter_types, lambda p: contains(lower(p), 'g'))) > 0
AND len(list_filter(parameter_types, lambda p: contains(lower(p), 'small'))) = 0)) AND (symbol_kind NOT IN ('Property', 'Field') OR contains(lower(value_type), 'eco')) GROUP BY 1""")
def semantic_query(spark, sf):
    found = rules.semantic_query(
        _symbols(spark, sf), kinds=["method", "PROPERTY", "Struct"], is_async=False, namespace="brand#*", value_type="Eco", return_type="UM", attributes=["obsolete"], parameter_includes=["G"], parameter_excludes=["small"],
    )
    return search.count_by(found.withColumn("kind", F.when(F.col("symbol_kind") == "NamedType", F.col("type_kind")).otherwise(F.col("symbol_kind"))), "kind")


@query(f"""SELECT symbol_id, symbol_kind FROM ({_SYMBOLS}) WHERE NOT is_static AND accessibility = 'ProtectedOrInternal' AND list_contains(list_transform(attributes, lambda a: lower(string_split(a, '.')[-1])), 'widget')""")
def semantic_query_attributes(spark, sf):
    return rules.semantic_query(_symbols(spark, sf), is_static=False, accessibility="protectedInternal", attributes=["Widget"]).select("symbol_id", "symbol_kind")


@query("""SELECT c_custkey AS symbol_id, attribute, CASE WHEN attribute LIKE '%Export%' THEN c_name END AS hint
FROM (SELECT *, CASE c_custkey % 3 WHEN 0 THEN 'ExportAttribute' WHEN 1 THEN 'ImportMany' ELSE 'Route' END AS attribute, 'src/p' || c_nationkey || '/file' || c_custkey % 7 || '.cs' AS path FROM customer)
WHERE contains(lower(attribute), 'port') AND ends_with(path, 'file3.cs')""")
def get_attributes(spark, sf):
    key = F.col("c_custkey")
    attribute = _pick(("ExportAttribute", "ImportMany", "Route"), key % 3)
    path = F.concat(F.lit("src/p"), "c_nationkey", F.lit("/file"), (key % 7).cast("string"), F.lit(".cs"))
    found = table(spark, sf, "customer").select(key.alias("symbol_id"), attribute.alias("attribute"), F.col("c_mktsegment").alias("project"), path.alias("path"), F.array("c_name").alias("arguments"))
    return rules.attributes_like(found, "Port", scope="file:File3.cs").select("symbol_id", "attribute", "hint")


# --- unused code, reflection, missing members -------------------------------------------------------------------

_BASES = ("System.IDisposable", "MediatR.IRequestHandler<T>", "My.Base", "My.Other")
_MARKS = ("RouteAttribute", "Obsolete", "Serializable", "ApiController")
_METHODS = ("Ordinary", "Constructor", "Ordinary")
_FACTS = f"""t AS (SELECT s_suppkey AS symbol_id, {_sql_pick(_ACCESS, "s_nationkey % 4")} AS accessibility, s_suppkey % 11 <> 0 AS in_source, s_suppkey % 13 = 0 AS is_implicit, {_sql_pick(_BASES, "s_suppkey % 4")} AS base, {_sql_pick(_MARKS, "s_nationkey % 4")} AS mark FROM supplier),
m AS (SELECT p_partkey + 1000000 AS symbol_id, p_partkey % (SELECT count(*) FROM supplier) + 1 AS owner_id, CASE p_size % 3 WHEN 0 THEN 'Method' WHEN 1 THEN 'Property' ELSE 'Event' END AS member_kind, CASE WHEN p_size % 3 = 0 THEN {_sql_pick(_METHODS, "p_partkey % 3")} END AS method_kind,
{_sql_pick(_ACCESS, "p_partkey % 4")} AS accessibility, p_size % 7 = 0 AS is_override, p_size % 5 = 0 AS is_virtual FROM part),
c AS (SELECT symbol_id, count(*) AS n FROM (SELECT l_suppkey AS symbol_id FROM lineitem WHERE l_quantity < 3 AND l_suppkey % 3 = 0 UNION ALL SELECT l_partkey + 1000000 FROM lineitem WHERE l_quantity < 3 AND l_discount > 0.05) GROUP BY 1)"""


def _facts(spark, sf):
    s, p, x = (table(spark, sf, n) for n in ("supplier", "part", "lineitem"))
    n, sk, nk, pk, size = s.count(), F.col("s_suppkey"), F.col("s_nationkey"), F.col("p_partkey"), F.col("p_size")
    types = s.select(
        sk.cast("long").alias("symbol_id"), _pick(_ACCESS, nk % 4).alias("accessibility"), (sk % 11 != 0).alias("in_source"), (sk % 13 == 0).alias("is_implicit"), F.lit(False).alias("is_extern"),
        F.array(_pick(_BASES, sk % 4)).alias("base_names"), F.array(_pick(_MARKS, nk % 4)).alias("attributes"),
    )
    members = p.select(
        (pk + 1000000).cast("long").alias("symbol_id"), (pk % n + 1).cast("long").alias("owner_id"), F.when(size % 3 == 0, "Method").when(size % 3 == 1, "Property").otherwise("Event").alias("member_kind"),
        F.when(size % 3 == 0, _pick(_METHODS, pk % 3)).alias("method_kind"), _pick(_ACCESS, pk % 4).alias("accessibility"), (size % 7 == 0).alias("is_override"), (size % 5 == 0).alias("is_virtual"),
        F.lit(False).alias("is_implicit"), F.lit(False).alias("is_extern"), F.lit(True).alias("in_source"),
    )
    few = x.where("l_quantity < 3")
    refs = few.where("l_suppkey % 3 = 0").select(F.col("l_suppkey").cast("long").alias("symbol_id")).unionByName(few.where("l_discount > 0.05").select((F.col("l_partkey") + 1000000).cast("long").alias("symbol_id")))
    return types, members, refs


@query(f"""WITH {_FACTS} SELECT t.symbol_id, coalesce(n, 0) AS n_refs FROM t LEFT JOIN c ON t.symbol_id = c.symbol_id WHERE in_source AND NOT is_implicit AND accessibility <> 'Internal' AND base NOT IN ('System.IDisposable', 'MediatR.IRequestHandler<T>') AND mark IN ('Obsolete', 'Serializable')
AND coalesce(n, 0) <= 1 AND t.symbol_id NOT IN (SELECT owner_id FROM m JOIN c ON m.symbol_id = c.symbol_id WHERE c.n > 1 AND method_kind IS DISTINCT FROM 'Constructor')""")
def find_unused_types(spark, sf):
    return rules.unused_types(*_facts(spark, sf))


@query(f"""WITH {_FACTS} SELECT m.symbol_id, member_kind, coalesce(n, 0) AS n_refs FROM m LEFT JOIN c ON m.symbol_id = c.symbol_id WHERE accessibility NOT IN ('Internal', 'Private') AND (member_kind = 'Property' OR method_kind = 'Ordinary' AND NOT is_override AND NOT is_virtual) AND coalesce(n, 0) <= 1""")
def find_unused_members(spark, sf):
    _, members, refs = _facts(spark, sf)
    return rules.unused_members(members, refs, include_private=False)


_SPACES, _TYPES, _CALLED = ("System", "System.Reflection.Emit", "My.App", None), ("Type", "Activator", "Delegate", "MethodInfo"), ("GetMethod", "ToString", "DynamicInvoke", "CreateInstance", "Invoke")


@query(f"""WITH c AS (SELECT doc_id, {_sql_pick(_SPACES, "doc_id % 4")} AS ns, {_sql_pick(_TYPES, "doc_id // 4 % 4")} AS t, {_sql_pick(_CALLED, "doc_id // 16 % 5")} AS m, text FROM documents)
SELECT doc_id, t || '.' || m AS api, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS context FROM c
WHERE starts_with(ns, 'System.Reflection') OR ns = 'System' AND (t = 'Type' AND m IN ('GetMethod', 'DynamicInvoke', 'CreateInstance', 'Invoke') OR t = 'Activator' OR t = 'Delegate' AND m = 'DynamicInvoke')""")
def find_reflection_usage(spark, sf):
    key = F.col("doc_id")
    fourth, sixteenth = F.floor(key / 4), F.floor(key / 16)
    calls = table(spark, sf, "documents").select("doc_id", _pick(_SPACES, key % 4).alias("namespace"), _pick(_TYPES, fourth % 4).alias("type_name"), _pick(_CALLED, sixteenth % 5).alias("method"), F.col("text").alias("context"))
    return rules.reflection_usage(calls).select("doc_id", "api", "context")


@query("""WITH i AS (SELECT s_suppkey AS type_id, 'i' || s_nationkey % 5 AS base FROM supplier UNION ALL SELECT s_suppkey, 'i' || s_suppkey % 3 FROM supplier), b AS (SELECT s_suppkey AS type_id, 'b' || s_nationkey % 4 AS base FROM supplier),
im AS (SELECT p_partkey AS member_id, 'i' || p_partkey % 5 AS owner, 'm' || p_partkey % 9 AS name, p_size % 10 = 0 AS is_static, p_size % 7 = 0 AS is_private FROM part WHERE p_partkey < 60),
bm AS (SELECT 'b' || p_partkey % 4 AS owner, 'a' || p_partkey % 11 AS name FROM part WHERE p_partkey < 60 AND p_size % 2 = 0), own AS (SELECT s_suppkey AS type_id, 'a' || s_suppkey % 11 AS name FROM supplier WHERE s_suppkey % 5 > 0)
SELECT DISTINCT type_id, base AS declared_in, name, 'interface' AS source FROM i JOIN im ON base = owner WHERE NOT is_static AND NOT is_private AND (type_id + member_id) % 3 > 0
UNION SELECT type_id, base, name, 'abstract' FROM b JOIN bm ON base = owner WHERE (type_id, name) NOT IN (SELECT (type_id, name) FROM own)""")
def get_missing_members(spark, sf):
    s, p = table(spark, sf, "supplier"), table(spark, sf, "part").where("p_partkey < 60")
    text = lambda prefix, n: F.concat(F.lit(prefix), n.cast("string"))
    sk, pk, size = F.col("s_suppkey"), F.col("p_partkey"), F.col("p_size")
    interfaces = s.select(sk.alias("type_id"), text("i", F.col("s_nationkey") % 5).alias("base_id")).unionByName(s.select(sk.alias("type_id"), text("i", sk % 3).alias("base_id"))).distinct()
    bases = s.select(sk.alias("type_id"), text("b", F.col("s_nationkey") % 4).alias("base_id"))
    members = p.select(pk.alias("member_id"), text("i", pk % 5).alias("owner_id"), text("m", pk % 9).alias("name"), (size % 10 == 0).alias("is_static"), F.lit(True).alias("is_abstract"), F.lit(False).alias("is_override"), F.when(size % 7 == 0, "Private").otherwise("Public").alias("accessibility"))
    abstract = p.where("p_size % 2 = 0").select((pk + 1000).alias("member_id"), text("b", pk % 4).alias("owner_id"), text("a", pk % 11).alias("name"), F.lit(False).alias("is_static"), F.lit(True).alias("is_abstract"), F.lit(False).alias("is_override"), F.lit("Public").alias("accessibility"))
    own = s.where("s_suppkey % 5 > 0").select((sk + 100000).alias("member_id"), sk.cast("string").alias("owner_id"), text("a", sk % 11).alias("name"), F.lit(False).alias("is_static"), F.lit(False).alias("is_abstract"), F.lit(True).alias("is_override"), F.lit("Public").alias("accessibility"))
    done = interfaces.join(members.select("member_id", F.col("owner_id").alias("base_id")), "base_id").where((F.col("type_id") + F.col("member_id")) % 3 == 0).select("type_id", "member_id")
    named = lambda f: f.withColumn("type_id", F.col("type_id").cast("string"))
    found = rules.missing_members(named(interfaces), named(bases), members.unionByName(abstract).unionByName(own), named(done))
    return found.withColumn("type_id", F.col("type_id").cast("long"))


# --- metrics ----------------------------------------------------------------------------------------------------

_NODES = ("if", "conditional", "case", "while", "for", "foreach", "catch", "conditional_access", "and", "or", "coalesce", "switch", "try", "lock", "using", "else", "block")
_TREE = f"""n AS (SELECT l_orderkey AS d, l_linenumber AS i, CASE WHEN l_linenumber > 1 THEN l_linenumber // 2 END AS p, min({_sql_pick(_NODES, "l_partkey % 17")}) AS k FROM lineitem GROUP BY 1, 2, 3),
w AS (SELECT d, i, k, []::VARCHAR[] AS above FROM n WHERE p IS NULL UNION ALL SELECT n.d, n.i, n.k, list_append(above, w.k) FROM n JOIN w ON n.d = w.d AND n.p = w.i),
x AS (SELECT *, len(list_filter(above, lambda a: a IN ('if', 'while', 'for', 'foreach', 'switch', 'catch'))) AS level, len(list_filter(above, lambda a: a IN ('if', 'while', 'for', 'foreach', 'switch', 'try', 'lock', 'using'))) AS nest FROM w),
m AS (SELECT d, (1 + count(*) FILTER (k IN {tuple(complexity.CYCLOMATIC)}))::BIGINT AS cyclomatic, (1 + count(*) FILTER (k IN {tuple(complexity.AUDIT)}))::BIGINT AS estimate, max(CASE WHEN k IN {tuple(complexity.NESTING)} THEN nest + 1 ELSE 0 END)::BIGINT AS nesting,
sum(CASE WHEN k IN ('if', 'while', 'for', 'foreach', 'switch', 'catch', 'conditional') THEN 1 + level WHEN k IN ('and', 'or', 'else') THEN 1 ELSE 0 END)::BIGINT AS cognitive FROM x GROUP BY 1)"""


def _trees(spark, sf):
    x, line = table(spark, sf, "lineitem"), F.col("l_linenumber")
    kind = _pick(_NODES, F.col("l_partkey") % 17)
    nodes = x.groupBy(F.col("l_orderkey").alias("doc_id"), line.alias("node_id"), F.when(line > 1, F.floor(line / 2).cast("int")).alias("parent_id")).agg(F.min(kind).alias("kind"))
    return complexity.method_metrics(complexity.ancestors(nodes), ["doc_id"])


@query(f"""WITH RECURSIVE {_TREE} SELECT d AS doc_id, cyclomatic, estimate, nesting, cognitive, '' AS hint FROM m""")
def get_complexity_metrics(spark, sf):
    return _trees(spark, sf)


@query(f"""WITH RECURSIVE {_TREE} SELECT d % 50 AS file, round_even(avg(cyclomatic), 2)::DOUBLE AS avg_cyclomatic, max(cyclomatic) AS max_cyclomatic, max(nesting) AS max_nesting, sum(d % 90)::BIGINT AS total_loc, count(*) AS n_methods FROM m GROUP BY 1""")
def get_complexity_totals(spark, sf):
    methods = _trees(spark, sf).withColumns({"file": F.col("doc_id") % 50, "loc": F.col("doc_id") % 90})
    return complexity.file_totals(methods, ["file"])


@query(r"""SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '^\s*(//|/\*|\*|$)')))::BIGINT AS loc FROM documents""")
def get_code_lines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", metrics.code_lines(F.col("text")).alias("loc"))


# --- graphs -----------------------------------------------------------------------------------------------------

_STEPS = "g AS (SELECT DISTINCT 'u' || user_id % 30 AS src, 'u' || (user_id * 7 + length(event_type)) % 30 AS dst FROM events)"


def _steps(spark, sf):
    e = table(spark, sf, "events")
    name = lambda n: F.concat(F.lit("u"), (n % 30).cast("string"))
    return e.select(name(F.col("user_id")).alias("src"), name(F.col("user_id") * 7 + F.length("event_type")).alias("dst")).distinct()


@query(f"""WITH RECURSIVE {_STEPS}, w AS (SELECT 'u1' AS node, 0 AS depth UNION SELECT dst, depth + 1 FROM w JOIN g ON node = src WHERE depth < 2), n AS (SELECT node, min(depth) AS depth FROM w GROUP BY 1),
k AS (SELECT src, dst, a.depth FROM g JOIN n a ON src = a.node JOIN n b ON dst = b.node WHERE a.depth < 2), r AS (SELECT src, dst FROM k UNION SELECT r.src, k.dst FROM r JOIN k ON r.dst = k.src)
SELECT src, dst, depth, (dst, src) IN (SELECT (src, dst) FROM r) OR src = dst AS is_cycle, EXISTS (SELECT 1 FROM n WHERE depth = 2) AS truncated_by_depth, false AS truncated_by_nodes FROM k""")
def get_call_graph_edges(spark, sf):
    return graph.call_graph(_steps(spark, sf), "u1", max_depth=2)[1]


@query(f"""WITH {_STEPS}, a AS (SELECT src AS node, row_number() OVER (ORDER BY src) AS o, count(*) OVER () AS n FROM g WHERE dst = 'u1' AND src <> 'u1')
SELECT 'u1' AS node, 0 AS depth, 0::BIGINT AS ordinal, true AS truncated_by_depth, (SELECT max(n) FROM a) > 2 AS truncated_by_nodes UNION ALL SELECT node, 1, o, true, n > 2 FROM a WHERE o <= 2""")
def get_call_graph_callers(spark, sf):
    return graph.call_graph(_steps(spark, sf), "u1", direction="callers", max_depth=1, max_nodes=3)[0]


@query("""WITH RECURSIVE g AS (SELECT DISTINCT p_brand AS src, 'Brand#' || (p_size % 5 + 1) || (p_partkey % 3 + 1) AS dst FROM part WHERE p_size % 11 = 3 AND p_brand < 'Brand#33'), r AS (SELECT src, dst FROM g UNION SELECT r.src, g.dst FROM r JOIN g ON r.dst = g.src),
m AS (SELECT a.src AS node, min(a.dst) AS component FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src GROUP BY 1) SELECT g.src, g.dst, x.component FROM g JOIN m x ON g.src = x.node JOIN m y ON g.dst = y.node WHERE x.component = y.component""")
def find_namespace_cycles(spark, sf):
    p = table(spark, sf, "part").where("p_size % 11 = 3 and p_brand < 'Brand#33'")
    uses = p.select(F.col("p_brand").alias("src"), F.concat(F.lit("Brand#"), (F.col("p_size") % 5 + 1).cast("string"), (F.col("p_partkey") % 3 + 1).cast("string")).alias("dst"))
    return graph.cycle_edges(uses)


# --- flow -------------------------------------------------------------------------------------------------------

_ACTIONS = ("declare", "read", "write", "address")
_ACCESSES = f"""a AS (SELECT l_orderkey AS d, 'v' || l_suppkey % 4 AS v, l_linenumber * 10 + l_quantity::INT % 10 AS pos, {_sql_pick(_ACTIONS, "l_partkey % 4")} AS act, l_discount > 0.05 AS cond, l_tax > 0.06 AS cap FROM lineitem),
u AS (SELECT o_orderkey AS region_id, v, pos, act, cond, cap, pos >= 20 AND pos < 50 AS ins FROM orders JOIN a ON o_orderkey = d),
f AS (SELECT region_id, v, bool_or(ins AND act = 'declare') AS declared, bool_or(pos < 20 AND act = 'declare') AS known, bool_or(ins AND act = 'read') AS ri, bool_or(ins AND act = 'write') AS wi, bool_or(NOT ins AND act = 'read') AS ro, bool_or(NOT ins AND act = 'write') AS wo,
bool_or(ins AND act = 'write' AND NOT cond) AS aa, bool_or(pos >= 50 AND act = 'read') AS ra, bool_or(cap) AS cap, bool_or(cap AND ins) AS ci, bool_or(cap AND NOT ins) AS co, bool_or(ins AND act = 'address') AS ad,
min({{'pos': pos, 'late': act = 'write', 'sets': act = 'write' AND NOT cond}}) FILTER (ins AND act IN ('read', 'write')) AS first FROM u GROUP BY 1, 2)"""
_SETS = {
    "declared": "declared", "always_assigned": "aa", "flows_in": "known AND first IS NOT NULL AND NOT coalesce(first.sets, false)", "flows_out": "wi AND ra", "read_inside": "ri", "written_inside": "wi",
    "read_outside": "ro", "written_outside": "wo", "captured": "cap", "captured_inside": "ci", "captured_outside": "co", "address_taken": "ad",
}


def _regions(spark, sf):
    regions = table(spark, sf, "orders").select(F.col("o_orderkey").alias("region_id"), F.col("o_orderkey").alias("doc_id"), F.lit(20).alias("region_start"), F.lit(50).alias("region_end"))
    x = table(spark, sf, "lineitem")
    accesses = x.select(
        F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("v"), (F.col("l_suppkey") % 4).cast("string")).alias("variable"), (F.col("l_linenumber") * 10 + F.col("l_quantity").cast("int") % 10).alias("pos"),
        _pick(_ACTIONS, F.col("l_partkey") % 4).alias("action"), (F.col("l_discount") > 0.05).alias("conditional"), (F.col("l_tax") > 0.06).alias("captured"),
    )
    return regions, accesses


@query(f"""WITH {_ACCESSES} SELECT o_orderkey AS region_id, {', '.join(f"coalesce(string_agg(v, ',' ORDER BY v) FILTER ({test}), '') AS {name}" for name, test in _SETS.items())} FROM orders LEFT JOIN f ON o_orderkey = region_id GROUP BY 1""")
def analyze_data_flow(spark, sf):
    return flow.data_flow(*_regions(spark, sf)).select("region_id", *[F.array_join(s, ",").alias(s) for s in _SETS])


@query("""WITH j AS (SELECT l_orderkey AS d, l_linenumber * 10 AS pos, ['return', 'goto', 'break'][l_partkey % 3 + 1] AS kind, CASE WHEN l_partkey % 3 > 0 THEN l_suppkey % 80 END AS target, l_quantity > 10 AS reachable, l_quantity < 40 AS completes FROM lineitem),
x AS (SELECT o_orderkey AS r, j.*, pos >= 20 AND pos < 50 AS ins, coalesce(target >= 20 AND target < 50, false) AS inn FROM orders JOIN j ON o_orderkey = d),
s AS (SELECT r, arg_min(reachable, pos) AS sr, arg_max(er, pos) AS er FROM (SELECT r, pos, min(reachable) AS reachable, max(reachable AND completes) AS er FROM x WHERE ins GROUP BY 1, 2) GROUP BY 1)
SELECT o_orderkey AS region_id, count(*) FILTER (NOT ins AND inn) AS n_entries, count(*) FILTER (ins AND (kind = 'return' OR NOT inn)) AS n_exits, count(*) FILTER (ins AND kind = 'return') AS n_returns, coalesce(any_value(sr), true) AS start_reachable, coalesce(any_value(er), true) AS end_reachable
FROM orders LEFT JOIN x ON o_orderkey = x.r LEFT JOIN s ON o_orderkey = s.r GROUP BY 1""")
def analyze_control_flow(spark, sf):
    regions, _ = _regions(spark, sf)
    x = table(spark, sf, "lineitem")
    pos = (F.col("l_linenumber") * 10).alias("pos")
    jumps = x.select(F.col("l_orderkey").alias("doc_id"), pos, _pick(("return", "goto", "break"), F.col("l_partkey") % 3).alias("kind"), F.when(F.col("l_partkey") % 3 > 0, F.col("l_suppkey") % 80).alias("target"))
    reachable, completes = F.col("l_quantity") > 10, F.col("l_quantity") < 40
    # One statement a place: it is reachable if all facts say so, and completes if one that is reached does.
    at = x.groupBy(F.col("l_orderkey").alias("doc_id"), pos).agg(F.min(reachable).alias("reachable"), F.max(reachable & completes).alias("completes"))
    first = flow.control_flow(regions, jumps, at)
    ends = flow.control_flow(regions, jumps, at.withColumn("reachable", F.lit(True))).select("region_id", F.col("end_reachable").alias("end_"))
    return first.join(ends, "region_id").withColumn("end_reachable", F.col("end_")).drop("end_")


# --- generated code and edits -----------------------------------------------------------------------------------

@query("""SELECT p_partkey AS method_id, 'int M' || p_partkey || '(' || CASE p_size % 4 WHEN 0 THEN 'string b, int x' WHEN 1 THEN 'long n = 5, int a, string b' WHEN 2 THEN 'string c = "q", int a' ELSE 'int a, string b, bool c = true' END || ')' AS new_signature,
CASE p_size % 4 WHEN 0 THEN '(2, 1)' WHEN 1 THEN '(5, 1, 2)' WHEN 2 THEN '("q", 1)' ELSE '(1, b: 2)' END AS new_args FROM part""")
def change_signature(spark, sf):
    p, k = table(spark, sf, "part"), F.col("p_size") % 4
    params = lambda *rows: F.array(*[F.struct(F.lit(a).alias("name"), F.lit(t).alias("type"), F.lit(d).cast("string").alias("default")) for a, t, d in rows])
    two, three = params(("a", "int", None), ("b", "string", None)), params(("a", "int", None), ("b", "string", None), ("c", "bool", "true"))
    no = F.array().cast("array<string>")
    added = lambda *rows: F.array(*[F.struct(F.lit(a).alias("name"), F.lit(t).alias("type"), F.lit(d).cast("string").alias("default"), F.lit(at).cast("int").alias("position")) for a, t, d, at in rows])
    none = added().cast("array<struct<name:string,type:string,default:string,position:int>>")
    case = lambda *cs: F.when(k == 0, cs[0]).when(k == 1, cs[1]).when(k == 2, cs[2]).otherwise(cs[3])
    # Reorder and rename; insert in front; remove one and add in front; leave as it is.
    methods = p.select(
        F.col("p_partkey").alias("method_id"), F.concat(F.lit("M"), "p_partkey").alias("name"), F.lit("int").alias("return_type"), case(two, two, two, three).alias("params"), case(no, no, F.array(F.lit("b")), no).alias("removed"),
        F.when(k == 0, F.create_map(F.lit("a"), F.lit("x"))).otherwise(F.create_map().cast("map<string,string>")).alias("renamed"), F.when(k == 0, F.array(F.lit("b"), F.lit("a"))).alias("order"),
        case(none, added(("n", "long", "5", 0)), added(("c", "string", '"q"', 0)), none).alias("added"), k.alias("k"),
    )
    done = rewrite.change_signature(methods)
    arg = lambda name, text: F.struct(F.lit(name).cast("string").alias("name"), F.lit(text).alias("text"))
    calls = methods.select("method_id", F.lit(0).alias("call_id"), F.when(F.col("k") == 3, F.array(arg(None, "1"), arg("b", "2"))).otherwise(F.array(arg(None, "1"), arg(None, "2"))).alias("args"))
    new = rewrite.changed_calls(done, calls).select("method_id", "new_args")
    return done.select("method_id", "new_signature").join(new, "method_id")


@query("""SELECT p_brand AS type_id, 'public T(' || string_agg(p_type || ' f' || p_partkey, ', ' ORDER BY p_partkey) || ')' || chr(10) || '{' || chr(10) || string_agg('    _F' || p_partkey || ' = f' || p_partkey || CASE WHEN p_size > 25 THEN ' ?? default' ELSE '' END || ';', chr(10) ORDER BY p_partkey) || chr(10) || '}' AS code, count(*)::INT AS n_parameters FROM part WHERE p_size % 3 > 0 AND p_size % 5 > 0 GROUP BY 1""")
def generate_constructor(spark, sf):
    p, size = table(spark, sf, "part"), F.col("p_size")
    members = p.select(F.col("p_brand").alias("type_id"), F.lit("T").alias("type_name"), F.lit(True).alias("is_public"), F.col("p_partkey").alias("ordinal"), F.concat(F.lit("_F"), "p_partkey").alias("name"), F.lit("Field").alias("kind"), F.col("p_type").alias("value_type"), (size % 3 == 0).alias("is_static"), (size % 5 == 0).alias("is_const"), (size > 25).alias("is_nullable"), F.lit(True).alias("can_set"))
    return rewrite.constructors(members, to_default=True)


@query("""WITH g AS (SELECT l_orderkey AS o, string_agg('        ArgumentNullException.ThrowIfNull(p' || l_linenumber || ');' || chr(10), '' ORDER BY l_linenumber) AS t FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 40 OR l_discount > 0.08) GROUP BY 1)
SELECT o_orderkey AS method_id, CASE WHEN t IS NOT NULL AND o_orderkey % 4 > 0 THEN chr(10) || t END AS new_text, CASE WHEN t IS NULL THEN 'no nullable parameters' WHEN o_orderkey % 4 = 0 THEN 'method has no body' END AS error FROM orders LEFT JOIN g ON o = o_orderkey""")
def add_null_checks(spark, sf):
    key = F.col("o_orderkey")
    methods = table(spark, sf, "orders").select(key.alias("method_id"), key.alias("doc_id"), F.when(key % 4 > 0, F.lit(7)).alias("body_start"))
    x = table(spark, sf, "lineitem")
    parameters = x.groupBy(F.col("l_orderkey").alias("method_id"), F.col("l_linenumber").alias("ordinal")).agg(F.max(F.col("l_quantity") > 40).alias("is_reference"), F.max(F.col("l_discount") > 0.08).alias("is_nullable_value"))
    return rewrite.null_checks(methods, parameters.withColumn("name", F.concat(F.lit("p"), F.col("ordinal").cast("string")))).select("method_id", "new_text", "error")


@query("""WITH m AS (SELECT p_brand AS type_id, list('F' || p_partkey ORDER BY p_partkey) AS f FROM part WHERE p_size % 4 > 0 GROUP BY 1)
SELECT type_id, 'public override bool Equals(object? obj)' || chr(10) || '{' || chr(10) || '    return obj is T other && Equals(other);' || chr(10) || '}' || chr(10) || chr(10)
|| 'public bool Equals(T? other)' || chr(10) || '{' || chr(10) || '    if (other is null) return false;' || chr(10) || '    if (ReferenceEquals(this, other)) return true;' || chr(10) || '    return ' || array_to_string(list_transform(f, lambda n: n || ' == other.' || n), ' && ') || ';' || chr(10) || '}' || chr(10) || chr(10)
|| 'public override int GetHashCode()' || chr(10) || '{' || chr(10) || '    return HashCode.Combine(' || array_to_string(f[1:8], ', ') || ');' || chr(10) || '}' AS code, len(f)::INT AS n_members FROM m""")
def generate_equality_members(spark, sf):
    p = table(spark, sf, "part")
    members = p.select(F.col("p_brand").alias("type_id"), F.lit("T").alias("type_name"), F.col("p_partkey").alias("ordinal"), F.concat(F.lit("F"), "p_partkey").alias("name"), F.lit("Field").alias("kind"), (F.col("p_size") % 4 == 0).alias("is_static"), F.lit(False).alias("is_const"), F.lit(None).cast("boolean").alias("has_getter"))
    return rewrite.equality_members(members, operators=False)


@query("""SELECT p_brand AS type_id, string_agg(line, chr(10) ORDER BY line) AS code, count(*) AS n_members FROM (SELECT p_brand, CASE WHEN p_size % 2 = 0 THEN 'public override int M' || p_partkey || '(int a) => throw new NotImplementedException();' ELSE 'public int M' || p_partkey || ' { get => throw new NotImplementedException(); set => throw new NotImplementedException(); }' END AS line FROM part) GROUP BY 1""")
def implement_missing_members(spark, sf):
    p, even = table(spark, sf, "part"), F.col("p_size") % 2 == 0
    return rewrite.member_stubs(p.select(F.col("p_brand").alias("type_id"), F.concat(F.lit("M"), "p_partkey").alias("name"), F.when(even, "Method").otherwise("Property").alias("kind"), F.lit("int").alias("value_type"), F.lit("int a").alias("parameters"), F.when(even, "abstract").otherwise("interface").alias("source")))


_USES = "SELECT DISTINCT l_partkey AS symbol_id, l_suppkey AS doc_id, l_orderkey * 10 + l_linenumber AS a FROM lineitem"


def _uses(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_partkey").alias("symbol_id"), F.col("l_suppkey").alias("doc_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("span_start"), F.lit(4).alias("span_length")).distinct()


@query(f"""SELECT p_partkey AS symbol_id, 0::BIGINT AS span_start, 'private int _x' || p_partkey || ';' || chr(10) || 'public int X' || p_partkey || ' {{ get => _x' || p_partkey || '; set => _x' || p_partkey || ' = value; }}' AS new_text FROM part
UNION ALL SELECT symbol_id, a, 'X' || symbol_id FROM ({_USES}) JOIN part ON symbol_id = p_partkey""")
def encapsulate_field(spark, sf):
    fields = table(spark, sf, "part").select(F.col("p_partkey").alias("symbol_id"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("span_start"), F.lit(5).alias("span_length"), F.concat(F.lit("_X"), "p_partkey").alias("name"), F.lit("int").alias("value_type"))
    return rewrite.encapsulate_fields(fields, _uses(spark, sf)).select("symbol_id", "span_start", "new_text")


@query(f"""WITH v AS (SELECT p_partkey AS symbol_id, CASE WHEN p_size % 2 = 0 THEN '(' || p_brand || ')' ELSE p_brand END AS t FROM part WHERE p_size % 3 > 0) SELECT symbol_id, 0::BIGINT AS span_start, '' AS new_text FROM v UNION ALL SELECT symbol_id, a, t FROM ({_USES}) JOIN v USING (symbol_id)""")
def inline_variable(spark, sf):
    size = F.col("p_size")
    variables = table(spark, sf, "part").select(F.col("p_partkey").alias("symbol_id"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("span_start"), F.lit(5).alias("span_length"), F.col("p_brand").alias("initializer"), (size % 2 == 0).alias("is_compound"), (size % 3 == 0).alias("is_written"))
    return rewrite.inline_variables(variables, _uses(spark, sf)).select("symbol_id", "span_start", "new_text")


@query("""SELECT doc_id, CASE WHEN length(text) >= 20 THEN substr(text, 1, 3) || 'var v = ' || substr(text, 11, 5) || ';' || chr(10) || substr(text, 4, 7) || 'v' || substr(text, 16) ELSE text END AS text FROM documents""")
def extract_variable(spark, sf):
    """The edits, applied to the documents."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    requests = d.where(F.length("text") >= 20).select(F.col("doc_id").alias("request_id"), "doc_id", F.lit(3).alias("statement_start"), F.lit(10).alias("span_start"), F.lit(5).alias("span_length"), F.lit("v").alias("name"))
    return lookup.apply_edits(d, rewrite.extract_variables(requests, d))


@query("""SELECT doc_id, CASE WHEN length(text) < 30 OR doc_id % 3 = 2 THEN text ELSE substr(text, 1, 4) || CASE doc_id % 3 WHEN 0 THEN 'var b = N(a);' ELSE 'N(a, c);' END || substr(text, 13, 12) || chr(10) || 'private ' || CASE doc_id % 3 WHEN 0 THEN 'int N(long a)' ELSE 'void N(long a, object c)' END
|| chr(10) || '{' || chr(10) || substr(text, 5, 8) || CASE doc_id % 3 WHEN 0 THEN chr(10) || 'return b;' ELSE '' END || chr(10) || '}' || chr(10) || substr(text, 25) END AS text FROM documents""")
def extract_method(spark, sf):
    """The edits, applied to the documents; more than one result is an error and changes nothing."""
    d, k = table(spark, sf, "documents").select("doc_id", "text"), F.col("doc_id") % 3
    at = d.where(F.length("text") >= 30).select("doc_id")
    names = lambda *n: F.array(*map(F.lit, n)).cast("array<string>")
    requests = at.select(F.col("doc_id").alias("region_id"), "doc_id", F.lit(4).alias("region_start"), F.lit(12).alias("region_end"), F.lit(24).alias("insert_at"), F.lit("N").alias("name"))
    found = at.select(F.col("doc_id").alias("region_id"), F.when(k == 1, names("a", "c")).otherwise(names("a")).alias("flows_in"), F.when(k == 0, names("b")).when(k == 1, names()).otherwise(names("b", "c")).alias("flows_out"), names("b").alias("declared"))
    types = at.select(F.col("doc_id").alias("region_id"), F.lit("a").alias("variable"), F.lit("long").alias("value_type")).unionByName(at.select(F.col("doc_id").alias("region_id"), F.lit("b").alias("variable"), F.lit("int").alias("value_type")))
    edits = rewrite.extract_methods(requests, found, types, d).where("error is null").select("doc_id", "span_start", "span_length", "new_text")
    return lookup.apply_edits(d, edits)


_PROVIDERS = (("click", "fix", "Remove unused"), ("click", "refactoring", "Extract method"), ("error", "fix", "Add using"), ("view", "refactoring", "Extract variable"), ("purchase", "fix", "Cast explicitly"))
_ACTION_SQL = f"""p(id, kind, title) AS (VALUES {', '.join(str(x) for x in _PROVIDERS)}), d AS (SELECT user_id AS doc_id, event_type AS id, event_id % 300 AS a, event_id % 300 + 10 AS b FROM events), q AS (SELECT DISTINCT user_id AS request_id FROM events),
c AS (SELECT request_id, kind, title, count(*) AS n FROM q JOIN d ON request_id = doc_id JOIN p USING (id) WHERE a <= 140 AND 100 <= b GROUP BY 1, 2, 3)"""


def _actions(spark, sf):
    e = table(spark, sf, "events")
    start = F.col("event_id") % 300
    found = e.select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("id"), start.alias("span_start"), (start + 10).alias("span_end"))
    positions = e.select(F.col("user_id").alias("request_id"), F.col("user_id").alias("doc_id"), F.lit(100).alias("start"), F.lit(140).alias("end")).distinct()
    rows = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("id", "kind", "title"), r, strict=True)]) for r in _PROVIDERS])
    return rewrite.code_actions(positions, found, spark.range(1).select(F.explode(rows).alias("p")).select("p.*"))


@query(f"""WITH {_ACTION_SQL} SELECT * FROM c""")
def get_code_actions_at_position(spark, sf):
    return _actions(spark, sf)


@query(f"""WITH {_ACTION_SQL} SELECT request_id, title FROM q LEFT JOIN (SELECT * FROM c WHERE contains(lower(title), 'extract') QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY title) = 1) USING (request_id)""")
def apply_code_action_by_title(spark, sf):
    found = _actions(spark, sf)
    requests = table(spark, sf, "events").select(F.col("user_id").alias("request_id"), F.lit("EXTRACT").alias("wanted")).distinct()
    return rewrite.action_by_title(requests, found).select("request_id", "title")


@query("""WITH d AS (SELECT doc_id, 'first' || chr(10) || '  int unused' || doc_id || ';  ' || chr(10) || 'int a; int b;' AS text, length('int unused' || doc_id || ';') AS n FROM documents)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'first' || chr(10) || 'int a; int b;' WHEN doc_id % 3 = 1 THEN 'first' || chr(10) || '  int unused' || doc_id || ';  ' || chr(10) || ' int b;' ELSE text END AS text FROM d""")
def apply_code_fix(spark, sf):
    """A variable alone on its line goes with the line, one among others alone; other diagnostics change nothing."""
    key = F.col("doc_id")
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("first\n  int unused"), "doc_id", F.lit(";  \nint a; int b;")).alias("text"))
    size = F.length(F.concat(F.lit("int unused"), "doc_id", F.lit(";")))
    start = F.when(key % 3 == 0, 8).otherwise(8 + size + 3)
    found = d.select("doc_id", F.when(key % 3 == 2, "CS9999").otherwise("CS0168").alias("id"), start.cast("int").alias("span_start"), (start + F.when(key % 3 == 0, size).otherwise(6)).cast("int").alias("span_end"))
    return lookup.apply_edits(d, rewrite.fix_edits(found, d).drop("id"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN 'unbalanced (' WHEN 2 THEN 'unterminated string' WHEN 3 THEN 'unbalanced [' END AS error FROM documents""")
def validate_code(spark, sf):
    codes = ("class A { void M() { x[0] = ')'; /* } */ } // (\n string s = \"{\\\"\"; }", "f((1);", 'x = "open;\n', "a[b(c])")
    return table(spark, sf, "documents").select("doc_id", rewrite.bracket_errors(_pick(codes, F.col("doc_id") % 4)).alias("error"))


@query("""SELECT doc_id, 'class A' || chr(10) || '{' || chr(10) || '    int x' || doc_id || ';' || chr(10) || '    void M() {' || chr(10) || '        y();' || chr(10) || '    }' || chr(10) || '}' AS text FROM documents""")
def format_document_batch(spark, sf):
    text = F.concat(F.lit("class A  \n{\n\tint x"), "doc_id", F.lit(";\n void M() {\ny();\t \n}\n  }"))
    return table(spark, sf, "documents").select("doc_id", rewrite.formatted(text).alias("text"))


@query("""WITH d AS (SELECT source AS type_id, 'f' || (doc_id % 10) AS name, row_number() OVER (PARTITION BY source, doc_id % 10 ORDER BY doc_id) - 1 AS i, text FROM documents),
q AS (SELECT s_nationkey AS batch_id, s_suppkey AS request_id, 'src' || (s_suppkey % 4) AS type_id, 'f' || (s_suppkey % 12) AS name, s_suppkey % 3 * 20 AS i, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier),
r AS (SELECT batch_id, request_id, n, substr(text, 6, 40) AS source, d.i AS di, (q.type_id, q.name) IN (SELECT (type_id, name) FROM d) AS known FROM q LEFT JOIN d ON q.type_id = d.type_id AND q.name = d.name AND q.i = d.i)
SELECT batch_id, request_id, CASE WHEN n <= 3 THEN source END AS source, CASE WHEN n > 3 THEN 'too many methods' WHEN NOT known THEN 'not found' WHEN di IS NULL THEN 'index out of range' END AS error FROM r""")
def get_method_source_batch(spark, sf):
    from pyspark.sql import Window

    d, s, k = table(spark, sf, "documents"), table(spark, sf, "supplier"), F.col("s_suppkey")
    name = F.concat(F.lit("f"), (F.col("doc_id") % 10).cast("string"))
    rank = F.row_number().over(Window.partitionBy("source", name).orderBy("doc_id")) - 1
    declared = d.select(F.col("source").alias("type_id"), name.alias("name"), rank.cast("long").alias("ordinal"), "doc_id", F.lit(5).alias("span_start"), F.lit(40).alias("span_length"))
    requests = s.select(F.col("s_nationkey").alias("batch_id"), k.alias("request_id"), F.concat(F.lit("src"), (k % 4).cast("string")).alias("type_id"), F.concat(F.lit("f"), (k % 12).cast("string")).alias("name"), (k % 3 * 20).alias("index"))
    return declarations.sources_batch(requests, declared, d, max_methods=3).select("batch_id", "request_id", "source", "error")


# --- sinks and paths --------------------------------------------------------------------------------------------

@query("""SELECT event_id, to_json({'eventId': event_id, 'userId': user_id, 'eventType': event_type, 'at': strftime(ts, '%Y-%m-%dT%H:%M:%SZ')})::VARCHAR AS json FROM events""")
def json_events(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", sinks.utc_stamp(F.col("ts")).alias("at"))
    return sinks.json_lines(e).select(F.get_json_object("json", "$.eventId").cast("long").alias("event_id"), "json")


@query("""SELECT doc_id, CASE WHEN source = 'src1' THEN lang || '/f' || doc_id || '.cs' ELSE '/root/' || source || '/' || lang || '/f' || doc_id || '.cs' END AS path FROM documents""")
def relative_paths(spark, sf):
    path = F.concat(F.lit("file:///root\\x\\..\\"), "source", F.lit("/./"), "lang", F.lit("/f"), "doc_id", F.lit(".cs"))
    return table(spark, sf, "documents").select("doc_id", solution.relative(solution.slashes(path), "/root/src1").alias("path"))
