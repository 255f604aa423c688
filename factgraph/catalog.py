"""The registered queries over the driver's tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factgraph.functions import metrics, predicates
from factgraph.operators import audits, declarations, graph, lookup, references, search
from factgraph.runtime import table
from factgraph.sources import star

_QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None):
    """Register a query under its function's name with the SQL that must give the same rows."""

    def add(f):
        _QUERIES[f.__name__] = (f, sql)
        return f

    return add


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.coupling(star.type_uses(spark, sf_dir), _members(spark, sf_dir), min_efferent=5)


def _all() -> dict:
    from factgraph import catalog_rules

    return {**_QUERIES, **catalog_rules.QUERIES}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}


def _members(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_partkey").alias("owner_id"))


_USES = "SELECT DISTINCT l_partkey AS owner_id, l_suppkey AS used_id FROM lineitem WHERE l_partkey <> l_suppkey"


@query(f"""WITH e AS ({_USES}), o AS (SELECT owner_id AS id, count(*) AS efferent FROM e GROUP BY 1), i AS (SELECT used_id AS id, count(*) AS afferent FROM e GROUP BY 1),
m AS (SELECT l_partkey AS id, count(*) AS members FROM lineitem GROUP BY 1)
SELECT o.id, efferent, coalesce(afferent, 0) AS afferent, members, round_even(0.4 * efferent + 0.4 * members + 0.2 * coalesce(afferent, 0), 2)::DOUBLE AS score
FROM o JOIN m ON o.id = m.id LEFT JOIN i ON o.id = i.id WHERE efferent >= 20 AND members >= 20 ORDER BY score DESC, o.id LIMIT 20""")
def find_god_objects(spark, sf):
    return audits.coupling(star.type_uses(spark, sf), _members(spark, sf))


@query("""WITH f AS (SELECT * FROM part WHERE contains(lower(p_name), 'a')) SELECT p_partkey AS symbol_id, p_name AS name, p_type AS type_kind, (SELECT count(*) FROM f) AS total, (SELECT count(*) FROM f) > 60 AS has_more, CASE WHEN (SELECT count(*) FROM f) > 60 THEN 60 END::INT AS next_offset FROM f ORDER BY p_name, p_partkey LIMIT 50 OFFSET 10""")
def search_symbols(spark, sf):
    return search.search_symbols(star.symbols(spark, sf), "A", limit=50, offset=10).select("symbol_id", "name", "type_kind", "total", "has_more", "next_offset")


@query("""SELECT p_partkey AS symbol_id, p_name AS name FROM part WHERE regexp_matches(p_name, '^.*a.e.*$', 'i')""")
def search_symbols_glob(spark, sf):
    return star.symbols(spark, sf).where(predicates.glob(F.col("name"), "*a?e*")).select("symbol_id", "name")


_KIND = """CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'write' WHEN l_linenumber % 5 = 0 THEN 'attribute' WHEN l_linenumber % 5 = 1 THEN 'typeof' WHEN l_linenumber % 5 = 2 AND l_quantity > 25 THEN 'cast'
WHEN l_linenumber % 5 = 3 AND l_suppkey % 3 = 0 THEN 'nameof' WHEN l_linenumber % 5 = 3 AND l_quantity > 25 THEN 'invocation' ELSE 'read' END"""


@query(f"""SELECT l_partkey AS symbol_id, {_KIND} AS kind, count(*) AS n, count(DISTINCT l_orderkey) AS n_docs FROM lineitem GROUP BY 1, 2""")
def find_references(spark, sf):
    return references.reference_counts(star.refs(spark, sf))


@query("""WITH s AS (SELECT l_partkey, l_suppkey, count(*) AS n, list_sort(list(DISTINCT {'d': l_orderkey, 'l': l_linenumber})) AS s FROM lineitem GROUP BY 1, 2)
SELECT l_partkey AS symbol_id, l_suppkey AS in_symbol_id, n, array_to_string(list_transform(s[1:3], lambda x: x.d::VARCHAR || ':' || x.l::VARCHAR), ',') AS first_spots FROM s""")
def find_callers(spark, sf):
    return references.callers(star.refs(spark, sf))


@query("""SELECT l_suppkey AS in_symbol_id, l_partkey AS symbol_id, l_orderkey AS doc_id, l_linenumber AS line FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey, l_linenumber) = 1""")
def get_outgoing_calls(spark, sf):
    return references.outgoing(star.refs(spark, sf))


@query("""SELECT p_partkey AS symbol_id, coalesce(n, 0) AS n_refs FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON p_partkey = l_partkey WHERE coalesce(n, 0) <= 20 AND NOT contains(p_type, 'STEEL')""")
def find_unused_code(spark, sf):
    exempt = star.symbols(spark, sf).where(F.contains("type_kind", F.lit("STEEL"))).select("symbol_id")
    return references.unused(star.symbols(spark, sf), star.refs(spark, sf), 20, exempt).select("symbol_id", "n_refs")


@query("""SELECT p_partkey AS symbol_id, coalesce(n, 0) AS n_refs, coalesce(d, 0) AS n_docs, CASE WHEN p_size > 10 THEN 'error' ELSE 'warning' END AS severity, p_size <= 10 OR n IS NULL AS safe FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n, count(DISTINCT l_orderkey) AS d FROM lineitem GROUP BY 1) ON p_partkey = l_partkey""")
def analyze_change_impact(spark, sf):
    return references.change_impact(star.symbols(spark, sf), star.refs(spark, sf), "change_accessibility").select("symbol_id", "n_refs", "n_docs", "severity", "safe")


@query("""SELECT o_custkey, o_orderkey, ordinal FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS ordinal FROM orders) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY (ordinal <> 2)::INT, ordinal) = 1""")
def get_method_signature(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return search.overload(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], 2).select("o_custkey", "o_orderkey", F.col("ordinal").cast("long").alias("ordinal"))


@query("""SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS ordinal FROM orders""")
def get_method_overloads(spark, sf):
    """Every overload of a name, in order."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1
    return o.select("o_custkey", "o_orderkey", rank.cast("long").alias("ordinal"))


@query("""WITH s AS (SELECT l_orderkey AS doc_id, l_linenumber AS node_id, l_linenumber * 5 AS a, l_linenumber * 5 + l_quantity::INT AS b FROM lineitem)
SELECT doc_id, 22 AS pos, node_id FROM s WHERE a <= 22 AND 22 < b QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY b - a, a, node_id) = 1""")
def get_containing_member(spark, sf):
    x = table(spark, sf, "lineitem")
    start = F.col("l_linenumber") * 5
    spans = x.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("node_id"), start.alias("span_start"), (start + F.col("l_quantity").cast("int")).alias("span_end"))
    positions = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(22).alias("pos"))
    return search.enclosing(positions, spans).select("doc_id", "pos", "node_id")


_EDGES = """e AS (SELECT 'c' || c_custkey AS t, 'n' || c_nationkey AS b FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"""


@query(f"""WITH {_EDGES} SELECT t AS src, b AS dst, 1 AS depth FROM e UNION ALL SELECT x.t, y.b, 2 FROM e x JOIN e y ON x.b = y.t""")
def get_base_types(spark, sf):
    return graph.closure(star.type_edges(spark, sf), "type_id", "base_id")


@query(f"""WITH {_EDGES}, c AS (SELECT t, b, 1 AS depth FROM e UNION ALL SELECT x.t, y.b, 2 FROM e x JOIN e y ON x.b = y.t) SELECT b AS base_id, count(*) AS n_derived, sum((depth = 1)::INT)::BIGINT AS n_direct FROM c GROUP BY 1""")
def get_derived_types(spark, sf):
    pairs = graph.closure(star.type_edges(spark, sf), "type_id", "base_id")
    return pairs.groupBy(F.col("dst").alias("base_id")).agg(F.count(F.lit(1)).alias("n_derived"), F.sum((F.col("depth") == 1).cast("int")).alias("n_direct"))


_CALLS = "calls AS (SELECT DISTINCT src, dst FROM (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL)"


@query(f"""WITH RECURSIVE {_CALLS}, w AS (SELECT (SELECT min(src) FROM calls) AS node, 0 AS depth UNION ALL SELECT dst, depth + 1 FROM w JOIN calls ON node = src WHERE depth < 3) SELECT node, min(depth) AS depth FROM w GROUP BY 1""")
def get_call_graph(spark, sf):
    edges = star.calls(spark, sf)
    root = edges.agg(F.min("src")).first()[0]
    return graph.bounded_search(edges, root, max_depth=3)


@query(f"""WITH RECURSIVE {_CALLS}, w AS (SELECT src, dst FROM calls UNION SELECT w.src, calls.dst FROM w JOIN calls ON w.dst = calls.src), m AS (SELECT a.src, a.dst FROM w a JOIN w b ON a.src = b.dst AND a.dst = b.src) SELECT src AS node, min(dst) AS component, count(*) AS size FROM m GROUP BY 1""")
def find_circular_dependencies(spark, sf):
    return graph.on_cycles(star.calls(spark, sf))


@query("""SELECT p_partkey AS symbol_id, p_size::BIGINT AS complexity FROM part WHERE p_size > 10 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT') ORDER BY p_size DESC, p_partkey LIMIT 50""")
def find_untested_code(spark, sf):
    return _uncovered(spark, sf).select("symbol_id", F.col("size").cast("long").alias("complexity")).orderBy(F.desc("complexity"), "symbol_id").limit(50)


def _uncovered(spark, sf):
    """Public symbols that no test reaches."""
    x, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    edges = x.select(F.concat(F.lit("o"), "l_orderkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"))
    roots = o.where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("o"), "o_orderkey").alias("node"))
    hit = graph.reached(edges, roots).where(F.startswith("node", F.lit("p"))).select(F.expr("cast(substring(node, 2) as bigint)").alias("symbol_id"))
    return star.symbols(spark, sf).where("accessibility = 'Public'").join(hit, "symbol_id", "left_anti")


_DIAG = """d AS (SELECT user_id AS doc_id, event_type AS id, CASE WHEN value > 75 THEN 'Error' WHEN value > 50 THEN 'Warning' WHEN value > 25 THEN 'Info' ELSE 'Hidden' END AS severity, props AS message, event_id AS ordinal FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY event_id) = 1)"""


@query(f"""WITH {_DIAG} SELECT doc_id, id, severity, ordinal FROM d WHERE severity <> 'Hidden'""")
def get_diagnostics(spark, sf):
    return audits.diagnostics(star.diagnostics(spark, sf)).select("doc_id", "id", "severity", "ordinal")


@query(f"""WITH {_DIAG} (SELECT 'diagnostics' AS section, id AS key, count(*) AS n FROM d WHERE severity <> 'Hidden' GROUP BY 2 ORDER BY n DESC, key LIMIT 5)
UNION ALL (SELECT 'severity', severity, count(*) AS n FROM d GROUP BY 2 ORDER BY n DESC, severity LIMIT 5)
UNION ALL (SELECT 'unused', p_type, count(*) AS n FROM part LEFT JOIN (SELECT l_partkey, count(*) AS c FROM lineitem GROUP BY 1) ON p_partkey = l_partkey WHERE coalesce(c, 0) <= 20 GROUP BY 2 ORDER BY n DESC, p_type LIMIT 5)
UNION ALL (SELECT 'hotspots', id::VARCHAR, efferent FROM (SELECT o.id, efferent, round_even(0.4 * efferent + 0.4 * members + 0.2 * coalesce(afferent, 0), 2) AS score FROM (SELECT owner_id AS id, count(*) AS efferent FROM ({_USES}) GROUP BY 1) o
JOIN (SELECT l_partkey AS id, count(*) AS members FROM lineitem GROUP BY 1) m ON o.id = m.id LEFT JOIN (SELECT used_id AS id, count(*) AS afferent FROM ({_USES}) GROUP BY 1) i ON o.id = i.id WHERE efferent >= 20 AND members >= 20 ORDER BY score DESC, o.id LIMIT 5))
UNION ALL (SELECT 'uncovered', p_brand, count(*) AS n FROM part WHERE p_size > 10 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT') GROUP BY 2 ORDER BY n DESC, p_brand LIMIT 5)""")
def get_project_health(spark, sf):
    found = star.diagnostics(spark, sf)
    unused = references.unused(star.symbols(spark, sf), star.refs(spark, sf), 20)
    hotspots = audits.coupling(star.type_uses(spark, sf), _members(spark, sf), limit=5)
    return audits.health([audits.top(audits.diagnostics(found), "id", "diagnostics"), audits.top(audits.diagnostics(found, include_hidden=True), "severity", "severity"), audits.top(unused, "type_kind", "unused"), hotspots.select(F.lit("hotspots").alias("section"), F.col("id").cast("string").alias("key"), F.col("efferent").alias("n")), audits.top(_uncovered(spark, sf), "namespace", "uncovered")])


@query("""SELECT p_brand AS namespace, count(*) AS n_members, sum((p_size > 10)::INT)::BIGINT AS n_public, count(DISTINCT p_type) AS n_kinds, bool_or(p_size > 49) AS has_large FROM part GROUP BY 1""")
def get_type_overview(spark, sf):
    return star.symbols(spark, sf).groupBy("namespace").agg(F.count(F.lit(1)).alias("n_members"), F.count_if(F.col("accessibility") == "Public").alias("n_public"), F.countDistinct("type_kind").alias("n_kinds"), F.bool_or(F.col("size") > 49).alias("has_large"))


@query("""WITH x AS (SELECT s_nationkey AS project, s_suppkey AS id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS o, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier)
SELECT project, any_value(n) AS n, string_agg(id::VARCHAR, ',' ORDER BY o) FILTER (WHERE o <= 3) || CASE WHEN any_value(n) > 3 THEN ',... and ' || (any_value(n) - 3) || ' more' ELSE '' END AS items FROM x GROUP BY 1""")
def get_project_structure(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("project"), F.col("s_suppkey").alias("item"))
    return declarations.listing(s, limit=3).select("project", "n", F.array_join("items", ",").alias("items"))


@query(f"""WITH {_CALLS}, n AS (SELECT src AS x FROM calls UNION SELECT dst FROM calls UNION SELECT 'alone ' || r_name FROM region)
SELECT 0 AS part, 'graph TD' AS line UNION ALL SELECT 1, '  ' || translate(src, '.- ', '___') || '["' || src || '"] --> ' || translate(dst, '.- ', '___') || '["' || dst || '"]' FROM calls
UNION ALL SELECT 1, '  ' || translate(x, '.- ', '___') || '["' || x || '"]' FROM n WHERE x NOT IN (SELECT src FROM calls)""")
def dependency_graph(spark, sf):
    return graph.mermaid(star.calls(spark, sf), _projects(spark, sf))


@query(f"""WITH {_CALLS}, n AS (SELECT src AS x FROM calls UNION SELECT dst FROM calls UNION SELECT 'alone ' || r_name FROM region)
SELECT x AS node, (SELECT coalesce(string_agg(dst, ',' ORDER BY dst), '') FROM calls WHERE src = x) AS targets FROM n""")
def dependency_map(spark, sf):
    return graph.adjacency(star.calls(spark, sf), _projects(spark, sf)).select("node", F.array_join("targets", ",").alias("targets"))


def _projects(spark, sf):
    calls = star.calls(spark, sf)
    alone = table(spark, sf, "region").select(F.concat(F.lit("alone "), "r_name").alias("node"))
    return calls.select(F.col("src").alias("node")).unionByName(calls.select(F.col("dst").alias("node"))).unionByName(alone).distinct()


@query("""SELECT coalesce(a.p, b.p) AS path, CASE WHEN a.p IS NULL THEN 'insert' WHEN b.p IS NULL THEN 'delete' WHEN a.h <> b.h THEN 'update' ELSE 'keep' END AS action
FROM (SELECT 'f' || doc_id AS p, md5(text) AS h FROM documents WHERE doc_id > 20) a FULL OUTER JOIN (SELECT 'f' || doc_id AS p, md5(CASE WHEN source = 'src0' THEN text || ' ' ELSE text END) AS h FROM documents WHERE lang <> 'es') b ON a.p = b.p""")
def sync_documents(spark, sf):
    d = table(spark, sf, "documents")
    path = F.concat(F.lit("f"), "doc_id").alias("path")
    known = d.where("doc_id > 20").select(path, F.md5("text").alias("hash"))
    listed = d.where("lang <> 'es'").select(path, F.md5(F.when(F.col("source") == "src0", F.concat("text", F.lit(" "))).otherwise(F.col("text"))).alias("hash"))
    return audits.sync(known, listed)


_MARKED = "SELECT c_custkey AS owner_id, CASE WHEN c_custkey % 5 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END || CASE WHEN c_custkey % 2 = 1 THEN 'Attribute' ELSE '' END AS attribute FROM customer"


def _marked(spark, sf):
    key, segment = F.col("c_custkey"), F.col("c_mktsegment")
    attribute = F.concat(F.when(key % 5 == 0, F.lower(segment)).otherwise(segment), F.when(key % 2 == 1, "Attribute").otherwise(""))
    return table(spark, sf, "customer").select(key.alias("owner_id"), attribute.alias("attribute"))


@query(f"""SELECT owner_id, attribute FROM ({_MARKED}) WHERE lower(attribute) IN ('household', 'householdattribute')""")
def find_attribute_usages(spark, sf):
    return declarations.attribute_usages(_marked(spark, sf), "HouseHold")


@query(f"""SELECT owner_id, attribute FROM ({_MARKED}) WHERE lower(attribute) = 'householdattribute'""")
def find_attribute_usages_full_name(spark, sf):
    return declarations.attribute_usages(_marked(spark, sf), "HouseHoldAttribute")


_CLOSURE = f"{_EDGES}, c AS (SELECT t, b, 1 AS depth FROM e UNION ALL SELECT x.t, y.b, 2 FROM e x JOIN e y ON x.b = y.t)"
_OWN = "own AS (SELECT 's' || s_suppkey AS type_id, 'm' || (s_suppkey % 7) AS name, 'Method' AS kind, s_suppkey % 3 AS ordinal FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'm' || (n_nationkey % 5), 'Method', 0 FROM nation UNION ALL SELECT 'r' || r_regionkey, 'm' || r_regionkey, 'Property', 1 FROM region)"


def _declared_members(spark, sf):
    def part(name: str, key: str, mod: int, kind: str, ordinal) -> DataFrame:
        id_ = F.col(key).cast("long")
        return table(spark, sf, name).select(F.concat(F.lit(name[0]), key).alias("type_id"), F.concat(F.lit("m"), (id_ % mod).cast("string")).alias("name"), F.lit(kind).alias("kind"), ordinal(id_).cast("long").alias("ordinal"))

    one, two, three = part("supplier", "s_suppkey", 7, "Method", lambda k: k % 3), part("nation", "n_nationkey", 5, "Method", lambda _: F.lit(0)), part("region", "r_regionkey", 1000, "Property", lambda _: F.lit(1))
    return one.unionByName(two).unionByName(three)


@query(f"""WITH {_CLOSURE}, {_OWN}, a AS (SELECT type_id, name, kind, ordinal, 0 AS depth, type_id AS declared_in FROM own UNION ALL SELECT t, name, kind, ordinal, depth, b FROM c JOIN own ON b = type_id)
SELECT type_id, name, kind, declared_in, depth FROM a QUALIFY row_number() OVER (PARTITION BY type_id, name, kind ORDER BY depth, ordinal, declared_in) = 1""")
def get_type_members(spark, sf):
    bases = graph.closure(star.type_edges(spark, sf), "type_id", "base_id")
    return declarations.members(_declared_members(spark, sf), bases).select("type_id", "name", "kind", "declared_in", "depth")


@query(f"""WITH {_OWN}, w AS (SELECT DISTINCT 's' || l_suppkey AS type_id FROM lineitem WHERE l_returnflag = 'R')
SELECT type_id, name, CASE WHEN name IS NULL AND type_id NOT IN (SELECT 's' || s_suppkey FROM supplier) THEN 'not found' END AS error FROM (SELECT type_id FROM w UNION ALL SELECT 'x1') LEFT JOIN own USING (type_id)""")
def get_type_members_batch(spark, sf):
    wanted = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.concat(F.lit("s"), "l_suppkey").alias("type_id")).distinct()
    found = declarations.members(_declared_members(spark, sf), spark.range(0).select(F.lit("").alias("src"), F.lit("").alias("dst"), F.lit(0).alias("depth")), inherited=False, limit=50)
    wanted = wanted.unionByName(spark.range(1).select(F.lit("x1").alias("type_id")))
    known = table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("type_id"), F.lit(True).alias("known"))
    out = wanted.join(known, "type_id", "left").join(found.select("type_id", "name"), "type_id", "left")
    return out.select("type_id", "name", F.when(F.col("known").isNull(), "not found").alias("error"))


@query(f"""WITH {_CLOSURE}, h AS (SELECT t, b, depth FROM c WHERE NOT starts_with(t, 'c')), u AS (SELECT t, string_agg(b, ',' ORDER BY depth, b) AS bases FROM h GROUP BY 1),
i AS (SELECT t, string_agg(b, ',' ORDER BY b) AS interfaces FROM c WHERE starts_with(t, 'c') GROUP BY 1), k AS (SELECT b, t, row_number() OVER (PARTITION BY b ORDER BY t) AS rk FROM e WHERE NOT starts_with(t, 'c')),
d AS (SELECT b, count(*) AS n, string_agg(t, ',' ORDER BY t) FILTER (rk <= 5) AS derived FROM k GROUP BY 1)
SELECT type_id, coalesce(bases, '') AS bases, coalesce(interfaces, '') AS interfaces, coalesce(n, 0) AS n_derived, coalesce(derived, '') AS derived
FROM (SELECT t AS type_id FROM e UNION SELECT b FROM e) LEFT JOIN u ON type_id = u.t LEFT JOIN i ON type_id = i.t LEFT JOIN d ON type_id = d.b""")
def get_type_hierarchy(spark, sf):
    edges = star.type_edges(spark, sf)
    types = edges.select("type_id").unionByName(edges.select(F.col("base_id").alias("type_id"))).distinct()
    found = declarations.hierarchy(types, edges, graph.closure(edges, "type_id", "base_id"), max_derived=5)
    return found.select("type_id", *[F.array_join(c, ",").alias(c) for c in ("bases", "interfaces")], "n_derived", F.array_join("derived", ",").alias("derived"))


@query(f"""WITH {_CLOSURE} SELECT b AS base_id, t AS type_id, depth FROM c WHERE starts_with(b, 'r') AND starts_with(t, 's')""")
def find_implementations(spark, sf):
    pairs = graph.closure(star.type_edges(spark, sf), "type_id", "base_id")
    return pairs.where(F.startswith("dst", F.lit("r")) & F.startswith("src", F.lit("s"))).select(F.col("dst").alias("base_id"), F.col("src").alias("type_id"), "depth")


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, ['AddScoped', 'TryAddTransient', 'AddKeyedSingleton', 'AddHostedService', 'UseRouting', 'MapGet', 'AddSingletonFor'][l_linenumber] AS method, l_partkey AS service, CASE WHEN l_linestatus = 'F' THEN l_suppkey ELSE l_partkey END AS implementation FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber <= 7)
SELECT *, CASE WHEN contains(method, 'Scoped') THEN 'Scoped' WHEN contains(method, 'Transient') THEN 'Transient' WHEN contains(method, 'Singleton') THEN 'Singleton' ELSE 'Singleton' END AS lifetime FROM c WHERE method NOT IN ('UseRouting', 'MapGet')""")
def get_di_registrations(spark, sf):
    names = F.array(*map(F.lit, ("AddScoped", "TryAddTransient", "AddKeyedSingleton", "AddHostedService", "UseRouting", "MapGet", "AddSingletonFor")))
    receiver = F.when(F.col("l_returnflag") == "A", "IServiceCollection").otherwise("IRouter")
    args = F.when(F.col("l_linestatus") == "F", F.array("l_partkey", "l_suppkey")).otherwise(F.array("l_partkey"))
    calls = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.get(names, F.col("l_linenumber") - 1).alias("method"), receiver.alias("receiver"), args.alias("type_args"))
    return declarations.registrations(calls).select("l_orderkey", "l_linenumber", "method", "service", "implementation", "lifetime")


@query("""SELECT s_suppkey AS project, CASE WHEN s_suppkey % 3 < 2 THEN 'pkg' || s_nationkey END AS package, CASE s_suppkey % 3 WHEN 0 THEN '1.' || s_nationkey WHEN 1 THEN 'unknown' END AS version, CASE WHEN s_suppkey % 3 = 1 THEN 'all' END AS private_assets FROM supplier
UNION ALL SELECT s_suppkey, 'child', '2', NULL FROM supplier WHERE s_suppkey % 3 = 0""")
def get_nuget_dependencies(spark, sf):
    s = table(spark, sf, "supplier")
    line = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit('<PackageReference Include="pkg'), "s_nationkey", F.lit('" Version="1.'), "s_nationkey", F.lit('" /><PackageReference Include="child"><Version>2</Version></PackageReference>')))
    line = line.when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit('<PackageReference Include="broken & bad" /><PackageReference Include="pkg'), "s_nationkey", F.lit('" PrivateAssets="all"/>'))).otherwise("")
    xml = F.concat(F.lit("<Project><ItemGroup>"), line, F.lit("</ItemGroup></Project>"))
    return declarations.packages(s.select(F.col("s_suppkey").alias("project"), xml.alias("xml"))).drop("exclude_assets")


_PATHS = "SELECT source, text, 'root/' || source || '/' || lang || '/f' || doc_id || '.g.cs' AS path, doc_id FROM documents"


def _paths(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("source", "text", F.concat(F.lit("root/"), "source", F.lit("/"), "lang", F.lit("/f"), "doc_id", F.lit(".g.cs")).alias("path"), "doc_id")


@query(f"""SELECT source, path FROM ({_PATHS}) WHERE contains(lower(path), 'f1') QUALIFY row_number() OVER (PARTITION BY source ORDER BY path) = 1""")
def get_generated_code(spark, sf):
    return declarations.first_containing(_paths(spark, sf), "F1", keys=["source"]).select("source", "path")


@query(f"""SELECT source, count(*) AS n_files, sum(len(string_split(text, chr(10))))::BIGINT AS n_lines FROM ({_PATHS}) WHERE path IS NULL OR doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) GROUP BY 1""")
def get_source_generators(spark, sf):
    written = table(spark, sf, "labels").select("doc_id").where("doc_id is not null")
    found = declarations.generated(_paths(spark, sf), written, key="doc_id")
    return found.groupBy("source").agg(F.count(F.lit(1)).alias("n_files"), F.sum(F.size(F.split("text", "\n", -1))).alias("n_lines"))


@query("""WITH d AS (SELECT user_id AS doc_id, CASE event_type WHEN 'error' THEN 'CS0162' ELSE event_type END AS id, event_id % 500 AS a, event_id % 500 + 10 AS b, event_id AS ordinal FROM events), p AS (SELECT DISTINCT doc_id, id, 250 AS pos FROM d),
r AS (SELECT d.*, CASE WHEN a <= pos AND pos < b THEN 1 WHEN abs(a - pos) < 50 THEN 2 ELSE 3 END AS tier FROM p JOIN d USING (doc_id, id))
SELECT doc_id, id, tier, ordinal, CASE WHEN id = 'CS0162' THEN 'Remove unreachable code;Fix control flow logic' ELSE 'Review diagnostic message for fix guidance;Consult C# documentation for ' || id END AS suggestions
FROM r QUALIFY row_number() OVER (PARTITION BY doc_id, id ORDER BY tier, a, ordinal) = 1""")
def get_code_fixes(spark, sf):
    start = F.col("event_id") % 500
    id_ = F.when(F.col("event_type") == "error", "CS0162").otherwise(F.col("event_type"))
    found = table(spark, sf, "events").select(F.col("user_id").alias("doc_id"), id_.alias("id"), start.alias("span_start"), (start + 10).alias("span_end"), F.col("event_id").alias("ordinal"))
    positions = found.select("doc_id", "id").distinct().withColumn("pos", F.lit(250))
    return declarations.suggestions(declarations.nearest_diagnostic(positions, found)).select("doc_id", "id", "tier", "ordinal", F.array_join("suggestions", ";").alias("suggestions"))


@query("""WITH m AS (SELECT o_orderkey AS method_id, ['Create', 'Build', 'New', 'Get', 'Set'][o_orderkey % 5 + 1] || o_orderpriority AS name, o_custkey % 50 AS owner_id, o_custkey AS value_type FROM orders WHERE o_orderkey % 5 < 3)
SELECT value_type, method_id, row_number() OVER (PARTITION BY value_type ORDER BY owner_id, name, method_id) - 1 AS ordinal, count(*) OVER (PARTITION BY value_type) AS n_factories FROM m WHERE owner_id <> value_type QUALIFY ordinal < 5""")
def get_instantiation_options(spark, sf):
    names = F.array(*map(F.lit, ("Create", "Build", "New", "Get", "Set")))
    name = F.concat(F.get(names, (F.col("o_orderkey") % 5).cast("int")), "o_orderpriority")
    methods = table(spark, sf, "orders").select(F.col("o_orderkey").alias("method_id"), name.alias("name"), (F.col("o_custkey") % 50).alias("owner_id"), F.col("o_custkey").alias("value_type"))
    return declarations.factories(methods).select("value_type", "method_id", F.col("ordinal").cast("long").alias("ordinal"), "n_factories")


_WIDE = ", ".join(f"('{a}', '{b}')" for a, wider in declarations.WIDENING.items() for b in wider)
_NUMERIC = ", ".join(f"'{a}'" for a in declarations.WIDENING)


@query(f"""WITH {_CLOSURE}, wide(a, b) AS (VALUES {_WIDE}), t AS (SELECT [{_NUMERIC}, 'object'] AS names),
p AS (SELECT names[c_custkey % 13 + 1] AS source, names[c_custkey // 13 % 13 + 1] AS target FROM customer, t UNION SELECT 'n' || n_nationkey, 'r' || (n_nationkey % 5) FROM nation UNION SELECT 'r' || (n_nationkey % 5), 'n' || n_nationkey FROM nation)
SELECT source, target, CASE WHEN source = target THEN 'Identity' WHEN (source, target) IN (SELECT (a, b) FROM wide) THEN 'ImplicitNumeric' WHEN source IN ({_NUMERIC}) AND target IN ({_NUMERIC}) THEN 'ExplicitNumeric'
WHEN target = 'object' THEN 'Boxing' WHEN source = 'object' THEN 'Unboxing' WHEN (source, target) IN (SELECT (t, b) FROM c) THEN 'ImplicitReference' WHEN (target, source) IN (SELECT (t, b) FROM c) THEN 'Explicit' ELSE 'None' END AS conversion FROM p""")
def check_type_compatibility(spark, sf):
    names = F.array(*map(F.lit, [*declarations.WIDENING, "object"]))
    key, n = F.col("c_custkey"), table(spark, sf, "nation")
    numeric = table(spark, sf, "customer").select(F.get(names, (key % 13).cast("int")).alias("source"), F.get(names, (F.floor(key / 13) % 13).cast("int")).alias("target"))
    a, b = F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), (F.col("n_nationkey") % 5).cast("string"))
    pairs = numeric.unionByName(n.select(a.alias("source"), b.alias("target"))).unionByName(n.select(b.alias("source"), a.alias("target"))).distinct()
    return declarations.conversion(pairs, graph.closure(star.type_edges(spark, sf), "type_id", "base_id"))


@query("""WITH d AS (SELECT source AS type_id, 'f' || (doc_id % 10) AS name, row_number() OVER (PARTITION BY source, doc_id % 10 ORDER BY doc_id) - 1 AS i, text FROM documents),
q AS (SELECT s_suppkey AS request_id, 'src' || (s_suppkey % 4) AS type_id, 'f' || (s_suppkey % 12) AS name, s_suppkey % 3 * 20 AS i FROM supplier), r AS (SELECT request_id, substr(text, 6, 40) AS source, d.i AS di, (q.type_id, q.name) IN (SELECT (type_id, name) FROM d) AS known FROM q LEFT JOIN d ON q.type_id = d.type_id AND q.name = d.name AND q.i = d.i)
SELECT request_id, source, CASE WHEN di IS NOT NULL THEN len(string_split(source, chr(10))) END::BIGINT AS n_lines, CASE WHEN NOT known THEN 'not found' WHEN di IS NULL THEN 'index out of range' END AS error FROM r""")
def get_method_source(spark, sf):
    d, s = table(spark, sf, "documents"), table(spark, sf, "supplier")
    name = F.concat(F.lit("f"), (F.col("doc_id") % 10).cast("string"))
    rank = F.row_number().over(Window.partitionBy("source", name).orderBy("doc_id")) - 1
    declared = d.select(F.col("source").alias("type_id"), name.alias("name"), rank.cast("long").alias("ordinal"), "doc_id", F.lit(5).alias("span_start"), F.lit(40).alias("span_length"))
    k = F.col("s_suppkey")
    requests = s.select(k.alias("request_id"), F.concat(F.lit("src"), (k % 4).cast("string")).alias("type_id"), F.concat(F.lit("f"), (k % 12).cast("string")).alias("name"), (k % 3 * 20).alias("index"))
    return declarations.sources(requests, declared, d).withColumn("n_lines", F.col("n_lines").cast("long"))


@query(f"""WITH {_DIAG}, s AS (SELECT doc_id, sum((severity = 'Error')::INT)::BIGINT AS e, sum((severity = 'Warning')::INT)::BIGINT AS w, sum((severity = 'Info')::INT)::BIGINT AS i FROM d GROUP BY 1), t AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT x.doc_id, (len(string_split(text, chr(10))) + CASE WHEN x.doc_id % 3 = 0 THEN 3 ELSE 0 END)::BIGINT AS n_lines, CASE WHEN x.doc_id % 3 = 0 THEN 2 ELSE 0 END::BIGINT AS n_usings, CASE WHEN x.doc_id % 3 = 0 THEN 'N' || x.doc_id % 7 || '.X' END AS namespace, coalesce(e, 0) AS n_errors, coalesce(w, 0) AS n_warnings, coalesce(i, 0) AS n_infos, coalesce(n, 0) AS n_types FROM documents x LEFT JOIN s ON x.doc_id = s.doc_id LEFT JOIN t ON x.doc_id = l_orderkey""")
def get_file_overview(spark, sf):
    types = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"))
    head = F.concat(F.lit("using A;\nglobal using static B.C;\nnamespace N"), (F.col("doc_id") % 7).cast("string"), F.lit(".X;\n"))
    documents = table(spark, sf, "documents").withColumn("text", F.concat(F.when(F.col("doc_id") % 3 == 0, head).otherwise(""), "text"))
    return declarations.file_overview(documents, audits.diagnostics(star.diagnostics(spark, sf)), types)


_DIRS = "SELECT ['root', 'root/src0', 'root/src1/en', 'root/src2/fr', 'other'][r_regionkey + 1] AS dir, r_name AS project FROM region"


@query(f"""SELECT path, arg_max(project, length(dir)) AS project FROM ({_PATHS}) LEFT JOIN ({_DIRS}) ON starts_with(path, dir || '/') WHERE path IS NOT NULL GROUP BY 1""")
def sync_new_documents(spark, sf):
    dirs = F.array(*map(F.lit, ("root", "root/src0", "root/src1/en", "root/src2/fr", "other")))
    projects = table(spark, sf, "region").select(F.get(dirs, F.col("r_regionkey")).alias("dir"), F.col("r_name").alias("project"))
    return declarations.owning_project(_paths(spark, sf).where("path is not null").select("path"), projects)


@query("""SELECT p_brand AS type_id, p_name AS name, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_type END AS summary, p_partkey AS ordinal FROM part WHERE p_size > 25 QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) <= 20""")
def get_external_type_info(spark, sf):
    p = table(spark, sf, "part")
    xml = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("<member><summary>\n "), "p_name", F.lit("</summary></member>"))).otherwise(F.col("p_type"))
    symbols = p.select(F.col("p_brand").alias("type_id"), F.col("p_name").alias("name"), F.lit("Public").alias("accessibility"), (F.col("p_size") <= 25).alias("in_source"), xml.alias("doc_xml"), F.col("p_partkey").alias("ordinal"))
    return declarations.external_members(symbols, limit=20).select("type_id", "name", "summary", "ordinal")


_AT = """n AS (SELECT l_orderkey AS doc_id, l_linenumber AS node_id, l_linenumber * 5 AS a, l_linenumber * 5 + 3 + l_suppkey % 7 AS b, l_partkey AS symbol_id, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey) AS rn FROM lineitem),
p AS (SELECT o_orderkey AS doc_id, o_orderkey % 40 AS pos FROM orders),
h AS (SELECT p.doc_id, pos, node_id, symbol_id FROM p LEFT JOIN n ON n.doc_id = p.doc_id AND a <= pos AND pos < b AND rn = 1 QUALIFY row_number() OVER (PARTITION BY p.doc_id, pos ORDER BY b - a, a, node_id) = 1)"""


def _symbols_at(spark, sf):
    x, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    start = F.col("l_linenumber") * 5
    nodes = x.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("node_id"), start.alias("span_start"), (start + 3 + F.col("l_suppkey") % 7).alias("span_end"), F.col("l_partkey").alias("symbol_id"), (F.col("l_returnflag") == "N").alias("declares"))
    nodes = search.first_per_key(nodes, ["doc_id", "node_id"], ["symbol_id"])
    own, refs = (nodes.where(w).select("doc_id", "node_id", "symbol_id") for w in ("declares", "not declares"))
    positions = o.select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % 40).alias("pos"))
    return lookup.symbol_at(positions, nodes.select("doc_id", "node_id", "span_start", "span_end"), refs, own)


@query(f"""WITH {_AT} SELECT doc_id, pos, node_id, symbol_id, p_name AS name FROM h LEFT JOIN part ON symbol_id = p_partkey""")
def get_symbol_info(spark, sf):
    return _symbols_at(spark, sf).join(star.symbols(spark, sf).select("symbol_id", "name"), "symbol_id", "left").select("doc_id", "pos", "node_id", "symbol_id", "name")


@query(f"""WITH {_AT} SELECT doc_id, pos, symbol_id, CASE WHEN p_size > 10 THEN p_size END AS def_start, CASE WHEN symbol_id IS NULL THEN 'no symbol' WHEN p_partkey IS NULL OR p_size <= 10 THEN 'not in source' END AS error FROM h LEFT JOIN part ON symbol_id = p_partkey""")
def go_to_definition(spark, sf):
    p = star.symbols(spark, sf)
    places = p.select("symbol_id", (F.col("size") > 10).alias("in_source"), F.col("symbol_id").alias("def_doc"), F.col("size").alias("def_start"), (F.col("size") + 1).alias("def_end"))
    return lookup.definitions(_symbols_at(spark, sf), places).select("doc_id", "pos", "symbol_id", "def_start", "error")


@query("""WITH r AS (SELECT l_partkey AS symbol_id, l_suppkey AS in_symbol_id, l_orderkey || ':' || l_linenumber AS place, l_orderkey AS d, l_linenumber AS l FROM lineitem),
f AS (SELECT *, row_number() OVER (PARTITION BY symbol_id, in_symbol_id ORDER BY d, l) AS rn FROM r),
p AS (SELECT symbol_id, in_symbol_id, count(*) AS n_locations, string_agg(place, ';' ORDER BY d, l) FILTER (WHERE rn <= 3) AS locations FROM f GROUP BY 1, 2)
SELECT symbol_id, in_symbol_id, n_locations, locations, count(*) OVER (PARTITION BY symbol_id) AS n_callers FROM p QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY in_symbol_id) <= 20""")
def analyze_method(spark, sf):
    return lookup.method_usage(star.refs(spark, sf)).select("symbol_id", "in_symbol_id", "n_locations", "locations", "n_callers")


def _solution(spark, sf):
    d = table(spark, sf, "documents").select(F.coalesce("source", F.lit("none")).alias("project"), "doc_id")
    return d.select("project").distinct().withColumn("ordinal", F.col("project")), d


@query(f"""WITH {_DIAG}, x AS (SELECT coalesce(source, 'none') AS project, doc_id FROM documents), h AS (SELECT DISTINCT project FROM x ORDER BY 1 LIMIT 5),
b AS (SELECT d.severity FROM d JOIN x USING (doc_id) WHERE project IN (SELECT project FROM h))
SELECT (SELECT count(DISTINCT project) FROM x) AS n_projects, (SELECT count(*) FROM x) AS n_documents, (SELECT count(*) FROM b WHERE severity = 'Error') AS n_errors, (SELECT count(*) FROM b WHERE severity = 'Warning') AS n_warnings, 'Ready' AS status""")
def health_check(spark, sf):
    projects, documents = _solution(spark, sf)
    return lookup.health(projects, documents, audits.diagnostics(star.diagnostics(spark, sf)).join(documents, "doc_id"))


@query("""SELECT coalesce(source, 'none') AS project, count(*) AS n_documents FROM documents GROUP BY 1""")
def load_solution(spark, sf):
    projects, documents = _solution(spark, sf)
    return projects.join(documents, "project").groupBy("project").agg(F.count(F.lit(1)).alias("n_documents"))


_USINGS = """u AS (SELECT n_regionkey, n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'System.' ELSE '' END || regexp_replace(n_name, '[^A-Za-z0-9]', '', 'g') AS ns FROM nation),
g AS (SELECT r_name AS name, string_agg('using ' || ns || ';', chr(10) ORDER BY n_nationkey) || chr(10) || 'class A {}' AS text, string_agg('using ' || ns || ';', chr(10) ORDER BY NOT starts_with(ns, 'System'), ns) || chr(10) || 'class A {}' AS organised FROM u JOIN region ON n_regionkey = r_regionkey GROUP BY 1)"""


def _files(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    name = F.concat(F.when(F.col("n_nationkey") % 3 == 0, "System.").otherwise(""), F.regexp_replace("n_name", "[^A-Za-z0-9]", ""))
    lines = F.sort_array(F.collect_list(F.struct("n_nationkey", F.concat(F.lit("using "), name, F.lit(";")).alias("line"))))
    text = F.concat(F.array_join(F.transform(lines, lambda x: x["line"]), "\n"), F.lit("\nclass A {}"))
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("name")).agg(text.alias("text"))


@query(f"""WITH {_USINGS} SELECT name, organised, organised <> text AS changed FROM g""")
def organize_usings(spark, sf):
    return lookup.organised(_files(spark, sf)).select("name", "organised", "changed")


@query(f"""WITH {_USINGS} SELECT name, organised FROM g WHERE regexp_matches(name, '^A.*$', 'i') AND organised <> text""")
def organize_usings_batch(spark, sf):
    return lookup.organised(_files(spark, sf), pattern="a*", changed_only=True).select("name", "organised")


@query("""WITH m AS (SELECT p_brand AS type_id, p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_type || ' M' || p_partkey || '(int size);' WHEN 1 THEN p_type || ' P' || p_partkey || CASE WHEN p_size > 25 THEN ' { get; set; }' ELSE ' { get; }' END WHEN 2 THEN 'event ' || p_type || ' E' || p_partkey || ';' END AS line FROM part WHERE p_size > 10)
SELECT type_id, 'namespace Shop' || chr(10) || '{' || chr(10) || '    public interface IPart' || chr(10) || '    {' || chr(10) || string_agg('        ' || line, chr(10) ORDER BY p_partkey) || chr(10) || '    }' || chr(10) || '}' || chr(10) AS text FROM m WHERE line IS NOT NULL GROUP BY 1""")
def extract_interface(spark, sf):
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    kind = F.get(F.array(*map(F.lit, ("Method", "Property", "Event", "Field"))), (k % 4).cast("int"))
    letter = F.get(F.array(*map(F.lit, "MPEF")), (k % 4).cast("int"))
    members = p.select(F.col("p_brand").alias("type_id"), F.lit("Shop").alias("namespace"), F.lit("IPart").alias("interface_name"), k.alias("ordinal"), F.concat(letter, k.cast("string")).alias("name"), kind.alias("kind"), F.col("p_type").alias("value_type"), F.lit("int size").alias("parameters"), F.lit(True).alias("has_getter"), (F.col("p_size") > 25).alias("has_setter"), F.when(F.col("p_size") > 10, "Public").otherwise("Internal").alias("accessibility"), F.lit(False).alias("is_static"))
    return lookup.interface_text(members).select("type_id", "text")


@query("""WITH e AS (SELECT DISTINCT l_partkey AS symbol_id, l_suppkey AS doc_id, l_orderkey * 10 + l_linenumber AS a FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 10),
f AS (SELECT *, row_number() OVER (PARTITION BY symbol_id, doc_id ORDER BY a) AS rn FROM e)
SELECT symbol_id, doc_id, count(*) AS n_changes, string_agg(a::VARCHAR, ',' ORDER BY a) FILTER (WHERE rn <= 20) AS starts, 'part' || symbol_id AS new_text FROM f GROUP BY 1, 2""")
def rename_symbol(spark, sf):
    p, x = table(spark, sf, "part"), table(spark, sf, "lineitem")
    renames = p.select(F.col("p_partkey").alias("symbol_id"), F.concat(F.when(F.col("p_size") > 10, "part").otherwise("1"), F.col("p_partkey").cast("string")).alias("new_name"))
    at = x.select(F.col("l_partkey").alias("symbol_id"), F.col("l_suppkey").alias("doc_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("span_start"), F.lit(4).alias("span_length")).distinct()
    return lookup.edit_summary(lookup.rename_edits(renames, at))
