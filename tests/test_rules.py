"""Rules, metrics, graphs, flow and generated code on small fact tables, with values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from factgraph.operators import complexity, flow, graph, lookup, references, rewrite, rules


def rows(frame, *columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=str)


def test_reference_kinds(spark):
    # x = 1; Run(x); Run() as callee; nameof(x) inside an attribute; [X]; typeof(X); (X)y; (y)x; x
    facts = [
        (1, True, "invocation", "argument", "Run", "write"), (2, False, "invocation", "argument", "Run", "read"), (3, False, "invocation", "callee", "Run", "invocation"), (4, False, "invocation", "argument", "nameof", "nameof"),
        (5, False, "attribute", None, None, "attribute"), (6, False, "typeof", None, None, "typeof"), (7, False, "cast", "type", None, "cast"), (8, False, "cast", "operand", None, "read"), (9, False, None, None, None, "read"),
    ]
    frame = spark.createDataFrame(facts, "ref_id int, is_write boolean, nearest string, side string, callee string, want string")
    assert all(r["kind"] == r["want"] for r in frame.withColumn("kind", rules.reference_kind()).collect())
    found = rules.reference_locations(frame.select(F.lit(1).alias("symbol_id"), F.lit(1).alias("doc_id"), F.col("ref_id").alias("line"), F.lit(0).alias("col"), "is_write", "nearest", "side", "callee"), kind="READ", limit=2)
    assert rows(found, "line", "n_all", "n_found") == [(2, 9, 3), (8, 9, 3)]


def test_unused_rules(spark):
    types = [(1, "Public", True, False, False, ["System.IDisposable"], []), (2, "Public", True, False, False, ["My.Base"], []), (3, "Internal", True, False, False, [], []), (4, "Public", True, False, False, [], ["MyRouteAttribute"]), (5, "Public", True, False, False, [], []), (6, "Public", False, False, False, [], []), (7, "Public", True, False, False, ["x.mediatr.irequesthandler<A>"], [])]
    types = spark.createDataFrame(types, "symbol_id long, accessibility string, in_source boolean, is_implicit boolean, is_extern boolean, base_names array<string>, attributes array<string>")
    member = "symbol_id long, owner_id long, member_kind string, method_kind string, accessibility string, is_override boolean, is_virtual boolean, is_implicit boolean, is_extern boolean, in_source boolean"
    members = [(50, 5, "Method", "Ordinary", "Public", False, False, False, False, True), (20, 2, "Method", "Constructor", "Public", False, False, False, False, True), (21, 2, "Property", None, "Private", False, False, False, False, True), (22, 2, "Method", "Ordinary", "Public", True, False, False, False, True), (23, 2, "Event", None, "Public", False, False, False, False, True)]
    members = spark.createDataFrame(members, member)
    refs = spark.createDataFrame([(50,), (50,), (20,), (20,), (2,)], "symbol_id long")
    assert rows(rules.unused_types(types, members, refs), "symbol_id", "n_refs") == [(2, 1)]
    assert rows(rules.unused_types(types, members, refs, include_internal=True), "symbol_id") == [(2,), (3,)]
    assert rows(rules.unused_members(members, refs), "symbol_id") == [(21,)]
    assert rows(rules.unused_members(members, refs, include_private=False), "symbol_id") == []


def test_reflection(spark):
    calls = [("System", "Activator", "CreateInstance", True), ("System", "Activator", "Whatever", True), ("System.Reflection", "MethodInfo", "ToString", True), ("System", "Type", "GetMethod", True), ("System", "Type", "ToString", False), ("System", "Delegate", "DynamicInvoke", True), ("System", "Delegate", "Invoke", False), ("My", "Activator", "CreateInstance", False), (None, "Type", "GetMethod", False)]
    frame = spark.createDataFrame([(i, *c) for i, c in enumerate(calls)], "i int, namespace string, type_name string, method string, want boolean")
    assert {r["i"] for r in rules.reflection_usage(frame.withColumn("context", F.repeat(F.lit("x"), 300))).collect()} == {i for i, c in enumerate(calls) if c[3]}


def test_missing_members(spark):
    interfaces = spark.createDataFrame([("C", "I"), ("C", "J")], "type_id string, base_id string")
    bases = spark.createDataFrame([("C", "B")], "type_id string, base_id string")
    schema = "member_id long, owner_id string, name string, is_static boolean, is_abstract boolean, is_override boolean, accessibility string"
    members = spark.createDataFrame([(1, "I", "M", False, True, False, "Public"), (2, "I", "N", False, True, False, "Public"), (3, "I", "S", True, False, False, "Public"), (4, "J", "P", False, False, False, "Private"), (5, "B", "A", False, True, False, "Public"), (6, "B", "A", False, True, False, "Public"), (7, "B", "Z", False, True, False, "Public"), (8, "B", "V", False, False, False, "Public"), (9, "C", "A", False, False, True, "Public")], schema)
    done = spark.createDataFrame([("C", 1)], "type_id string, member_id long")
    assert rows(rules.missing_members(interfaces, bases, members, done), "declared_in", "name", "source") == [("B", "Z", "abstract"), ("I", "N", "interface")]


def test_complexity_of_a_tree(spark):
    # if (a && b) { for (...) { if (c) { } else if (d) { } } } x ? y : z
    nodes = [(1, None, "if"), (2, 1, "and"), (3, 1, "for"), (4, 3, "if"), (5, 4, "else"), (6, 5, "if"), (7, None, "conditional"), (8, 99, "if")]
    found = complexity.ancestors(spark.createDataFrame([(0, *n) for n in nodes], "doc_id int, node_id int, parent_id int, kind string"))
    r = complexity.method_metrics(found, ["doc_id"]).first()
    # Cognitive: 1 + 1 + 2 + 3 + 1 + 4 + 1.
    assert (r["cyclomatic"], r["estimate"], r["nesting"], r["cognitive"], r["hint"]) == (7, 6, 4, 13, "")
    methods = spark.createDataFrame([("f", 2, 1, 10), ("f", 3, 5, 20), ("f", 3, 0, 5)], "file string, cyclomatic int, nesting int, loc int")
    assert rows(complexity.file_totals(methods, ["file"]), "avg_cyclomatic", "max_cyclomatic", "max_nesting", "total_loc") == [(2.67, 3, 5, 35)]


def test_call_graph_flags_and_cycles(spark):
    calls = spark.createDataFrame([("A", "B"), ("A", "C"), ("B", "D"), ("C", "D"), ("D", "B"), ("E", "E"), ("Z", "A")], "src string, dst string")
    nodes, edges = graph.call_graph(calls, "A", max_depth=3)
    assert rows(nodes, "node", "depth", "ordinal") == [("A", 0, 0), ("B", 1, 1), ("C", 1, 2), ("D", 2, 3)] and not nodes.first()["truncated_by_depth"]
    # A diamond's second arm is no cycle.
    assert rows(edges.where("is_cycle"), "src", "dst") == [("B", "D"), ("D", "B")]
    nodes, edges = graph.call_graph(calls, "A", max_depth=1, max_nodes=2)
    assert rows(nodes, "node") == [("A",), ("B",)] and nodes.first()["truncated_by_nodes"] and nodes.first()["truncated_by_depth"]
    assert rows(graph.call_graph(calls, "A", direction="callers", max_depth=2)[1], "src", "dst", "is_cycle") == [("Z", "A", False)]
    assert rows(graph.call_graph(calls, "E", max_depth=2)[1], "src", "dst", "is_cycle") == [("E", "E", True)]
    for bad in ({"max_depth": 11}, {"direction": "up"}, {"max_nodes": 0}):
        with pytest.raises(ValueError):
            graph.call_graph(calls, "A", **bad)


def test_strong_components(spark):
    ring = [(i, (i + 1) % 8) for i in range(8)]
    edges = [*ring, (3, 100), (100, 101), (101, 100), (101, 200), (300, 300), (0, 0), (7, 7), (400, 0)]
    found = {r["node"]: (r["component"], r["size"]) for r in graph.components_of(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert found == {**dict.fromkeys(range(8), (0, 8)), 100: (100, 2), 101: (100, 2), 300: (300, 1)}
    cut = graph.cycle_edges(spark.createDataFrame(edges, "src long, dst long"))
    assert (3, 100) not in rows(cut, "src", "dst") and cut.count() == 8 + 2 + 3
    assert graph.components_of(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_mermaid(spark):
    edges = spark.createDataFrame([("My.App", "Core-Lib")], "src string, dst string")
    nodes = spark.createDataFrame([("My.App",), ("Core-Lib",), ("Lone One",)], "node string")
    assert rows(graph.mermaid(edges, nodes), "part", "line") == [(0, "graph TD"), (1, '  Core_Lib["Core-Lib"]'), (1, '  Lone_One["Lone One"]'), (1, '  My_App["My.App"] --> Core_Lib["Core-Lib"]')]


def test_data_flow(spark):
    regions = spark.createDataFrame([(1, 1, 10, 20), (2, 2, 0, 5)], "region_id int, doc_id int, region_start int, region_end int")
    at = [("a", 1, "declare"), ("a", 12, "read"), ("b", 2, "declare"), ("b", 13, "write"), ("b", 25, "read"), ("c", 11, "declare"), ("c", 12, "write"), ("d", 3, "declare"), ("d", 14, "write"), ("d", 15, "read")]
    accesses = spark.createDataFrame([(1, v, p, a, v == "b", v == "a") for v, p, a in at], "doc_id int, variable string, pos int, action string, conditional boolean, captured boolean")
    found = {r["region_id"]: r for r in flow.data_flow(regions, accesses).collect()}
    one = found[1]
    assert one["flows_in"] == ["a", "b"] and one["flows_out"] == ["b"] and one["declared"] == ["c"] and one["always_assigned"] == ["c", "d"] and one["captured_inside"] == ["a"]
    assert found[2]["flows_in"] == [] and one["read_outside"] == ["b"]


def test_change_signature(spark):
    schema = "method_id int, name string, return_type string, params array<struct<name:string,type:string,default:string>>, removed array<string>, renamed map<string,string>, order array<string>, added array<struct<name:string,type:string,default:string,position:int>>"
    params = [("a", "int", None), ("b", "string", "null"), ("c", "bool", None)]
    methods = [(1, "M", "void", params, ["c"], {"a": "x"}, None, [("n", "long", None, 0)]), (2, "M", "void", params, [], {}, ["c", "a"], [("d", "int", "7", -1), ("e", "int", "", 99)])]
    done = rewrite.change_signature(spark.createDataFrame(methods, schema))
    assert rows(done, "method_id", "new_signature") == [(1, 'void M(long n, int x, string b = null)'), (2, "void M(bool c, int a, int d = 7, int e = )")]
    calls = spark.createDataFrame([(1, 1, [(None, "1"), (None, '"s"'), (None, "true")]), (1, 2, [("a", "5"), ("c", "true")]), (2, 1, [(None, "1"), ("c", "true")]), (2, 2, [])], "method_id int, call_id int, args array<struct<name:string,text:string>>")
    want = [(1, 1, '(default, 1, "s")'), (1, 2, "(default, x: 5)"), (2, 1, "(c: true, 1, 7, default)"), (2, 2, "(default, default, 7, default)")]
    assert rows(rewrite.changed_calls(done, calls), "method_id", "call_id", "new_args") == want


def test_generated_members(spark):
    schema = "type_id int, type_name string, is_public boolean, ordinal int, name string, kind string, value_type string, is_static boolean, is_const boolean, is_nullable boolean, can_set boolean"
    members = spark.createDataFrame([(1, "Foo", True, 0, "_id", "Field", "int", False, False, False, None), (1, "Foo", True, 1, "K", "Field", "int", False, True, False, None), (1, "Foo", True, 2, "Name", "Property", "string?", False, False, True, True), (1, "Foo", True, 3, "Read", "Property", "int", False, False, False, False), (2, "Bar", False, 0, "S", "Field", "int", True, False, False, None)], schema)
    assert rows(rewrite.constructors(members), "code") == [("public Foo(int id)\n{\n    _id = id;\n}",)]
    assert rows(rewrite.constructors(members, include_properties=True, to_default=True), "code") == [("public Foo(int id, string? name)\n{\n    _id = id;\n    Name = name ?? default;\n}",)]
    code = rewrite.equality_members(members.withColumn("has_getter", F.lit(True))).where("type_id = 1").first()["code"]
    assert "return _id == other._id && Name == other.Name && Read == other.Read;" in code and "HashCode.Combine(_id, Name, Read)" in code and "operator !=(Foo? left, Foo? right)" in code
    methods = spark.createDataFrame([(1, 1, 10), (2, 1, None), (3, 1, 5)], "method_id int, doc_id int, body_start int")
    parameters = spark.createDataFrame([(1, 0, "s", True, False), (1, 1, "n", False, False), (1, 2, "q", False, True), (2, 0, "s", True, False), (3, 0, "n", False, False)], "method_id int, ordinal int, name string, is_reference boolean, is_nullable_value boolean")
    checks = {r["method_id"]: (r["new_text"], r["error"]) for r in rewrite.null_checks(methods, parameters).collect()}
    assert checks == {1: ("\n        ArgumentNullException.ThrowIfNull(s);\n        ArgumentNullException.ThrowIfNull(q);\n", None), 2: (None, "method has no body"), 3: (None, "no nullable parameters")}


def test_extracted_method(spark):
    documents = spark.createDataFrame([(1, "AAA x=y+1; BBB }")], "doc_id int, text string")
    requests = spark.createDataFrame([(1, 1, 4, 10, 16, "Next")], "region_id int, doc_id int, region_start int, region_end int, insert_at int, name string")
    found = spark.createDataFrame([(1, ["y"], ["x"], ["x"])], "region_id int, flows_in array<string>, flows_out array<string>, declared array<string>")
    types = spark.createDataFrame([(1, "y", "int"), (1, "x", "long")], "region_id int, variable string, value_type string")
    edits = rewrite.extract_methods(requests, found, types, documents)
    assert lookup.apply_edits(documents, edits.select("doc_id", "span_start", "span_length", "new_text")).first()["text"] == "AAA var x = Next(y); BBB }\nprivate long Next(int y)\n{\nx=y+1;\nreturn x;\n}\n"


def test_change_impact_keeps_symbols_without_references(spark):
    symbols = spark.createDataFrame([(1, "Public"), (2, "Private")], "symbol_id int, accessibility string")
    refs = spark.createDataFrame([(1, 5)], "symbol_id int, doc_id int")
    assert rows(references.change_impact(symbols, refs, "delete"), "symbol_id", "n_refs", "severity", "safe") == [(1, 1, "error", False), (2, 0, "error", True)]
    assert rows(references.change_impact(symbols, refs, "change_accessibility"), "severity") == [("error",), ("warning",)]
