"""Positions, usage, health and edits on small fact tables."""

from factgraph.operators import lookup as L


def rows(frame, *columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=str)


def test_symbol_and_definition_at_a_position(spark):
    positions = spark.createDataFrame([(1, 5), (1, 12), (1, 99), (1, 5)], "doc_id int, pos int")
    nodes = spark.createDataFrame([(1, 1, 0, 50), (1, 2, 4, 8), (1, 3, 10, 14)], "doc_id int, node_id int, span_start int, span_end int")
    refs = spark.createDataFrame([(1, 2, 20)], "doc_id int, node_id int, symbol_id int")
    declared = spark.createDataFrame([(1, 2, 10), (1, 3, 30)], "doc_id int, node_id int, symbol_id int")
    found = L.symbol_at(positions, nodes, refs, declared)
    assert rows(found, "pos", "node_id", "symbol_id") == [(12, 3, 30), (5, 2, 20), (99, None, None)]
    places = spark.createDataFrame([(20, True, 7, 3, 9), (20, True, 6, 1, 2), (30, False, 8, 0, 1)], "symbol_id int, in_source boolean, def_doc int, def_start int, def_end int")
    assert rows(L.definitions(found, places), "pos", "def_doc", "error") == [(12, None, "not in source"), (5, 6, None), (99, None, "no symbol")]


def test_usage_counts_all_callers_and_shows_the_first(spark):
    refs = spark.createDataFrame([(1, c, d, 0) for c in range(4) for d in range(c + 1)], "symbol_id int, in_symbol_id int, doc_id int, line int")
    found = L.method_usage(refs, max_callers=3, max_locations=2)
    assert rows(found, "in_symbol_id", "n_locations", "locations", "n_callers") == [(0, 1, "0:0", 4), (1, 2, "0:0;1:0", 4), (2, 3, "0:0;1:0", 4)]


def test_health_samples_the_first_projects(spark):
    projects = spark.createDataFrame([("a", 0), ("b", 1)], "project string, ordinal int")
    documents = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "project string, doc_id int")
    diagnostics = spark.createDataFrame([("a", "Error"), ("a", "Info"), ("b", "Warning")], "project string, severity string")
    assert rows(L.health(projects, documents, diagnostics, sample=1), "status", "n_projects", "n_documents", "n_errors", "n_warnings") == [("Ready", 2, 3, 1, 0)]
    assert rows(L.health(projects.limit(0), documents.limit(0), diagnostics), "status", "n_errors") == [("Not Ready", 0)]


def test_organised_usings(spark):
    d = spark.createDataFrame([("A.cs", "using Zed;\nusing System.IO;\nclass A {}"), ("B.cs", "using A;"), ("C.txt", "using B;\nusing A;"), ("D.cs", None)], "name string, text string")
    assert rows(L.organised(d, pattern="*.cs", changed_only=True), "name", "organised") == [("A.cs", "using System.IO;\nusing Zed;\nclass A {}")]


def test_interface_text(spark):
    schema = "type_id int, namespace string, interface_name string, ordinal int, name string, kind string, value_type string, parameters string, has_getter boolean, has_setter boolean, accessibility string, is_static boolean"
    members = [(1, "N", "IA", 1, "P", "Property", "int", None, True, False, "Public", False), (1, "N", "IA", 0, "M", "Method", "void", "int x", None, None, "Public", False), (1, "N", "IA", 2, "S", "Method", "void", "", None, None, "Public", True), (1, "N", "IA", 3, "F", "Field", "int", None, None, None, "Public", False), (2, None, "IB", 0, "E", "Event", "Handler", None, None, None, "Public", False)]
    found = {r["type_id"]: r["text"] for r in L.interface_text(spark.createDataFrame(members, schema)).collect()}
    assert found[1] == "namespace N\n{\n    public interface IA\n    {\n        void M(int x);\n        int P { get; }\n    }\n}\n"
    assert found[2] == "public interface IB\n{\n    event Handler E;\n}\n"


def test_rename_splices_every_occurrence(spark):
    renames = spark.createDataFrame([(1, "longer"), (2, "1bad")], "symbol_id int, new_name string")
    at = spark.createDataFrame([(1, 1, 0, 1), (1, 1, 4, 1), (1, 1, 4, 1), (2, 1, 2, 1)], "symbol_id int, doc_id int, span_start int, span_length int")
    documents = spark.createDataFrame([(1, "a b a"), (2, "a"), (3, None)], "doc_id int, text string")
    edits = L.rename_edits(renames, at.distinct())
    assert rows(L.edit_summary(edits, max_changes=1), "doc_id", "n_changes", "starts", "new_text") == [(1, 2, "0", "longer")]
    assert rows(L.apply_edits(documents, L.rename_edits(renames, at)), "doc_id", "text") == [(1, "longer b longer"), (2, "a"), (3, None)]
