"""Declaration operators on small fact tables."""

from factgraph.operators import declarations as D


def rows(frame, *columns):
    return sorted(tuple(r[c] for c in columns) for r in frame.collect())


def test_attribute_usages_match_whole_names(spark):
    a = spark.createDataFrame([(1, "Test"), (2, "TestAttribute"), (3, "TestCase"), (4, None)], "owner int, attribute string")
    assert rows(D.attribute_usages(a, "test"), "owner") == [(1,), (2,)]
    # The full name does not find a class that is called by the short one.
    assert rows(D.attribute_usages(a, "TestAttribute"), "owner") == [(2,)]


def test_nearer_members_hide_inherited_ones(spark):
    own = spark.createDataFrame([("a", "m", "Method", 0), ("b", "m", "Method", 0), ("b", "n", "Method", 1)], "type_id string, name string, kind string, ordinal long")
    bases = spark.createDataFrame([("a", "b", 1)], "src string, dst string, depth int")
    assert rows(D.members(own, bases), "type_id", "name", "declared_in") == [("a", "m", "a"), ("a", "n", "b"), ("b", "m", "b"), ("b", "n", "b")]
    assert rows(D.members(own, bases, inherited=False, limit=1), "type_id", "name") == [("a", "m"), ("b", "m")]


def test_registrations(spark):
    calls = spark.createDataFrame([("AddScoped", "IServiceCollection", ["I", "C"]), ("TryAddSingleton", "ServiceCollectionX", ["S"]), ("AddHostedService", "IServiceCollection", ["H"]), ("AddScoped", "Router", ["I"]), ("Use", "IServiceCollection", [])], "method string, receiver string, type_args array<string>")
    assert rows(D.registrations(calls), "lifetime", "service", "implementation") == [("Scoped", "I", "C"), ("Singleton", "H", "H"), ("Singleton", "S", "S")]


def test_packages_keep_projects_without_any(spark):
    xml = '<Project>\n<PackageReference Include="A" Version="1"/><PackageReference Include="B"/><PackageReference Include="C">\n<Version>3</Version></PackageReference></Project>'
    p = spark.createDataFrame([("x", xml), ("y", "<Project/>"), ("z", None)], "project string, xml string")
    found = {(r["project"], r["package"], r["version"]) for r in D.packages(p).collect()}
    odd = spark.createDataFrame([("x", '<PackageReference Include="A & B"/><PackageReference Include="C" PrivateAssets="all"><Version>1</Version></PackageReference><PackageReference Include="D"><Version>1</PackageReference>')], "project string, xml string")
    assert rows(D.packages(odd), "package", "version", "private_assets") == [("C", "1", "all")]
    assert found == {("x", "A", "1"), ("x", "B", "unknown"), ("x", "C", "3"), ("y", None, None), ("z", None, None)}


def test_nearest_diagnostic_takes_the_first_of_the_best_tier(spark):
    d = spark.createDataFrame([(1, "CS0168", 0, 5, 0), (1, "CS0168", 60, 65, 1), (1, "CS0168", 98, 120, 2), (2, "X", 900, 901, 0)], "doc_id int, id string, span_start int, span_end int, ordinal int")
    p = spark.createDataFrame([(1, "CS0168", 100), (1, "CS0168", 80), (1, "CS0168", 500), (1, "CS0168", 120), (2, "X", 851), (2, "X", 850)], "doc_id int, id string, pos int")
    found = D.suggestions(D.nearest_diagnostic(p, d))
    assert rows(found, "pos", "tier", "ordinal") == [(80, 2, 1), (100, 1, 2), (120, 2, 2), (500, 3, 0), (850, 3, 0), (851, 2, 0)]
    texts = {r["id"]: r["suggestions"] for r in found.collect()}
    assert texts["CS0168"] == D.SUGGESTIONS["CS0168"] and texts["X"][1] == "Consult C# documentation for X"


def test_conversions(spark):
    pairs = spark.createDataFrame([("int", "long"), ("long", "int"), ("int", "int"), ("int", "object"), ("object", "int"), ("a", "b"), ("b", "a"), ("a", "c")], "source string, target string")
    bases = spark.createDataFrame([("a", "b", 1)], "src string, dst string, depth int")
    want = {("int", "long"): "ImplicitNumeric", ("long", "int"): "ExplicitNumeric", ("int", "int"): "Identity", ("int", "object"): "Boxing", ("object", "int"): "Unboxing", ("a", "b"): "ImplicitReference", ("b", "a"): "Explicit", ("a", "c"): "None"}
    assert {(r["source"], r["target"]): r["conversion"] for r in D.conversion(pairs, bases).collect()} == want


def test_sources_report_errors(spark):
    requests = spark.createDataFrame([(1, "t", "m", 0), (2, "t", "m", 1), (3, "t", "x", 0)], "request_id int, type_id string, name string, index int")
    declared = spark.createDataFrame([("t", "m", 0, 7, 2, 3)], "type_id string, name string, ordinal int, doc_id int, span_start int, span_length int")
    documents = spark.createDataFrame([(7, "abc\nefg")], "doc_id int, text string")
    found = {r["request_id"]: (r["source"], r["n_lines"], r["error"]) for r in D.sources(requests, declared, documents).collect()}
    assert found == {1: ("c\ne", 2, None), 2: (None, None, "index out of range"), 3: (None, None, "not found")}


def test_owning_project_is_the_longest_whole_directory(spark):
    paths = spark.createDataFrame([("/a/Foo/x",), ("/a/FooBar/x",), ("/a/Foo/b/c/x",), ("/q/x",)], "path string")
    projects = spark.createDataFrame([("/a", "root"), ("/a/Foo", "foo"), ("/a/Foo/b", "deep")], "dir string, project string")
    assert {(r["path"], r["project"]) for r in D.owning_project(paths, projects).collect()} == {("/a/Foo/x", "foo"), ("/a/FooBar/x", "root"), ("/a/Foo/b/c/x", "deep"), ("/q/x", None)}


def test_factories_and_external_members(spark):
    m = spark.createDataFrame([(i, "CreateX", "o", "v") for i in range(7)] + [(9, "CreateX", "v", "v"), (10, "GetX", "o", "v")], "method_id int, name string, owner_id string, value_type string")
    assert rows(D.factories(m), "method_id", "n_factories") == [(i, 7) for i in range(5)]
    s = spark.createDataFrame([("t", "a", "Public", False, "<m><summary>\n A </summary></m>", 0), ("t", "b", "Private", False, "x", 1), ("t", "c", "Protected", False, "raw", 2), ("t", "d", "Public", True, "x", 3)], "type_id string, name string, accessibility string, in_source boolean, doc_xml string, ordinal int")
    assert rows(D.external_members(s), "name", "summary") == [("a", "A"), ("c", "raw")]


def test_hierarchy_keeps_interfaces_apart_and_stops_before_the_root(spark):
    edges = spark.createDataFrame([("C", "B", "base"), ("B", "object", "base"), ("C", "I", "interface"), ("I", "J", "interface"), ("B", "K", "interface"), ("D", "B", "base")], "type_id string, base_id string, relation string")
    from factgraph.operators import graph

    types = spark.createDataFrame([("C",), ("B",), ("X",)], "type_id string")
    found = {r["type_id"]: (r["bases"], r["interfaces"], r["n_derived"], r["derived"]) for r in D.hierarchy(types, edges, graph.closure(edges, "type_id", "base_id"), max_derived=1).collect()}
    assert found == {"C": (["B"], ["I", "J", "K"], 0, []), "B": ([], ["K"], 2, ["C"]), "X": ([], [], 0, [])}


def test_batches_over_the_limit_are_errors(spark):
    requests = spark.createDataFrame([(1, 1, "t", "m", 0), (2, 2, "t", "m", 0), (2, 3, "t", "x", 0)], "batch_id int, request_id int, type_id string, name string, index int")
    declared = spark.createDataFrame([("t", "m", 0, 7, 2, 3)], "type_id string, name string, ordinal int, doc_id int, span_start int, span_length int")
    documents = spark.createDataFrame([(7, "abc\nefg")], "doc_id int, text string")
    found = {r["request_id"]: (r["source"], r["error"]) for r in D.sources_batch(requests, declared, documents, max_methods=1).collect()}
    assert found == {1: ("c\ne", None), 2: (None, "too many methods"), 3: (None, "too many methods")}
