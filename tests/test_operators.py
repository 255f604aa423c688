"""Operators on small fact tables, with the expectations of the survey."""

import pytest
from pyspark.sql import functions as F

from factgraph.functions import metrics, predicates
from factgraph.operators import audits, graph, references, search

CALLS = [("A", "B"), ("B", "C"), ("D", "E"), ("E", "D"), *[("Hub", f"L{i}") for i in range(1, 5)]]


@pytest.fixture(scope="module")
def calls(spark):
    return spark.createDataFrame(CALLS, "src string, dst string")


def nodes(frame):
    return {r["node"] for r in frame.collect()}


@pytest.mark.parametrize(("root", "direction", "depth", "want"), [("A", "callees", 1, {"A", "B"}), ("C", "callers", 3, {"A", "B", "C"}), ("B", "both", 1, {"A", "B", "C"}), ("D", "callees", 9, {"D", "E"})])
def test_bounded_search(calls, root, direction, depth, want):
    assert nodes(graph.bounded_search(calls, root, direction=direction, max_depth=depth)) == want


@pytest.mark.parametrize("bad", [{"max_depth": 0}, {"max_depth": 100}, {"direction": "sideways"}])
def test_bounded_search_rejects(calls, bad):
    with pytest.raises(ValueError):
        graph.bounded_search(calls, "A", **bad)


def test_cycles(calls):
    assert {(r["node"], r["component"]) for r in graph.on_cycles(calls).collect()} == {("D", "D"), ("E", "D")}


@pytest.mark.parametrize(("text", "pattern", "want"), [("FooBar", "Foo*", True), ("FooBar", "foo?ar", True), ("FooBar", "Bar", False), ("a.b", "a.b", True), ("axb", "a.b", False), ("a+b", "a+*", True), ("x", "", True)])
def test_glob(spark, text, pattern, want):
    assert spark.range(1).select(predicates.glob(F.lit(text), pattern)).first()[0] is want


def test_complexity(spark):
    codes = ["return 1;", "if (a) { } for (;;) { } while (b) { }", "if (a && b) { } foreach (x in y) { } catch { } case 1: case 2: x ?? y;"]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in codes], "c string").select(metrics.cyclomatic(F.col("c"), False)).collect()]
    assert got[:2] == [1, 4]
    loc = spark.range(1).select(metrics.code_lines(F.lit("a\n\n // b\n/* c\n* d\n e"))).first()[0]
    assert loc == 2


def test_usings(spark):
    text = "using Zed;\nusing System.Linq;\nusing Alpha;\nusing System;\nclass C {}"
    got = spark.range(1).select(metrics.sort_usings(F.lit(text))).first()[0]
    assert got.split("\n") == ["using System;", "using System.Linq;", "using Alpha;", "using Zed;", "class C {}"]
    # Aliases and static directives are sorted too, by the name they stand for; an inner scope keeps its own.
    text = "using static Zed.Z;\nusing b = Beta.B;\nusing alpha;\nusing Gamma;\nnamespace N {\nusing Zed;\nusing Alpha;\n}"
    got = spark.range(1).select(metrics.sort_usings(F.lit(text))).first()[0]
    assert got.split("\n") == ["using alpha;", "using b = Beta.B;", "using Gamma;", "using static Zed.Z;", "namespace N {", "using Zed;", "using Alpha;", "}"]


def test_coupling(spark):
    uses = spark.createDataFrame([(1, i) for i in range(100, 125)] + [(2, 100)], "owner_id long, used_id long")
    members = spark.createDataFrame([(1,)] * 25 + [(2,)] * 3, "owner_id long")
    assert [(r["id"], r["efferent"], r["score"]) for r in audits.coupling(uses, members).collect()] == [(1, 25, 20.0)]


def test_unused_and_overload(spark):
    symbols = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "symbol_id long, name string")
    refs = spark.createDataFrame([(1, 9), (1, 8), (2, 9)], "symbol_id long, doc_id long")
    assert {r["symbol_id"] for r in references.unused(symbols, refs).collect()} == {2, 3}
    rows = spark.createDataFrame([("m", 1), ("m", 2), ("n", 5)], "k string, o int")
    assert {(r["k"], r["o"]) for r in search.overload(rows, ["k"], ["o"], 1).collect()} == {("m", 2), ("n", 5)}


def test_queries_have_sql():
    from factgraph import catalog

    assert set(catalog.oracle_sql()) == set(catalog.queries())
