"""Fixpoints run until nothing new is found, however long the path."""

from factgraph.operators import graph


def test_long_chains(spark):
    step = lambda n: spark.createDataFrame([(i, i + 1) for i in range(n)], "src long, dst long").coalesce(1)
    assert max(r["depth"] for r in graph.closure(step(35), "src", "dst").collect()) == 35
    roots = spark.createDataFrame([(0,)], "node long")
    assert {r["node"] for r in graph.reached(step(67), roots).collect()} == set(range(68))
