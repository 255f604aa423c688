"""Trigram scores against their SQL."""

import duckdb

from factgraph.llm import backoff, registry


def test_trigrams_equal_sql(spark):
    folder = "/root/testdata/sf0.001"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = {r[0]: r for r in duckdb.sql(registry.oracle_sql()["op7_stupid_backoff"]).fetchall()}
    rows = registry.queries()["op7_stupid_backoff"](spark, folder).collect()
    assert len(rows) == len(want)
    for r in rows:
        w = want[r["doc_id"]]
        assert (r["n_words"], r["n_backoff"]) == w[1:3] and abs(r["logprob"] - w[3]) < 1e-4
    small = backoff.score(spark.createDataFrame([(1, "a b c d"), (2, "x a b c"), (3, "q b")], "doc_id long, text string"), order=3)
    # a: start; b after a: found; c after a b: found; d after b c: not.   q: start; b after q: not.
    assert {r["doc_id"]: r["n_backoff"] for r in small.collect()} == {1: 1, 2: 2, 3: 1}


def test_awkward_rows(spark):
    rows = [("a", None, 1), ("b", "", 2), ("c", "x y z", 3), ("c", "x y z", 3), (None, "x y z w", 4), ("d", " \n\t", 5), ("e", "x y z " * 3000, 6)]
    found = backoff.score(spark.createDataFrame(rows, "doc_id string, text string, n_words int"), block_bytes=1 << 12, part_bytes=1 << 13).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_backoff"]) for r in found) == [("None", 4, 1), ("a", 0, 0), ("b", 0, 0), ("c", 3, 0), ("c", 3, 0), ("d", 0, 0), ("e", 9000, 5998)]
    assert all((r["mean_logprob"] is None) == (r["n_words"] == 0) for r in found)


def test_rows_between_blocks_and_partitions_grow_with_the_corpus_only():
    small, large = backoff.layout(10**12, 8 << 20, 16 << 20), backoff.layout(10**14, 8 << 20, 16 << 20)
    assert 99 < large[0] * large[1] / (small[0] * small[1]) < 101 and backoff.layout(0, 8 << 20, 16 << 20) == (1, 1)
