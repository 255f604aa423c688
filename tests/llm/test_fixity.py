"""Replicas with awkward rows: empty, repeated, null, extra columns."""

from factgraph.llm import fixity

SCHEMA = "page_id long, url string, html string, node string, hash string, n int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)


def faults(one, two):
    return sorted(((r["id"], r["n_one"], r["n_two"], r["byte_offset"]) for r in fixity.audit(one, two).collect()), key=str)


def size(url, html):
    return len(f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: {url}\r\nContent-Length: {len(html)}\r\n\r\n{html}\r\n\r\n")


def test_counts_and_offsets(spark):
    rows = [(i, f"u{i}", "h" * i) for i in range(1, 60)]
    one = [*rows, rows[4], rows[4], (None, None, None), (None, None, None)]
    two = [*rows, rows[4], (None, None, None), (7, "u7", "other")]
    offset = lambda i: sum(size(u, h) * (3 if k == 5 else 1) for k, u, h in rows if k < i)
    found = faults(pages(spark, one), pages(spark, two))
    assert len(found) == 3 and (5, 3, 2, offset(5)) in found
    assert [f for f in found if f[0] is None] == [(None, 2, 1, offset(60))]
    seven = next(f for f in found if f[0] == 7)
    assert seven[1:3] == (0, 1) and seven[3] in (offset(7), offset(8))


def test_empty_and_equal_replicas(spark):
    one, none = pages(spark, [(1, "a", "b"), (2, None, "c")]), pages(spark, [])
    assert faults(none, none) == faults(one, one) == []
    assert [f[:3] for f in faults(one, none)] == [(1, 1, 0), (2, 1, 0)] and [f[:3] for f in faults(none, one)] == [(1, 0, 1), (2, 0, 1)]
