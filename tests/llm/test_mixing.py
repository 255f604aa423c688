"""Every source stays within one block of its exact weight over the whole schedule."""

from collections import defaultdict
from fractions import Fraction
from math import ceil, floor, fsum

import pytest

from factgraph.llm import mixing


@pytest.mark.parametrize("weights", [[0.5, 0.3, 0.1999, 0.0001], [1.0], [5, 3, 1, 0.5], [700.0, *[35 + i / 7 for i in range(20)]]])
def test_every_block_runs_in_its_window(spark, weights):
    share = list(mixing.exact({f"{i:03}": w for i, w in enumerate(weights)}).values())
    n_frames, total = 100, sum(map(Fraction, weights))
    rows = sorted((r["slot_"], r["number_"], r["turn_"]) for r in mixing.schedule(spark, share, n_frames).collect())
    assert [r[0] for r in rows] == list(range(n_frames * mixing.FRAME)) and sum(share) == mixing.RESOLUTION
    done, exact = [0] * len(weights), [Fraction(w) / total for w in weights]
    for slot, source, turn in rows:
        assert turn == done[source]
        whole = Fraction(share[source], mixing.RESOLUTION)
        assert floor(turn / whole) <= slot < ceil((turn + 1) / whole)
        done[source] += 1
        if slot % 37 == 0:
            assert all(abs(n - w * (slot + 1)) < 1 for n, w in zip(done, exact, strict=True))


def test_shares_are_whole_and_close():
    share = mixing.exact({"a": 10.0**9, "b": 1e-9, "c": 3.0})
    assert sum(share.values()) == mixing.RESOLUTION and share["b"] == 1 and mixing.exact({}) == {}
    with pytest.raises(ValueError):
        mixing.exact({"a": 0.0})


def test_awkward_rows(spark):
    rows = [(1, None, "x")] * 3 + [(None, "s", "y"), (None, "s", "z"), (2, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    found = mixing.mix(docs, keep=("doc_id", "source", "text"), block=1).collect()
    used = [(r["doc_id"], r["source"], r["text"]) for r in found if r["epoch"] == 0]
    assert sorted(used, key=str) == sorted(rows, key=str) and len({r["position"] for r in found}) == len(found)
    assert mixing.mix(docs.where("false")).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, {"s": 1.0})


def test_deviation_from_the_exact_weights(spark):
    sizes = {"hot": 700} | {f"s{i}": 35 for i in range(20)}
    docs = spark.createDataFrame([(1000 * k + i, s) for k, (s, n) in enumerate(sizes.items()) for i in range(n)], "doc_id long, source string")
    rows = mixing.mix(docs, block=1).collect()
    n_slots = len(rows)
    assert n_slots > 1200 and {r["slot"] for r in rows} == set(range(n_slots)) and all(r["position"] == r["slot"] for r in rows)
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.collect()}
    whole, slots = fsum(n**0.7 for n in sizes.values()), defaultdict(set)
    for r in rows:
        slots[r["source"]].add(r["slot"])
    for s, n in sizes.items():
        count, w = 0, n**0.7 / whole
        for t in range(n_slots):
            count += t in slots[s]
            assert abs(count - w * (t + 1)) < 1
        # Epochs: each document once before any is used again.
        used = sorted((r["slot"], r["epoch"]) for r in rows if r["source"] == s)
        assert [e for _, e in used] == [i // n for i in range(len(used))]


def test_blocks_are_whole(spark):
    docs = spark.createDataFrame([(i, f"s{i % 7}" if i % 3 else "hot") for i in range(900)], "doc_id long, source string")
    rows = mixing.mix(docs, block=4, bucket_rows=20).collect()
    filled = defaultdict(list)
    for r in rows:
        filled[r["slot"]].append(r)
    assert set(filled) == set(range(len(filled)))
    for slot, rs in filled.items():
        assert len({r["source"] for r in rs}) == 1 and sorted(r["position"] for r in rs) == list(range(4 * slot, 4 * slot + 4))
