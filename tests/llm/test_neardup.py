"""The pipeline stage for near copies, against brute force."""

import random

import numpy as np

import corpus_pipeline
from factgraph.llm import neardup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingle_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near(a, b):
    return a == b or bool(a | b) and 5 * len(a & b) >= 4 * len(a | b)


def near_copies():
    rng = random.Random(11)
    out = [None, "", " \n", "one two", "One  two", "one three"]
    for _ in range(25):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randint(30, 200))]
        out.append(" ".join(base))
        for _ in range(5):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 30))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(500)}"
            out.append(" ".join(copy))
    return out


def test_stage_removes_near_copies_of_similarity_08(spark):
    known = near_copies()
    sets = [shingle_set(t) for t in known]
    root = list(range(len(known)))
    for _ in known:
        for i in range(len(known)):
            for j in range(i):
                if near(sets[i], sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(known)], SCHEMA)
    assert len(set(root)) < len(known) - 40
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == set(root)
    assert {r["doc_id"]: r["component_id"] for r in neardup.groups(docs).collect()} == dict(enumerate(root))
    assert neardup.groups(docs.where("false")).count() == 0


def test_fingerprint_is_the_majority_of_its_shingles():
    rng = np.random.default_rng(3)
    for n in (1, 7, 255, 256, 601):
        found = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        words = [[int(w) for w in row] for row in neardup._words(found)]
        for j, word in enumerate(neardup.fingerprint(found).tolist()):
            tie = min(words, key=lambda row: row[j - 1])[j]
            ones = [sum(row[j] >> bit & 1 for row in words) for bit in range(64)]
            assert word == sum((2 * k > n or 2 * k == n and tie >> bit & 1) << bit for bit, k in enumerate(ones))
    assert not neardup.fingerprint(np.zeros(0, np.uint64)).any()


def test_simhash_segments_link_every_pair_of_similarity_08(spark):
    """Pairs of sets at 0.8 exactly, of few and of many shingles, and runs on both sides of LARGE_RUN."""
    rng = np.random.default_rng(4)
    sets = []
    for shared, left, right in [(12, 1, 2), (20, 2, 3), (40, 5, 5), (160, 0, 40)] * 100:
        draw = rng.integers(0, 1 << 63, shared + left + right).astype(np.uint64)
        sets += [draw[: shared + left], np.concatenate((draw[:shared], draw[shared + left :]))]
    prints = np.array([neardup.fingerprint(np.sort(s)) for s in sets])
    nodes = neardup._node(prints[:, : neardup.CHECKED].T).tolist()
    rows = spark.createDataFrame([(n, p.tobytes()) for n, p in zip(nodes, prints, strict=True)], "node long, print binary")
    keyed = rows.mapInArrow(neardup._segments, "key int, w0 long, w1 long, w2 long").repartition("key").sortWithinPartitions("key")
    found = {(r["u"], r["v"]) for r in keyed.mapInArrow(neardup._links, "u long, v long").collect()}
    assert found == {tuple(sorted(nodes[i : i + 2])) for i in range(0, len(nodes), 2)}


def test_links_of_a_run_connect_what_all_pairs_connect(monkeypatch):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, (3, 40)).astype(np.uint64)
    words = np.repeat(base, 5, axis=1) ^ np.uint64(1) << rng.integers(0, 64, (3, 200)).astype(np.uint64)
    order = rng.permutation(200)
    keys, words = np.sort(rng.integers(0, 3, 200)).astype(np.int32), words[:, order]
    near = lambda i, j: keys[i] == keys[j] and np.bitwise_count(words[:, i] ^ words[:, j]).sum() <= neardup.DISTANCE

    def parts(pairs):
        root = list(range(200))
        for i, j in pairs:
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
        return root

    want = parts([(i, j) for i in range(200) for j in range(i) if near(i, j)])
    assert len(set(want)) < 150
    for large in (neardup.LARGE_RUN, 10):
        monkeypatch.setattr(neardup, "LARGE_RUN", large)
        found = neardup.linked(keys, words).tolist()
        assert parts(found) == want and len(found) == 200 - len(set(want))


def test_a_large_group_has_few_links(spark, monkeypatch):
    """Near copies of one text: the segments do not each send a tree of the same group, and no text is lost."""
    rng, edges, whole = random.Random(8), [], neardup.components
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    texts = [" ".join([*base[:at], f"x{i}", *base[at + 1 :]]) for i, at in enumerate(rng.choices(range(120), k=400))]
    monkeypatch.setattr(neardup, "components", lambda links: edges.append(links.distinct().count()) or whole(links))
    found = neardup.groups(spark.createDataFrame([*enumerate([*texts, "another text of six short words"])], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == dict.fromkeys(range(400), 0) | {400: 400}
    assert sum(edges) < 15 * 400


def test_stars_are_the_components():
    rng = np.random.default_rng(9)
    assert not len(neardup.stars(np.zeros(0, np.int64), np.zeros(0, np.int64))[0])
    for _ in range(50):
        n = int(rng.integers(2, 300))
        names = rng.permutation(np.arange(-n, n, 2))
        u, v = names[rng.integers(0, n, (2, int(rng.integers(1, n))))]
        root = {int(x): int(x) for x in (*u, *v)}
        for a, b in zip(u.tolist(), v.tolist(), strict=True):
            one, other = root[a], root[b]
            root = {k: min(one, other) if r in (one, other) else r for k, r in root.items()}
        low, others = neardup.stars(u, v)
        assert dict(zip(others.tolist(), low.tolist(), strict=True)) == {k: r for k, r in root.items() if k != r}
    path = rng.permutation(100_000)
    low, others = neardup.stars(path[:-1], path[1:])
    assert not low.any() and len(others) == 99_999
