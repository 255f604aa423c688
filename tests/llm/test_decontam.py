"""Planted items against what was planted: verbatim, paraphrased, in surroundings that swamp them, and awkward rows."""

import random

import numpy as np
import pytest

from factgraph.llm import decontam

RNG = random.Random(5)
VOCABULARY = [f"w{i}" for i in range(2000)]
#: Like words of a language, some are far more common than others.
WEIGHTS = [1 / (i + 2) for i in range(2000)]


def words(n, rng=RNG):
    return rng.choices(VOCABULARY, WEIGHTS, k=n)


ITEMS = [words(RNG.randint(15, 60)) for _ in range(40)]


def table(spark):
    return spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(ITEMS)], "item_id long, text string")


def changed(item, share, rng):
    """The item with a share of its words replaced by words that occur nowhere else, its answer intact."""
    out = list(item)
    for j in rng.sample(range(len(out) - 6), min(len(out) - 6, round(share * len(out)))):
        out[j] = f"z{rng.randrange(10**9)}"
    return out


def swapped(item, share, rng):
    return item[len(item) // 2 :] + item[: len(item) // 2]


def repeated(item, share, rng):
    """The whole item between two runs of one word, and with another between its words."""
    word, other = rng.choice(VOCABULARY), rng.choice(VOCABULARY)
    inside = [x for j, w in enumerate(item) for x in ([w, other] if j % 4 == 0 else [w])]
    return [word] * 150 + inside + [word] * 150


KINDS = {"whole": (changed, 0.0), "fifth": (changed, 0.2), "third": (changed, 0.35), "half": (changed, 0.5), "halves": (swapped, 0), "repetitive": (repeated, 0)}


def test_recall_of_paraphrases(spark):
    rng, rows, want = random.Random(8), [], {}
    for kind, (change, share) in KINDS.items():
        for k, item in enumerate(ITEMS):
            around = words(rng.randint(60, 400), rng)
            at = rng.randrange(len(around))
            want[len(rows)] = (kind, k)
            rows.append((len(rows), " ".join(around[:at] + change(item, share, rng) + around[at:])))
    clean = [(len(rows) + i, " ".join(words(300, rng))) for i in range(200)]
    found = decontam.contaminated(spark.createDataFrame(rows + clean, "doc_id long, text string"), table(spark)).collect()
    pairs = {(r["doc_id"], r["item_id"]) for r in found}
    recall = {kind: sum((d, k) in pairs for d, (x, k) in want.items() if x == kind) / len(ITEMS) for kind in KINDS}
    assert min(recall.values()) >= 0.9, recall
    assert recall["whole"] == recall["repetitive"] == 1
    # Whatever else is found is no more than chance: these texts draw on one small vocabulary.
    assert all(d in want and want[d][1] == k for d, k in pairs)


def test_short_items_unspaced_scripts_and_rows_without_an_id(spark):
    items = spark.createDataFrame([(1, "deep blue sea"), (1, "deep blue sea"), (2, "no"), (3, None), (4, "東京は日本の首都です"), (5, "")], "item_id long, text string")
    rows = [(1, "the Deep, blue sea!"), (2, "deep sea blue"), (3, "私は東京は日本の首都ですと言った"), (None, "a deep blue sea"), (4, None), (5, ""), (6, "deep"), (6, "deep blue sea"), (7, "blue sea deep"), (7, "blue sea deep")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(((r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, items).collect()), key=str)
    assert found == [(1, 1), (3, 4), (6, 1), (None, 1)]
    kept = sorted(((r["doc_id"], r["text"]) for r in decontam.clean(docs, items).collect()), key=str)
    assert kept == sorted([r for r in rows if r not in (rows[0], rows[2], rows[3], rows[7])], key=str)


@pytest.mark.parametrize("max_items", [20_000, 16])
def test_leaked_rows_go_and_rows_that_share_their_id_stay(spark, max_items):
    leaked, clear = " ".join(words(30) + ITEMS[3] + words(30)), " ".join(words(80))
    docs = spark.createDataFrame([(5, leaked, 1), (5, clear, 1), (None, leaked, 1), (None, clear, 1)], "doc_id long, text string, row int")
    assert {(r["doc_id"], r["text"] == clear) for r in decontam.clean(docs, table(spark), max_items=max_items).collect()} == {(5, True), (None, True)}


def test_the_basis_is_that_of_the_passages_of_all_documents(spark):
    """The same subspace iteration over a dense matrix of every passage; rows without an id or with a shared one count too."""
    rng = random.Random(12)
    texts = [" ".join(rng.choices([f"v{i}" for i in range(60)], k=rng.randint(0, 60))) for _ in range(2600)]
    items = [(k, " ".join(rng.choices([f"v{i}" for i in range(50)], k=20))) for k in range(8)]
    docs = spark.createDataFrame([(i if i % 5 else None if i % 2 else 7, t) for i, t in enumerate(texts)], "doc_id long, text string")
    read = decontam.Items.read(spark.createDataFrame(items, "item_id long, text string"), "item_id", "text", 3, 40)
    codes = decontam.encoded(docs, read, id_col="doc_id", text_col="text")
    v, every = len(read.terms), []
    for text in texts:
        words = [read.terms.get(w.encode(), -1) for w in text.split()]
        every += [words[i : i + decontam.PASSAGE] for i in range(0, len(words), decontam.PASSAGE)]
    counts = np.array([[p.count(t) for t in range(v)] for p in every], float)
    idf = np.log((len(every) + len(items) + 1.0) / ((counts > 0).sum(axis=0) + 1.0))

    def matrix(counts):
        rows = np.sqrt(counts) * idf
        rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
        out = np.zeros((len(rows), 40))
        np.add.at(out.T, np.arange(v) % 40, rows.T)
        return out

    x, own = matrix(counts), matrix(np.array([np.bincount(c, minlength=v) for c in read.codes], float))
    for mass in (1000, 1 << 30):
        model = decontam.fit(codes, read, rank=6, power=1, mass=mass, item_weight=6.0, least_words=8, seed=0, cosine=0.6, verbatim=0.8, paraphrase=0.4, answer=6)
        basis = np.linalg.qr(np.random.default_rng(0).normal(size=(40, 6)))[0]
        for _ in range(2):
            basis = np.linalg.qr(min(1, mass / len(every)) * x.T @ (x @ basis) + 36 * own.T @ (own @ basis))[0]
        assert v > 40 and np.allclose(model.basis, basis[np.arange(v) % 40] * idf[:, None], atol=1e-4)
