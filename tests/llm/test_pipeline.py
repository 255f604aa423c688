"""run() against a plain-Python version of all five stages, on rows with planted cases."""

import random
import re

import corpus_pipeline

WS = re.compile(r"[^\x20\x09-\x0D]+")
SECRET = "token=abcdEFGH12345678"


def rejected(text):
    """The quality policy, from its definition."""
    text = text or ""
    words = WS.findall(text)
    joined, lines = "".join(words), [x for x in text.split("\n") if WS.search(x)]
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(8)}
    letters, upper = sum(c.isalpha() for c in joined), sum(c.isupper() for c in joined)
    return (
        len(words) < 20 or 100 * len(covered) > 30 * len(words) or 10 * len(re.findall(r"[#*$%&|<>]", text)) > 2 * len(words)
        or len(lines) >= 5 and 100 * (len(lines) - len(set(lines))) > 40 * len(lines) or not 2 * len(words) <= len(joined) <= 14 * len(words)
        or 100 * letters < 60 * len(joined) or 100 * upper > 40 * letters
    )


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def expected(rows, items):
    kept = [r for r in rows if not rejected(r[1])]
    sets = [shingles(r[1]) for r in kept]
    root = list(range(len(kept)))
    for _ in kept:
        for i in range(len(kept)):
            for j in range(i):
                if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j], key=lambda k: (kept[k][0] is None, kept[k][0] or 0, k))
    kept = [r for i, r in enumerate(kept) if root[i] == i]
    kept = [r for r in kept if not any(item in r[1] for item in items)]
    out = []
    for r in kept:
        text = r[1].replace(SECRET, "[secret]")
        out.append((r[0], text, r[2], r[3], len(text)))
    return sorted(out, key=str)


def test_run_equals_brute_force(spark, tmp_path):
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(1500)]
    words = lambda n: rng.choices(vocabulary, k=n)
    items = [" ".join(words(25)) for _ in range(6)]
    texts = [None, "", " \n", "too short", " ".join(["same", "words"] * 30), "# $ % " * 20 + " ".join(words(30)), "\n".join(["one line that repeats itself here"] * 12), " ".join(words(40)).upper(), "12 34 " * 40]
    for i in range(40):
        base = words(rng.randint(40, 160))
        texts.append(" ".join(base))
        if i % 4 == 0:
            texts += [" ".join(base), " ".join([*base[:20], "changed", *base[21:]])]
        if i % 4 == 1:
            at = rng.randrange(len(base))
            texts.append(" ".join(words(20) + base[:at] + items[i % 6].split() + base[at:]))
        if i % 4 == 2:
            texts.append(" ".join([*words(30), SECRET, *words(30)]))
    rng.shuffle(texts)
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    # Rows that share an id, and rows without one.
    rows += [(3, " ".join(words(60)), "en", "s1", 1), (None, " ".join(words(60)), "en", "s1", 1), (None, " ".join([*words(30), items[0], *words(30)]), "en", "s1", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "epoch", "slot", "position"]
    found = out.collect()
    first = sorted((tuple(r)[:5] for r in found if r["epoch"] == 0), key=str)
    want = expected(rows, items)
    assert first == want and 40 < len(want) < len(rows) - 20
    assert {tuple(r)[:5] for r in found} == set(want) and sorted(r["position"] for r in found) == list(range(len(found)))
