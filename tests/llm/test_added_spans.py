"""What the methods of op9 and op10 add to the base spans, on planted rows; and the battery itself."""

import base64
import math
import random

import pytest
from pyspark.sql import functions as F

from factgraph.llm import pii, secrets

RNG = random.Random(12)
VOCABULARY = ["".join(RNG.choice("bdfgklmnprst") + RNG.choice("aeiou") for _ in range(RNG.randint(1, 4))) for _ in range(500)]


def prose(rng, n=60):
    return " ".join(rng.choices(VOCABULARY, k=n))


def long_words(rng):
    """Long tokens that are no secrets: paths, names of several words, runs of one letter, sequences."""
    return rng.choice([
        "/".join(rng.choices(VOCABULARY, k=6)), "_".join(rng.choices(VOCABULARY, k=5)), "".join(w.capitalize() for w in rng.choices(VOCABULARY, k=6)),
        "-" * 40, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789" * 3, "x" * 32, "ABABABABABABABABABABABABAB",
    ])


def test_random_tokens_are_found_and_words_are_not(spark):
    rng, rows, want = random.Random(3), [], {}
    for i in range(240):
        words = prose(rng).split()
        token = base64.b64encode(rng.randbytes(30)).decode().rstrip("=") if i % 3 == 0 else long_words(rng)
        at = rng.randrange(len(words))
        text = " ".join([*words[:at], token, *words[at:]])
        if i % 3 == 0:
            want[i] = (len(" ".join([*words[:at], ""])), token)
        rows.append((i, text))
    rows += [(900, None), (901, "")]
    found = {r["doc_id"]: r["spans"] for r in secrets.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    right = sum(f"random:{a}:{a + len(t)}" in found[i].split(",") for i, (a, t) in want.items())
    wrong = sum("random" in found[i] for i in range(240) if i not in want)
    assert right >= 0.95 * len(want) and wrong == 0, (right, len(want), wrong)
    assert found[900] == found[901] == ""


def test_battery_rejects_what_is_not_uniform(spark):
    rng = random.Random(4)
    alphabet = secrets.ALPHABET[:62]
    even = ["".join(rng.choices(alphabet, k=48)) for _ in range(200)]
    odd = [alphabet[:48], "aB" * 24, "a" * 24 + "Z" * 24, "".join(sorted(even[0]))]
    frame = spark.createDataFrame([(t,) for t in [*even, *odd]], "t string").select("t", secrets.uniformity(F.col("t")).alias("p"))
    p = {r["t"]: r["p"] for r in frame.collect()}
    assert sum(p[t] < 0.05 for t in even) <= 0.12 * len(even) and max(p[t] for t in odd) < 0.001


def test_short_tokens_need_more_evidence(spark):
    model = [math.log(1 / len(secrets.ALPHABET))] * len(secrets.ALPHABET)
    frame = spark.createDataFrame([("A7f3Kq9ZbT2mXw5L",), ("A7f3Kq9ZbT2mXw5L" * 2,)], "t string")
    got = [r[0] for r in frame.select(secrets.evidence(F.col("t"), model, 24.0, 0.001, 1e9) - secrets.log_e(F.col("t"), model)).collect()]
    assert got == pytest.approx([math.log(16 / 24), math.log(32 / 24)])


def test_added_kinds_of_personal_data(spark):
    rng = random.Random(5)
    plants = {
        "ssn": lambda: f"{rng.randint(100, 665)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}",
        "iban": lambda: rng.choice(["DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"]),
        "local_phone": lambda: f"(415) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}",
        "masked_email": lambda: f"{rng.choice(VOCABULARY)}[at]{rng.choice(VOCABULARY)}[dot]com",
        "person": lambda: f"Mr. {rng.choice(pii.GIVEN)}",
    }
    cues = {"ssn": "my ssn is", "iban": "pay to iban", "local_phone": "call phone", "masked_email": "write to", "person": "ask"}
    rows, want = [], {}
    for i in range(300):
        kind = rng.choice([*plants, None])
        if kind:
            head = f"{prose(rng, 12)} {cues[kind]} "
            span = plants[kind]()
            want[i] = f"{kind}:{len(head)}:{len(head) + len(span)}"
            rows.append((i, f"{head}{span} {prose(rng, 9)}"))
        else:
            rows.append((i, f"{prose(rng, 12)} version 10-20-3000 part no 123-45-678 {prose(rng, 9)}"))
    found = {r["doc_id"]: set(filter(None, r["spans"].split(","))) for r in pii.digest(spark.createDataFrame([*rows, (900, None)], "doc_id long, text string")).collect()}
    right, extra = sum(w in found[i] for i, w in want.items()), sum(len(s - {want.get(i)}) for i, s in found.items())
    assert right >= 0.9 * len(want) and extra <= 0.02 * len(want), (right, len(want), extra)


def test_estimation_recovers_reliabilities():
    """Votes drawn from known reliabilities: the posteriors part the classes."""
    rng, counts = random.Random(7), {}
    for _ in range(20_000):
        z = rng.random() < 0.4
        votes = tuple((1 if z else -1) * (1 if rng.random() < right else -1) for right in (0.95, 0.8, 0.75, 0.85))
        counts[votes] = counts.get(votes, 0) + 1
    patterns = [{"kind": "ssn", **dict(zip(pii.LABELERS, v, strict=True)), "n": n} for v, n in sorted(counts.items())]
    posterior, right = pii.estimate(patterns)
    assert abs(sum(p * r["n"] for p, r in zip(posterior, patterns, strict=True)) / 20_000 - 0.4) < 0.05
    assert all(abs(right[x, z] - want) < 0.06 for x, want in zip(pii.LABELERS, (0.95, 0.8, 0.75, 0.85), strict=True) for z in (0, 1))
    assert posterior[-1] > 0.99 and posterior[0] < 0.01
