"""Rows that share an id or have none, very long texts, and columns with clashing names lose nothing."""

import pytest
from pyspark.sql import functions as F

from factgraph.llm import mixing, neardup, pii, simhash, spans

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
ALPHA, BETA = " ".join(WORDS * 4), " ".join(reversed([w + "x" for w in WORDS * 4]))


@pytest.mark.parametrize("stage", [simhash.representatives, neardup.representatives])
def test_representatives_lose_no_text(spark, stage):
    def kept(rows):
        return sorted(((r[0], r[1]) for r in stage(spark.createDataFrame(rows, "doc_id long, text string, extra int")).collect()), key=str)

    assert kept([(5, ALPHA, 1), (5, BETA, 1), (2, BETA, 1), (None, BETA, 1)]) == [(2, BETA), (5, ALPHA)]
    assert kept([(3, ALPHA, 1), (3, ALPHA, 1), (None, BETA, 1), (None, BETA, 1), (None, BETA, 2)]) == [(3, ALPHA), (None, BETA)]


LONG = {
    "email": "a." * 20_000 + "b@" + "c." * 20_000 + "de", "ip": "1" * 20_000 + ".2.3.4 " + "1.2.3.4." * 5_000, "card": "4 " * 20_000,
    "phone": "+1" + "(2) " * 10_000 + "3", "ssn": "123-45-6789" * 3_000, "iban": "DE89" + " 3704" * 10_000, "local_phone": "555-123-4567" * 3_000,
    "masked_email": "x[at]a" + ".a" * 20_000, "person": "Mr. " + "Xx" * 20_000,
}


def test_very_long_matches_need_no_recursion(spark):
    frame = spark.createDataFrame([*enumerate(LONG.values()), (99, "mail x[at]a.com now")], "doc_id long, text string")
    found = {r["doc_id"]: {s["kind"] for s in r["spans"]} for r in pii.candidates(frame).collect()}
    assert len(found) == len(LONG) + 1 and "masked_email" in found[99]
    for i, kind in enumerate(LONG):
        assert kind not in ("email", "card", "phone", "masked_email") or kind in found[i]


def test_schedule_columns_give_way(spark):
    docs = spark.createDataFrame([(i, "s", 1, 2, 3) for i in range(6)], "doc_id long, source string, position int, Slot int, epoch_ int")
    found = mixing.mix(docs, keep=tuple(docs.columns), block=2)
    assert found.columns == ["doc_id", "source", "position", "Slot", "epoch_", "epoch", "slot_", "position_"]
    assert sorted(r["position_"] for r in found.collect()) == list(range(6))


def test_redaction_of_very_many_spans(spark):
    n = 20_000
    frame = spark.range(1).select(F.repeat(F.lit("ab"), n).alias("t"), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct((2 * i).alias("start"), (2 * i + 1).alias("end"))).alias("s"))
    assert frame.select(spans.redact(F.col("t"), F.col("s"), F.lit("#"))).first()[0] == "#b" * n
