"""Personal data by weak supervision (native).

Regular expressions propose candidate spans. Four labelers vote on each (-1, 0 or 1): ``format``
(checksums and ranges), ``gazetteer`` (host endings, calling codes, issuer and country prefixes,
given names), ``context`` (cue words between the span and the match before it) and ``boundary`` (what touches it). Votes are
aggregated over the whole corpus to vote patterns, at most ``kinds * 3**4`` rows whatever its size;
expectation-maximisation over that table estimates each labeler's reliabilities and every pattern's
posterior, and a logistic span classifier is trained on the posteriors. Its weights become a column
expression that scores spans in the final scan. The four base kinds are kept wherever their format
holds; the method adds spans of the other kinds that the classifier accepts.

Both scans are row-local: no shuffle of texts, no Python on the executors. The driver sees the
pattern table only.

Defined results: a null text counts as empty and has no spans; equal rows get equal results; an
empty table gives an empty result; only the id and text columns are read, so extra columns of any
name do not matter. Patterns are possessive, so matches of any length need no recursion.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factgraph.llm import spans as S

LOCAL = r"[A-Za-z0-9._%+-]"
#: A run of local characters is tried from its start, or from where the last match ended, only.
EMAIL = rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}+(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
LOCAL_PHONE = r"(?<![0-9+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])"
MASKED = r"[A-Za-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:[\[(]dot[\])]|\.)\x20?[A-Za-z0-9-]{1,63})++"
PERSON = r"(?<![A-Za-z])(?:Mr\.|Mrs\.|Ms\.|Dr\.|Herr|Frau|Mme)\x20\p{Lu}\p{Ll}+(?:\x20\p{Lu}\p{Ll}+)?"

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "ssn", "iban", "local_phone", "masked_email", "person")
LABELERS = ("format", "gazetteer", "context", "boundary")

# Public gazetteers.
ENDINGS = ("com", "org", "net", "edu", "gov", "info", "io", "eu", "de", "fr", "es", "it", "uk", "us", "ca", "ch", "at", "nl", "be", "pl", "se", "br", "mx", "in", "jp", "cn", "au")
CALLING = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|35|6011|65)"
COUNTRIES = ("AT", "BE", "CH", "CZ", "DE", "DK", "ES", "FI", "FR", "GB", "HU", "IE", "IT", "LU", "NL", "NO", "PL", "PT", "SE", "SK")
GIVEN = ("Anna", "Maria", "John", "James", "Peter", "Paul", "Thomas", "Michael", "Robert", "David", "Laura", "Sarah", "Emma", "Sophie", "Hans", "Klaus", "Jean", "Pierre", "Carlos", "Juan")
CUES = r"(?i)(?:phone|tel|call|mobile|fax|e-?mail|mail|contact|card|visa|credit|ssn|social security|iban|account|server|host|address|write to)[^\n]{0,12}$"
ANTI_CUES = r"(?i)(?:version|section|chapter|figure|isbn|part no|serial|order|price|release)[^\n]{0,12}$"


def digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    values = F.transform(F.split(F.reverse(number), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, 2 * c.cast("int") - 9).otherwise(2 * c.cast("int"))))
    return F.aggregate(values, F.lit(0), lambda t, x: t + F.coalesce(x, F.lit(0))) % 10 == 0


def _mod97(found: Column) -> Column:
    """The check remainder of an account number: first four characters last, letters as 10 to 35."""
    plain = F.replace(found, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), lambda t, c: (t * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97)


def _octets(found: Column) -> Column:
    return F.forall(F.split(found, r"\."), lambda p: p.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def _holds(kind: str, found: Column) -> Column:
    """Whether a match of this kind has the right format."""
    number = F.length(digits(found))
    return {
        "email": F.lit(True),
        "ip": _octets(found),
        "card": (number <= 19) & luhn(digits(found)),
        "phone": number.between(9, 15),
        "ssn": ~found.rlike("^(?:000|666|9)") & ~found.rlike("-00-|-0000$"),
        "iban": _mod97(found) == 1,
        "local_phone": number == 10,
        "masked_email": F.lit(True),
        "person": F.lit(True),
    }[kind]


def _gazetteer(kind: str, found: Column) -> Column:
    listed, unlisted = F.lit(1), F.lit(-1)
    ending = F.lower(F.regexp_extract(found, r"([A-Za-z0-9-]+)$", 1))
    return {
        "email": F.when(ending.isin(*ENDINGS), listed).otherwise(F.lit(0)),
        "ip": F.when(found.rlike(r"^(?:0|10|127|192\.168|255)\."), unlisted).otherwise(F.lit(0)),
        "card": F.when(digits(found).rlike(ISSUERS), listed).otherwise(unlisted),
        "phone": F.when(found.rlike(CALLING), listed).otherwise(unlisted),
        "ssn": F.lit(0),
        "iban": F.when(F.substring(found, 1, 2).isin(*COUNTRIES), listed).otherwise(unlisted),
        "local_phone": F.when(digits(found).rlike("^[2-9][0-9]{2}[2-9]"), listed).otherwise(unlisted),
        "masked_email": F.when(ending.isin(*ENDINGS), listed).otherwise(unlisted),
        "person": F.when(F.regexp_extract(found, r"\x20(\p{Lu}\p{Ll}+)", 1).isin(*GIVEN), listed).otherwise(F.lit(0)),
    }[kind]


def _label(kind: str, span: Column) -> Column:
    found, before = span["found"], span["before"]
    touched = before.rlike(r"[\p{L}\p{N}_]$") | span["after"].rlike(r"[\p{L}\p{N}_]")
    vote = F.when(_holds(kind, found), 1).otherwise(-1)
    cue = F.when(before.rlike(CUES), 1).when(before.rlike(ANTI_CUES), -1).otherwise(0)
    return F.struct(
        F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), span["start"].alias("start"), span["end"].alias("end"),
        vote.alias("format"), _gazetteer(kind, found).alias("gazetteer"), cue.alias("context"), F.when(touched, -1).otherwise(1).alias("boundary"),
    )


def _labelled(kind: str) -> Callable[[Column], Column]:
    return lambda span: _label(kind, span)


def candidates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``spans``, every candidate with its votes, by kind as listed and then by start."""
    text = F.col("text_")
    frame = docs.select(F.col(id_col).alias("id_"), F.coalesce(F.col(text_col), F.lit("")).alias("text_"))
    frame = frame.withColumn("digit_", text.rlike("[0-9]"))
    has = lambda *words: sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0)) > 0
    guards = {"email": has("@"), "masked_email": has("[at]", "(at)"), "person": has("Mr. ", "Mrs. ", "Ms. ", "Dr. ", "Herr ", "Frau ", "Mme "), "phone": F.col("digit_") & has("+"), "iban": F.col("digit_"), "local_phone": F.col("digit_")}
    frame = frame.withColumns({f"guard_{k}": g for k, g in guards.items()})
    patterns = (EMAIL, IP, CARD, PHONE, SSN, IBAN, LOCAL_PHONE, MASKED, PERSON)
    for kind, pattern in zip(KINDS, patterns, strict=True):
        frame = S.matches(frame, "text_", kind, pattern, guard=F.col(f"guard_{kind}" if kind in guards else "digit_"))
        frame = frame.withColumn(kind, F.transform(kind, _labelled(kind)))
    return frame.select(F.col("id_").alias(id_col), F.concat(*KINDS).alias("spans"))


def vote_patterns(found: DataFrame) -> list[dict]:
    """How many candidates there are per kind and votes: a bounded table."""
    # One string per candidate: a struct would let the optimizer take each field from its own copy of the scan's expressions.
    votes = F.transform("spans", lambda s: F.concat_ws("|", s["kind"], *[s[x].cast("string") for x in LABELERS]))
    rows = found.select(F.explode(votes).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n")).collect()
    found_votes = [(r["v"].split("|"), r["n"]) for r in sorted(rows, key=lambda r: r["v"])]
    return [{"kind": v[0], **{x: int(y) for x, y in zip(LABELERS, v[1:], strict=True)}, "n": n} for v, n in found_votes]


def estimate(patterns: list[dict], rounds: int = 50) -> tuple[list[float], dict]:
    """Expectation-maximisation over the patterns: each one's posterior, and the labelers' reliabilities.

    A labeler has, for each class, a probability of being right when it votes; a vote of 0 abstains
    and is no evidence. Every kind has a prior. Counts are smoothed towards labelers that are right
    nine times in ten.
    """
    posterior = [1 / (1 + math.exp(-1.5 * sum(r[x] for x in LABELERS))) for r in patterns]
    right = {}
    for _ in range(rounds):
        prior = {k: [1.0, 1.0] for k in KINDS}
        seen = {(x, z): [9.0, 10.0] for x in LABELERS for z in (0, 1)}
        for r, p in zip(patterns, posterior, strict=True):
            for z, weight in ((1, p * r["n"]), (0, (1 - p) * r["n"])):
                prior[r["kind"]][z] += weight
                for x in LABELERS:
                    if r[x]:
                        seen[x, z][0] += weight * (r[x] == 2 * z - 1)
                        seen[x, z][1] += weight
        right = {k: v[0] / v[1] for k, v in seen.items()}
        posterior = []
        for r in patterns:
            logs = [math.log(prior[r["kind"]][z] / sum(prior[r["kind"]])) + sum(math.log(right[x, z] if r[x] == 2 * z - 1 else 1 - right[x, z]) for x in LABELERS if r[x]) for z in (0, 1)]
            posterior.append(1 / (1 + math.exp(max(-700.0, min(700.0, logs[0] - logs[1])))))
    return posterior, right


def _features(r: dict) -> list[float]:
    return [1.0, *[float(r["kind"] == k) for k in KINDS], *[float(r[x] == v) for x in LABELERS for v in (-1, 1)]]


def train(patterns: list[dict], posterior: list[float], rounds: int = 400, l2: float = 0.01) -> list[float]:
    """Weights of a logistic classifier on kind and votes, fitted to the posteriors by gradient descent.

    Each pattern counts by the logarithm of its frequency, so that one very common pattern does not
    drown the others.
    """
    rows = [(_features(r), p, math.log1p(r["n"])) for r, p in zip(patterns, posterior, strict=True)]
    weights = [0.0] * len(_features(dict.fromkeys(("kind", *LABELERS), 0)))
    mass = sum(n for _, _, n in rows) or 1.0
    for _ in range(rounds):
        gradient = [l2 * w for w in weights]
        for x, p, n in rows:
            error = 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, weights, strict=True)))) - p
            for i, a in enumerate(x):
                if a:
                    gradient[i] += n * error * a / mass
        weights = [w - 2.0 * g for w, g in zip(weights, gradient, strict=True)]
    return weights


def score(span: Column, weights: list[float]) -> Column:
    """The classifier's probability for a candidate."""
    names = iter(weights[1:])
    z = F.lit(weights[0])
    for k in KINDS:
        z = z + F.when(span["kind"] == k, F.lit(next(names))).otherwise(F.lit(0.0))
    for x in LABELERS:
        for v in (-1, 1):
            z = z + F.when(span[x] == v, F.lit(next(names))).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-z))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", accept: float = 0.5) -> DataFrame:
    """Per document: the id, ``base`` and ``all`` spans, by kind as listed and then by start."""
    found = candidates(docs, id_col=id_col, text_col=text_col)
    patterns = vote_patterns(found)
    weights = train(patterns, estimate(patterns)[0])
    base = F.filter("spans", lambda s: (s["rank"] < len(BASE)) & (s["format"] == 1))
    found = found.withColumn("base", base)
    more = F.filter("spans", lambda s: (s["rank"] >= len(BASE)) & (score(s, weights) >= accept) & ~S.overlaps(s, F.col("base")))
    return found.select(id_col, "base", F.concat("base", more).alias("all"))


def digest(docs: DataFrame, **options) -> DataFrame:
    """``scan`` as flat columns: counts, a hash of the base spans, and all spans as text."""
    found = scan(docs, **options)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(found.columns[0], *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(S.joined(F.col("base")), 256).alias("base_sha256"), S.joined(F.col("all")).alias("spans"))
