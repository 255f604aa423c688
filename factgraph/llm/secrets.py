"""Secret scan (native): format rules, and a randomness battery with length-aware false-discovery control.

Three base kinds come from formats: ``assign``, ``access`` and ``hex``. The method adds ``random``
spans. Every token of 16 or more encoding characters gets an inferred encoding (digits, hex, base32,
alphanumeric, base64) and

* a likelihood ratio of "uniform over that encoding" against the corpus's own character
  distribution over such tokens, which grows with the length of the token;
* a battery of tests of uniformity: chi-squared over the alphabet, Wald-Wolfowitz runs about the
  middle symbol and lag-one serial correlation, Bonferroni-combined to one p-value.

The evidence for a token is the ratio times min(1, p / ``alpha``): what fails the battery loses its
evidence in proportion, and as the product never exceeds the ratio it is an e-value still. It is
weighted by the token's length over the mean length, so weights average 1 and a short token needs
more. Discoveries follow the weighted e-BH rule at ``fdr`` over all tokens of the corpus (Wang and
Ramdas 2022), which holds under any dependence between tokens; a second round takes the character
distribution from the tokens that the first did not discover. Character counts (66 rows), the mean
length and the histogram of log evidence (at most 6001 rows) are all that reaches the driver. Everything else is
row-local: no shuffle of texts, no Python on the executors. Distinct tokens with their counts go to
the shared folder.

Defined results: a null text counts as empty and has no spans; equal rows get equal results; an
empty table gives an empty result; the scan reads the id and text columns only, so extra columns
of any name do not matter. Tokens and texts may have any length.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factgraph.llm import spans as S
from factgraph.runtime import drop_materialised, materialise

#: The lookahead and lookbehinds change no match: they only spare positions where none can begin.
ASSIGN = r"""(?=[pPsStTaA][aAeEoOpP])(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}+"
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+"
#: Characters of a token, in the order that gives symbol values; the last stands for any other.
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/-_"
#: (pattern of the whole token, its alphabet), the narrowest first.
ENCODINGS = (
    (r"^[0-9]+$", ALPHABET[:10]),
    (r"^[0-9a-f]+$", ALPHABET[:16]),
    (r"^[0-9A-F]+$", ALPHABET[:10] + "ABCDEF"),
    (r"^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    (r"^[a-z]+$", ALPHABET[10:36]),
    (r"^[a-z0-9]+$", ALPHABET[:36]),
    (r"^[A-Z0-9]+$", ALPHABET[:10] + ALPHABET[36:62]),
    (r"^[A-Za-z0-9]+$", ALPHABET[:62]),
    (r"^[A-Za-z0-9+/]+$", ALPHABET[:64]),
    (r"^[A-Za-z0-9_-]+$", ALPHABET[:62] + "-_"),
    (r"^", ALPHABET),
)
KINDS = ("assign", "access", "hex", "random")
LOG_E_BIN, LOG_E_TOP = 0.01, 60.0


def _text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id_"), F.coalesce(F.col(text_col), F.lit("")).alias("text_"))


def base_spans(frame: DataFrame, text: str = "text_") -> DataFrame:
    """Add ``assign``, ``access`` and ``hex``: the matches of each base kind that are long enough."""
    frame = S.matches(frame, text, "assign", ASSIGN, group=1)
    frame = S.matches(frame, text, "access", ACCESS, guard=F.contains(F.col(text), F.lit("AKIA")))
    frame = S.matches(frame, text, "hex", HEX)
    return frame.withColumn("assign", F.filter("assign", lambda m: F.length(m["value"]) >= 12))


def corpus_tokens(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """(t, n): the distinct tokens of the corpus and how often each occurs, in the shared folder, so that both statistics cost one pass over the texts."""
    found = docs.select(F.explode(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(TOKEN), F.lit(0))).alias("t"))
    return materialise(found.groupBy("t").agg(F.count(F.lit(1)).alias("n")))


def character_model(tokens: DataFrame) -> list[float]:
    """Log probability of each character of ALPHABET over all tokens of the corpus (add-one smoothed)."""
    counts = {r["c"]: r["n"] for r in tokens.select(F.explode(F.split("t", "")).alias("c"), "n").where(F.col("c") != "").groupBy("c").agg(F.sum("n").alias("n")).collect()}
    whole = sum(counts.values()) + len(ALPHABET)
    return [math.log((counts.get(c, 0) + 1) / whole) for c in ALPHABET]


def _characters(token: Column) -> Column:
    return F.filter(F.split(token, ""), lambda c: c != "")


def _array(values: list, kind: str) -> Column:
    """A fixed array as one literal, which keeps the plan small."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def _encoding(token: Column) -> Column:
    """The number of the narrowest encoding that a token fits."""
    return F.coalesce(*[F.when(token.rlike(p), F.lit(i)) for i, (p, _) in enumerate(ENCODINGS)])


def log_e(token: Column, model: list[float]) -> Column:
    """Log e-value of "uniform over the inferred encoding" against the corpus's characters."""

    def text_like(value: Column) -> Column:
        # An unknown character, at 0, gets the least of all.
        logs = _array([min(model), *model], "double")
        return F.aggregate(_characters(value), F.lit(0.0), lambda t, c: t + F.get(logs, F.instr(F.lit(ALPHABET), c)))

    # Ordinary words in capitals are ordinary words: they are held to the model in lower case too.
    both = F.array(token, F.when(token.rlike("[a-z]"), token).otherwise(F.lower(token)))
    text = F.array_max(F.transform(both, text_like))
    size = F.get(_array([math.log(len(a)) for _, a in ENCODINGS], "double"), _encoding(token))
    return -F.length(token) * size - text - F.lit(math.log(len(ENCODINGS)))


def _tail(z: Column) -> Column:
    """P(Z > |z|) of a standard normal (Abramowitz and Stegun 26.2.17)."""
    x = F.abs(z)
    t = 1 / (1 + F.lit(0.2316419) * x)
    poly = t * (F.lit(0.319381530) + t * (F.lit(-0.356563782) + t * (F.lit(1.781477937) + t * (F.lit(-1.821255978) + t * F.lit(1.330274429)))))
    return F.exp(-x * x / 2) / F.lit(math.sqrt(2 * math.pi)) * poly


def uniformity(token: Column) -> Column:
    """The Bonferroni-combined p-value of the battery under "uniform over the inferred encoding"."""
    alphabet = F.get(_array([a for _, a in ENCODINGS], "string"), _encoding(token))

    def battery(s: Column) -> Column:
        n, size, values = s["n"].cast("double"), s["a"].cast("double"), s["v"]
        squares = F.aggregate(_characters(s["alphabet"]), F.lit(0.0), lambda t, c: t + F.pow(F.length(token) - F.length(F.replace(token, c, F.lit(""))), F.lit(2.0)))
        chi = squares * size / n - n
        z_chi = (chi - (size - 1)) / F.sqrt(2 * (size - 1) * (n - 1) / n)
        high = F.aggregate(values, F.lit(0.0), lambda t, v: t + F.when(2 * v >= size, 1.0).otherwise(0.0))
        low = n - high
        later = F.slice(values, F.lit(2), F.size(values))
        head = F.slice(values, F.lit(1), F.size(values) - 1)
        runs = 1 + F.aggregate(F.zip_with(head, later, lambda a, b: F.when((2 * a >= size) != (2 * b >= size), 1.0).otherwise(0.0)), F.lit(0.0), lambda t, x: t + x)
        expected = 2 * high * low / n + 1
        variance = (expected - 1) * (expected - 2) / (n - 1)
        z_runs = F.when(variance > 0, (runs - expected) / F.sqrt(variance)).otherwise(F.lit(9.0))
        mean = F.aggregate(values, F.lit(0.0), lambda t, v: t + v) / n
        square = F.aggregate(values, F.lit(0.0), lambda t, v: t + (v - mean) * (v - mean))
        lagged = F.aggregate(F.zip_with(head, later, lambda a, b: (a - mean) * (b - mean)), F.lit(0.0), lambda t, x: t + x)
        z_serial = F.when(square > 0, (lagged / square + 1 / (n - 1)) * F.sqrt(n)).otherwise(F.lit(9.0))
        p_chi = F.when(z_chi > 0, _tail(z_chi)).otherwise(F.lit(1.0))
        return F.least(F.lit(1.0), 3 * F.least(p_chi, 2 * _tail(z_runs), 2 * _tail(z_serial)))

    def parts(a: Column) -> Column:
        values = F.transform(_characters(token), lambda c: (F.instr(a, c) - 1).cast("double"))
        return F.struct(F.length(token).alias("n"), F.length(a).alias("a"), a.alias("alphabet"), values.alias("v"))

    return S.bind(S.bind(alphabet, parts), battery)


def mean_length(tokens: DataFrame) -> float:
    """The mean length of a token of the corpus, 1 at least."""
    return float(tokens.agg(F.sum(F.col("n") * F.length("t")) / F.sum("n")).first()[0] or 1.0)


def evidence(token: Column, model: list[float], mean: float, alpha: float, least: float) -> Column:
    """Log of the weighted e-value of a token; the battery is run only if that can be ``least`` or more."""
    most = log_e(token, model) + F.log(F.length(token) / F.lit(mean))
    penalty = F.least(F.lit(0.0), F.log(F.greatest(uniformity(token), F.lit(1e-300))) - F.lit(math.log(alpha)))
    return S.bind(most, lambda m: F.when(m >= least, m + penalty).otherwise(m))


def spread(tokens: DataFrame) -> DataFrame:
    """The tokens over as many tasks as a shuffle has: few bytes, but much to compute."""
    return tokens.repartition(int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def discovery_threshold(tokens: DataFrame, model: list[float], mean: float, *, fdr: float = 0.01, alpha: float = 0.001) -> float:
    """The log evidence from which weighted e-BH rejects, over every token of the corpus."""
    floor = math.log(1 / fdr)
    bins = F.when(F.col("e") >= floor, F.floor(F.least(F.col("e"), F.lit(LOG_E_TOP)) / LOG_E_BIN).cast("int"))
    found = spread(tokens).select(evidence(F.col("t"), model, mean, alpha, floor).alias("e"), "n").groupBy(bins.alias("bin")).agg(F.sum("n").alias("n")).collect()
    tested, rejected = sum(r["n"] for r in found), 0
    best = math.inf
    for bin_, n in sorted(((r["bin"], r["n"]) for r in found if r["bin"] is not None), reverse=True):
        rejected += n
        if bin_ * LOG_E_BIN >= math.log(tested / (fdr * rejected)):
            best = bin_ * LOG_E_BIN
    return best


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", fdr: float = 0.01, alpha: float = 0.001, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: the id, ``base`` and ``all`` spans as array<struct<rank, kind, start, end>>, and counts.

    ``keep`` names further columns of ``docs`` to carry along.
    """
    counted = corpus_tokens(docs, text_col=text_col)
    model = character_model(counted)
    mean = mean_length(counted)
    threshold = discovery_threshold(counted, model, mean, fdr=fdr, alpha=alpha)
    if not math.isinf(threshold):
        # What was found is no ordinary token: the rest gives the distribution that the final evidence is held against.
        model = character_model(spread(counted).where(evidence(F.col("t"), model, mean, alpha, threshold) < threshold))
        threshold = discovery_threshold(counted, model, mean, fdr=fdr, alpha=alpha)
    drop_materialised(docs.sparkSession, counted)
    frame = docs.select(F.col(id_col).alias("id_"), F.coalesce(F.col(text_col), F.lit("")).alias("text_"), F.struct(*[F.col(c) for c in keep] or [F.lit(0).alias("none")]).alias("keep_"))
    frame = base_spans(frame)
    frame = frame.withColumn("base", F.concat(*[S.label(F.col(k), k, i) for i, k in enumerate(KINDS[:3])]))
    if math.isinf(threshold):
        frame = frame.withColumn("more", F.array().cast("array<struct<rank:int,kind:string,start:int,end:int>>"))
    else:
        tokens = F.regexp_extract_all(F.col("text_"), F.lit(TOKEN), F.lit(0))
        # The matches are these tokens in the same order, so each token's evidence is computed once.
        frame = frame.withColumn("evidence_", F.transform(tokens, lambda t: evidence(t, model, mean, alpha, threshold)))
        frame = S.matches(frame, "text_", "token", TOKEN, guard=F.exists("evidence_", lambda e: e >= threshold))
        token = F.zip_with("token", "evidence_", lambda t, e: F.struct(t["start"].alias("start"), t["end"].alias("end"), e.alias("e")))
        token = F.filter(token, lambda t: t["start"].isNotNull() & (t["e"] >= threshold) & ~S.overlaps(t, F.col("base")))
        frame = frame.withColumn("more", S.label(token, "random", 3))
    frame = frame.withColumn("base", S.by_start(F.col("base")))
    return frame.select(
        F.col("id_").alias(id_col), "text_", "keep_", "base", S.by_start(F.concat("base", "more")).alias("all"),
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]], F.size("more").cast("long").alias("n_random"),
    )


def digest(docs: DataFrame, **options) -> DataFrame:
    """``scan`` as flat columns: counts, a hash of the base spans, and all spans as text."""
    found = scan(docs, **options)
    return found.select(found.columns[0], "n_assign", "n_access", "n_hex", F.sha2(S.joined(F.col("base")), 256).alias("base_sha256"), S.joined(F.col("all")).alias("spans"), "n_random")


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]", **options) -> DataFrame:
    """The documents, all columns as they were, with every secret in the text replaced by ``mark``.

    A text without secrets, null included, stays as it is.
    """
    found = scan(docs, id_col=id_col, text_col=text_col, keep=tuple(docs.columns), **options)
    clean = F.when(F.size("all") > 0, S.redact(F.col("text_"), F.col("all"), F.lit(mark))).otherwise(F.col(f"keep_.`{text_col}`"))
    return found.select(*[clean.alias(c) if c == text_col else F.col(f"keep_.`{c}`").alias(c) for c in docs.columns])
