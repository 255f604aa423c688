"""Quality rules as a bitmask ledger (native).

``ledger`` evaluates every rule once per document and stores the measurements beside a long whose
bits say which rules failed. Policies are versioned sets of bits that are applied to the ledger
later, without touching the text again; ``ablate`` counts, per rule, what a policy would let
through without it, by bitwise aggregation over the distinct bit patterns (at most ``2**rules``).

Everything is row-local DataFrame functions: one scan, no shuffle, no Python on the executors.

Defined results: a null or empty text has no words, so every count is 0, ``short`` fails and the
document is rejected; repeated rows are judged one by one and alike; an empty table gives an empty
ledger; extra columns are kept out of the ledger, and a document column that has the name of a
measurement cannot clash, because the ledger selects the id and the text only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WORD_CHAR = r"[^\x20\x09-\x0D]"
WINDOW = 8

MEASUREMENTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper")


@dataclass(frozen=True)
class Rule:
    """A named predicate over the measurements; true means that the document fails."""

    name: str
    fails: Column | str

    def column(self) -> Column:
        return F.expr(self.fails) if isinstance(self.fails, str) else self.fails


#: The position in this tuple is the bit: append only, so that stored ledgers stay readable.
RULES = (
    Rule("short", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", "10 * n_symbols > 2 * n_words"),
    Rule("duplicate_lines", "n_lines >= 5 AND 100 * n_dup_lines > 40 * n_lines"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 14 * n_words"),
    Rule("few_letters", "100 * n_letters < 60 * word_chars"),
    Rule("upper_case", "100 * n_upper > 40 * n_letters"),
)

#: Versioned policies: the rules whose failure rejects a document.
POLICIES = {
    "base": ("short", "repeated_windows"),
    "v1": tuple(rule.name for rule in RULES),
}


def mask(policy: str | tuple[str, ...]) -> int:
    """The bits of a policy, given by version or as rule names."""
    names = POLICIES[policy] if isinstance(policy, str) else policy
    bits = {rule.name: 1 << i for i, rule in enumerate(RULES)}
    unknown = [name for name in names if name not in bits]
    if unknown:
        raise ValueError(f"unknown rules: {unknown}")
    return sum(bits[name] for name in set(names))


def _shifted(array: str, by: int) -> Column:
    return F.slice(F.col(array), F.lit(by + 1), F.greatest(F.size(array), F.lit(1)))


def _pair_hashes(array: str, by: int) -> Column:
    """At i, a hash of elements i and i + by; the tail, where i + by is past the end, is cut later."""
    return F.zip_with(F.col(array), _shifted(array, by), lambda a, b: F.xxhash64(a, b))


def _covered(ranked: Column) -> Column:
    """How many words lie in windows whose hash occurs at least twice.

    ``ranked`` holds (hash, position) in order, so equal windows stand side by side; the positions
    of such windows cover min(WINDOW, gap to the next) words each and the last one WINDOW.
    """

    # A transform over a one-element array binds its element, so that it is computed once.
    def bind(value: Column, use) -> Column:
        return F.element_at(F.transform(F.array(value), use), 1)

    def positions(s: Column) -> Column:
        pairs = F.zip_with(s, F.slice(s, F.lit(2), F.size(s)), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
        return F.array_sort(F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull()))))

    def total(p: Column) -> Column:
        gaps = F.zip_with(p, F.slice(p, F.lit(2), F.size(p)), lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda t, x: t + x)

    return bind(bind(ranked, positions), total)


def measure(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and every measurement of the rules, one row per document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # A barrier between steps is not needed: Catalyst keeps a projection apart when a costly
    # expression of it is used more than once above.
    step = docs.select(F.col(id_col), text.alias("text_"))
    step = step.select(id_col, "text_", F.array_remove(F.split("text_", SPACE), "").alias("words_"), F.split("text_", "\n").alias("lines_"))
    step = step.select(
        id_col, "text_", F.array_join("words_", "").alias("joined_"), F.size("words_").cast("long").alias("n_words"),
        F.transform("words_", lambda w: F.xxhash64(w)).alias("w1_"),
        F.filter("lines_", lambda line: line.rlike(WORD_CHAR)).alias("lines_"),
    )
    step = step.withColumn("w2_", _pair_hashes("w1_", 1))
    step = step.withColumn("w4_", _pair_hashes("w2_", 2))
    step = step.withColumn("w8_", F.when(F.col("n_words") >= WINDOW, F.slice(_pair_hashes("w4_", 4), F.lit(1), (F.col("n_words") - (WINDOW - 1)).cast("int"))).otherwise(F.array().cast("array<bigint>")))
    ranked = F.sort_array(F.transform(F.col("w8_"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    letters = F.length(F.regexp_replace("joined_", r"[^\p{L}\p{M}]+", ""))
    return step.select(
        id_col, "n_words", F.length("joined_").cast("long").alias("word_chars"),
        F.regexp_count("text_", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("w8_")) < F.size("w8_"), _covered(ranked)).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"),
        F.size("lines_").cast("long").alias("n_lines"), letters.cast("long").alias("n_letters"),
        F.length(F.regexp_replace("joined_", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
    )


def ledger(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The measurements and ``fail_bits``: bit i is set where rule i fails."""
    bits = sum((F.when(rule.column(), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, rule in enumerate(rules)), F.lit(0).cast("long"))
    return measure(docs, id_col=id_col, text_col=text_col).withColumn("fail_bits", bits)


def apply_policy(entries: DataFrame, policy: str | tuple[str, ...] = "v1") -> DataFrame:
    """Add ``base_failed`` and ``kept``: whether the document passes the base rules and the policy."""
    base = F.col("fail_bits").bitwiseAND(F.lit(mask("base")).cast("long")) != 0
    fails = F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("long")) != 0
    return entries.withColumn("base_failed", base).withColumn("kept", ~base & ~fails)


def ablate(entries: DataFrame, policy: str | tuple[str, ...] = "v1") -> DataFrame:
    """Per rule: how many documents fail it, and how many the policy rejects for it alone.

    The ledger is first folded to its distinct bit patterns, so the second step sees a bounded
    number of rows at any size of the corpus.
    """
    wanted = F.lit(mask(policy)).cast("long")
    patterns = entries.groupBy(F.col("fail_bits").bitwiseAND(F.lit((1 << len(RULES)) - 1).cast("long")).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(rule.name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, rule in enumerate(RULES)]))
    spread = patterns.select("bits", "n", rules.alias("r")).select("bits", "n", "r.rule", "r.bit")
    return spread.groupBy("rule", "bit").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when((F.col("bits").bitwiseAND(wanted) == F.col("bit")), F.col("n")).otherwise(0)).alias("n_only"),
    )


def quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", policy: str | tuple[str, ...] = "v1") -> DataFrame:
    """The ledger with the verdict of a policy."""
    return apply_policy(ledger(docs, id_col=id_col, text_col=text_col), policy)


ORACLE_SQL = r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), m AS (
  SELECT doc_id, w, len(w)::BIGINT AS n_words,
         length(array_to_string(w, ''))::BIGINT AS word_chars, array_to_string(w, '') AS j,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l)::BIGINT AS n_lines
  FROM base
), win AS (
  SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS g
  FROM m, unnest(range(1, greatest(len(w) - 6, 1))) AS u(i) WHERE len(w) >= 8
), dup AS (
  SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) >= 2
), cov AS (
  SELECT doc_id, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n_repeat_words
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM dup) GROUP BY doc_id
), f AS (
  SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, n_lines,
         length(regexp_replace(j, '[^\p{L}\p{M}]+', '', 'g'))::BIGINT AS n_letters,
         length(regexp_replace(j, '[^\p{Lu}]+', '', 'g'))::BIGINT AS n_upper
  FROM m LEFT JOIN cov ON m.doc_id = cov.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > 2 * n_words
            OR (n_lines >= 5 AND 100 * n_dup_lines > 40 * n_lines)
            OR word_chars < 2 * n_words OR word_chars > 14 * n_words
            OR 100 * n_letters < 60 * word_chars OR 100 * n_upper > 40 * n_letters) AS kept,
       ((n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT + 4 * (10 * n_symbols > 2 * n_words)::BIGINT
        + 8 * (n_lines >= 5 AND 100 * n_dup_lines > 40 * n_lines)::BIGINT
        + 16 * (word_chars < 2 * n_words OR word_chars > 14 * n_words)::BIGINT
        + 32 * (100 * n_letters < 60 * word_chars)::BIGINT + 64 * (100 * n_upper > 40 * n_letters)::BIGINT)::BIGINT AS fail_bits
FROM f
"""

ABLATION_SQL = f"""WITH ledger AS ({ORACLE_SQL}), rules(rule, bit) AS (VALUES {", ".join(f"('{rule.name}', {1 << i}::BIGINT)" for i, rule in enumerate(RULES))})
SELECT rule, bit, count(*) FILTER (fail_bits & bit <> 0) AS n_failed, count(*) FILTER (fail_bits = bit) AS n_only FROM ledger, rules GROUP BY 1, 2"""

COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")
