"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton over folded text.

Folding lower-cases, maps homoglyphs (Cyrillic, Greek, full-width) and digit substitutions to the
letters they stand for, undoes symbols written between letters, and turns other punctuation into
blanks, so that every lexicon entry starts at a word. An entry is a whole word or a stem.

The lexicon is learned: over a bounded sample of labelled rows (``sample_toxic`` and
``sample_clean``, the rows with the smallest crc32 of their id) words and stems are kept whose
presence is significantly and almost purely toxic; the weight is the log odds. Near copies in the
sample count once. Phrases that hold an entry but occur in clean texts only are exceptions, as are
the listed ones; a hit inside an exception does not count. A text's score is a logistic function of
its weight and of its weight per thousand words, fitted on the same sample.

Scoring is row-local in Arrow batches; each text is taken whole. All that is collected to learn from
comes from the bounded sample; of the entries the ``max_entries`` heaviest are the lexicon.

Defined results: a null or empty text has no hits and gets the score of a clean text; without
labelled rows of both classes the lexicon is empty and all scores are 0; repeated rows are scored
alike, each; an empty table gives an empty result; label rows with nulls are ignored and repeated
label rows count once; only the id, text and toxic columns are read, so extra columns do not matter.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.llm.rows import id_type

# Look-alike letters and digit substitutions, and what they stand for.
HOMOGLYPHS = dict(zip("аеорсухіјѕһԁԛԝѵαεικνορτυχɡıℓ", "aeopcyxijshdqwvaeiknoptuxgil", strict=True))
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
BETWEEN = {"@": "a", "$": "s", "!": "i", "|": "l", "*": ""}
#: Phrases in which a lexicon word is harmless.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "pond scum", "stupid simple")

_BLANK = {c: " " for c in range(128) if not chr(c).isalnum()} | {c: " " for c in map(ord, "«»„“”‘’…–—¿¡")}
_FULL = {0xFF01 + i: chr(0x21 + i).lower() for i in range(94)}
_TABLE = {ord(k): v for k, v in (HOMOGLYPHS | DIGITS).items()}
_FOLD = {**_FULL, **_BLANK, **_TABLE}
_BETWEEN = re.compile(r"(?<=[^\W\d_])[@$!|*](?=[^\W\d_])")
STEMS = (4, 5, 6, 7)


def fold(text: str | None) -> str:
    """The folded words of a text, each between blanks."""
    if not text:
        return " "
    text = text.lower()
    if any(c in text for c in BETWEEN):
        text = _BETWEEN.sub(lambda m: BETWEEN[m[0]], text)
    return f" {' '.join(text.translate(_FOLD).split())} "


@dataclass
class Lexicon:
    """Entries (``" stem"`` or ``" word "``) with weights, exception phrases, and the score's weights."""

    entries: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    logistic: tuple[float, float, float] | None = None

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for entry, weight in self.entries.items():
            found.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            found.add_word(f" {phrase} ", (len(phrase) + 2, 0.0))
        found.make_automaton()
        return found


def hits(folded: str, automaton) -> list[tuple[int, int, float]]:
    """(start, end, weight) of the entries in a folded text that no exception phrase covers; at each start the heaviest counts."""
    if not len(automaton):
        return []
    found, reach = {}, {}
    for end, (size, weight) in automaton.iter(folded):
        start = end - size + 1
        if weight:
            if weight > found.get(start, (0, 0.0))[1]:
                found[start] = (end + 1, weight)
        else:
            reach[start] = max(reach.get(start, 0), end)
    if not reach:
        return [(s, e, w) for s, (e, w) in found.items()]
    # How far the exceptions that begin at or before each place reach; their last character is a blank.
    starts = sorted(reach)
    ends = list(accumulate((reach[s] for s in starts), max))
    return [(s, e, w) for s, (e, w) in found.items() if not (k := bisect_right(starts, s)) or s >= ends[k - 1]]


def weigh(text: str | None, automaton) -> tuple[float, int, int]:
    """Weight of the hits, how many there are, and the number of words."""
    folded = fold(text)
    found = hits(folded, automaton)
    return sum(w for _, _, w in found), len(found), max(0, folded.count(" ") - 1)


def _inputs(weight: float, words: int) -> tuple[float, float]:
    return math.log1p(weight), math.log1p(1000 * weight / (words + 20))


def probability(weight: float, words: int, logistic: tuple[float, float, float] | None) -> float:
    if logistic is None:
        return 0.0
    a, b = _inputs(weight, words)
    z = logistic[0] + logistic[1] * a + logistic[2] * b
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def _terms(folded: str) -> set[str]:
    words = set(folded.split())
    return {f" {w} " for w in words if len(w) >= 3} | {f" {w[:n]}" for w in words for n in STEMS if len(w) >= n}


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            terms = sorted(_terms(fold(text)))
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([toxic] * len(terms), pa.int32())], names=["term", "toxic"])


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh64_intdigest

    for batch in batches:
        keys = []
        for text in batch.column(1).to_pylist():
            words = (text or "").split()
            shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
            keys.append([min(xxh64_intdigest(s, seed) >> 1 for s in shingles) for seed in range(3)])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array([k[i] for k in keys], pa.int64()) for i in range(3)]], names=["toxic", "text", "a", "b", "c"])


def training_sample(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, sample_toxic: int, sample_clean: int) -> DataFrame:
    """(toxic, text) of a bounded number of labelled rows, near copies once."""
    usable = labels.select(F.col(id_col).alias("id_"), F.col("toxic").cast("int").alias("toxic")).where("id_ is not null and toxic is not null").distinct()
    rank = [F.crc32(F.col("id_").cast("string")), F.col("id_")]
    ids = usable.where("toxic = 1").orderBy(*rank).limit(sample_toxic).unionByName(usable.where("toxic = 0").orderBy(*rank).limit(sample_clean))
    texts = docs.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text"))
    # The broadcast side has sample_toxic + sample_clean rows at most.
    rows = texts.join(F.broadcast(ids), "id_").select("toxic", "text").mapInArrow(_sketches, "toxic int, text string, a long, b long, c long")
    # Of texts that share a sketch the smallest stays, whatever the order in which they come.
    for sketch in "abc":
        rows = rows.groupBy("toxic", F.col(sketch).alias("same")).agg(F.min(F.struct("text", "a", "b", "c")).alias("r")).select("toxic", "r.*")
    return rows.select("toxic", "text")


def learn_lexicon(sample: DataFrame, *, significance: float = 25.0, purity: float = 0.95, max_entries: int = 2000) -> dict[str, float]:
    """Words and stems that are significantly and almost purely toxic, with their log odds."""
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return {}
    rate = toxic / (toxic + clean)
    counts = sample.mapInArrow(_term_rows, "term string, toxic int").groupBy("term").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    share = F.col("t") / (F.col("t") + F.col("c"))
    gain = 2 * (F.col("t") * F.log(share / F.lit(rate)) + F.when(F.col("c") > 0, F.col("c") * F.log((1 - share) / F.lit(1 - rate))).otherwise(0.0))
    # Balanced for class sizes, so that purity means the same at any ratio of labels.
    pure = (F.col("t") / F.lit(toxic)) / (F.col("t") / F.lit(toxic) + F.col("c") / F.lit(clean))
    rows = counts.where((F.col("t") >= 4) & (share > rate) & (pure >= purity)).where(gain >= significance).collect()
    found = {r["term"]: r["t"] for r in rows}
    odds = {r["term"]: math.log((r["t"] + 0.5) / (toxic + 1) * (clean + 1) / (r["c"] + 0.5)) for r in rows}
    chosen: dict[str, float] = {}
    names = sorted(found)
    for term in sorted(found, key=lambda x: (len(x.strip()), x)):
        # A chosen stem covers all that begins with it, a chosen word itself.
        if any(term[:n] in chosen for n in range(2, len(term) + 1)):
            continue
        # The most specific entry that still has nearly all of the stem's texts.
        longer = [x for x in names[bisect_left(names, term) : bisect_right(names, term + chr(0x10FFFF))] if found[x] >= 0.9 * found[term]]
        best = max(longer, key=lambda x: (len(x), x))
        chosen[best] = odds[best]
    return dict(sorted(chosen.items(), key=lambda x: (-x[1], x[0]))[:max_entries])


def _hit_rows(entries: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Lexicon(entries).automaton()
        for batch in batches:
            phrases = []
            for text in batch.column(1).to_pylist():
                folded = fold(text)
                around: Counter = Counter()
                for start, end, _ in hits(folded, automaton):
                    word_end = folded.index(" ", max(end - 1, start + 1))
                    next_end = folded.find(" ", word_end + 1)
                    last = folded.rfind(" ", 0, start) if start else -1
                    if next_end > 0:
                        around[folded[start + 1 : next_end]] += 1
                    if last >= 0:
                        around[folded[last + 1 : word_end]] += 1
                phrases.append(sorted(around))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(phrases, pa.list_(pa.string()))], names=["toxic", "phrases"])

    return run


def learn_exceptions(sample: DataFrame, entries: dict[str, float], least: int = 3) -> tuple[str, ...]:
    """Two-word phrases around hits that several clean texts have and no toxic one."""
    phrases = sample.mapInArrow(_hit_rows(entries), "toxic int, phrases array<string>").select("toxic", F.explode("phrases").alias("p"))
    rows = phrases.groupBy("p").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).where((F.col("t") == 0) & (F.col("c") >= least)).collect()
    return tuple(sorted(r["p"] for r in rows))


def _weights(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            found = [weigh(t.as_py(), automaton) for t in batch.column(1)]
            scores = [probability(w, n, lexicon.logistic) for w, _, n in found]
            columns = [batch.column(0), pa.array([w for w, _, _ in found], pa.float64()), pa.array([h for _, h, _ in found], pa.int64()), pa.array([n for _, _, n in found], pa.int64()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "weight", "n_hits", "n_words", "score"])

    return run


def fit_logistic(weights: np.ndarray, words: np.ndarray, toxic: np.ndarray, l2: float = 1e-3, rounds: int = 50) -> tuple[float, float, float]:
    """Newton's method on the two inputs; classes count alike."""
    x = np.array([(1.0, *_inputs(w, n)) for w, n in zip(weights, words, strict=True)])
    share = np.where(toxic == 1, 0.5 / max(1, toxic.sum()), 0.5 / max(1, (1 - toxic).sum()))
    beta = np.zeros(3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -60, 60)))
        gradient = x.T @ (share * (p - toxic)) + l2 * beta
        hessian = (x * (share * p * (1 - p))[:, None]).T @ x + l2 * np.eye(3)
        beta -= np.linalg.solve(hessian, gradient)
    return tuple(float(b) for b in beta)


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample_toxic: int = 3000, sample_clean: int = 6000, max_entries: int = 2000) -> Lexicon:
    """A lexicon with its exceptions and score from the labelled rows given."""
    sample = training_sample(docs, labels, id_col=id_col, text_col=text_col, sample_toxic=sample_toxic, sample_clean=sample_clean).cache()
    try:
        entries = learn_lexicon(sample, max_entries=max_entries)
        if not entries:
            return Lexicon()
        lexicon = Lexicon(entries, tuple(sorted({*EXCEPTIONS, *learn_exceptions(sample, entries)})))
        rows = sample.select(F.col("toxic").cast("long").alias("id"), "text").mapInArrow(_weights(lexicon), "id long, weight double, n_hits long, n_words long, score double").select("id", "weight", "n_words").collect()
        rows.sort()
        lexicon.logistic = fit_logistic(*(np.array([r[i] for r in rows], float) for i in (1, 2, 0)))
        return lexicon
    finally:
        sample.unpersist()


def score(docs: DataFrame, lexicon: Lexicon, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """Per row: the id, ``score`` (0 to 1), ``predicted``, and what the lexicon found."""
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_weights(lexicon), f"id {id_type(docs, id_col)}, weight double, n_hits long, n_words long, score double")
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "weight", "n_hits", "n_words")


def held_out(column: str, parts: int, out: int):
    """Whether crc32 of the id as text leaves the remainder ``out`` in ``parts``."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % parts == out, F.lit(False))


def contract(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from labelled rows that are not held out, then score every document."""
    lexicon = learn(docs, labels.where(~held_out("doc_id", 3, 1)))
    return score(docs, lexicon).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted", "n_hits")
