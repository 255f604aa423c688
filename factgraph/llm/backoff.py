"""Stupid-backoff language-model scores from n-gram count tables partitioned by hash.

Counts cover the whole corpus, and each document is scored by what the *others* hold: its own
n-grams are taken off every count (leave one out), without which no document would ever back off.
The score of word i is count(n-gram) / count(context) if the n-gram occurs elsewhere, else ``alpha``
times the score of the next shorter n-gram; a word that occurs nowhere else counts as half a time.

The tables and the exploded n-grams are joined in blocks. Documents are dealt by hash into blocks of
about ``block_bytes``; a block sends each partition of the hash space its distinct n-grams with their
counts as one packed row, the partition sums what all blocks sent and answers each with the totals
in the same order, and the block looks its documents up. That is the join of the count table with
the exploded n-grams, reduced to the distinct n-grams of a block before anything is shuffled, so a
word that fills the corpus costs one entry a block. A relational join of one row per n-gram and
document would shuffle every n-gram of the corpus three times as a row of 16 bytes or more; here an
entry takes about six. How blocks and partitions grow with the corpus is said at ``layout``.

Words are split at ASCII white space, A-Z lower-cased; n-grams are known by 64-bit hashes.

Defined results: a null, empty or blank text has no words, log probability 0 and a null mean;
repeated rows are different documents with the same words, so they support each other; the only
document of a corpus finds nothing elsewhere and scores by the unseen-word rule; an empty table
gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.llm.rows import id_type

ORDER, ALPHA = 3, 0.4
_SPACE = bytes(c if not 65 <= c <= 90 else c + 32 for c in range(256))


def _mix(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A 64-bit hash of pairs of hashes."""
    x = left * np.uint64(0x9E3779B97F4A7C15) + right
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def grams(texts: list[str | None], order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Per n the hashes of the n-grams that end at each word (0 where there is none), and each word's text."""
    from xxhash import xxh64_intdigest

    lines = pa.array([(t or "").encode().translate(_SPACE) for t in texts], pa.large_binary()).cast(pa.large_string())
    split = pc.ascii_split_whitespace(lines)
    coded = split.flatten().dictionary_encode()
    table = np.array([xxh64_intdigest(w) or 1 for w in coded.dictionary.cast(pa.large_binary()).to_pylist()], np.uint64)
    empty = np.array(pc.equal(pc.binary_length(coded.dictionary), 0).to_numpy(zero_copy_only=False), bool)
    codes, owner = coded.indices.to_numpy(zero_copy_only=False), split.value_parent_indices().to_numpy()
    if empty.any():
        codes, owner = codes[~empty[codes]], owner[~empty[codes]]
    words = table[codes] if len(table) else np.zeros(0, np.uint64)
    out = [words]
    for n in range(2, order + 1):
        longer = np.zeros_like(words)
        if len(words) >= n:
            whole = owner[n - 1 :] == owner[: len(owner) - n + 1]
            longer[n - 1 :] = np.where(whole, _mix(out[-1][n - 2 : -1], words[n - 1 :]), 0)
        out.append(longer)
    return out, owner


def _pack(values: np.ndarray) -> bytes:
    """Unsigned integers, byte planes apart, compressed: the high planes of differences and counts are empty."""
    import zstandard

    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(data: bytes, n: int) -> np.ndarray:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data, max_output_size=max(1, 8 * n))
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view("<u8").reshape(-1)


def _distinct(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate(found)
    return np.unique(keys[keys != 0], return_counts=True)


def _requests(order: int, parts: int):
    width = (1 << 64) // parts + 1

    def run(table: pa.Table) -> pa.Table:
        found, _ = grams(_unpacked(table.column("text")), order)
        keys, counts = _distinct(found)
        # Every partition gets the number of words of the block, so that any of them knows the corpus size.
        cuts = np.searchsorted(keys, [np.uint64(p * width) for p in range(parts)]).tolist() + [len(keys)]
        block = table.column("block")[0].as_py() if table.num_rows else 0
        rows = [(p, block, b - a, len(found[0]), _pack(np.diff(keys[a:b], prepend=np.uint64(0))), _pack(counts[a:b])) for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
        return pa.table([pa.array(c) for c in zip(*rows, strict=True)], names=["part", "block", "n", "words", "grams", "counts"])

    return run


def _replies(table: pa.Table) -> pa.Table:
    """The totals of one hash partition, for each block in the order of its request."""
    sizes = table.column("n").to_pylist()
    keys = [np.cumsum(_unpack(g.as_py(), n), dtype=np.uint64) for g, n in zip(table.column("grams"), sizes, strict=True)]
    counts = [_unpack(c.as_py(), n) for c, n in zip(table.column("counts"), sizes, strict=True)]
    every, where = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.zeros(len(every), np.int64)
    np.add.at(totals, where, np.concatenate(counts).astype(np.int64))
    words = sum(table.column("words").to_pylist())
    answers = [_pack(totals[np.searchsorted(every, k)].astype(np.uint64)) for k in keys]
    return pa.table([table.column("part"), table.column("block"), table.column("n"), pa.array([words] * len(sizes), pa.int64()), pa.array(answers, pa.binary())], names=["part", "block", "n", "words", "totals"])


def _own(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each position, how often its n-gram occurs in its own document."""
    order = np.lexsort((keys, owner))
    k, o = keys[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (o[1:] != o[:-1])))) if len(k) else np.zeros(0, int)
    sizes = np.diff(np.concatenate((first, [len(k)])))
    out = np.empty(len(keys), np.int64)
    out[order] = np.repeat(sizes, sizes)
    return out


def _scores(order: int, alpha: float):
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        names = ["id", "n_words", "n_backoff", "logprob"]
        if not docs.num_rows:
            return pa.table([docs.column("id"), *[pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())]], names=names)
        found, owner = grams(_unpacked(docs.column("text")), order)
        keys, _ = _distinct(found)
        answers = sorted(zip(replies.column("part").to_pylist(), replies.column("n").to_pylist(), replies.column("totals").to_pylist(), replies.column("words").to_pylist(), strict=True))
        totals = np.concatenate([np.zeros(0, np.uint64), *[_unpack(t, n) for _, n, t, _ in answers]]).astype(np.int64)
        corpus = answers[0][3] if answers else 0
        n_docs = docs.num_rows
        length = np.bincount(owner, minlength=n_docs)
        rest = (corpus - length)[owner]
        # Counts elsewhere, by n; the empty context of a word is every other word.
        elsewhere = []
        for hashes in found:
            known = hashes != 0
            count = np.zeros(len(hashes), np.int64)
            count[known] = totals[np.searchsorted(keys, hashes[known])]
            elsewhere.append(np.where(known, count - _own(hashes, owner), 0))
        score = np.where(elsewhere[0] > 0, elsewhere[0], 0.5) / np.maximum(rest, 1)
        backed = np.zeros(len(score), bool)
        for n in range(2, order + 1):
            context = np.concatenate(([0], elsewhere[n - 2][:-1]))[: len(score)]
            possible, hit = found[n - 1] != 0, elsewhere[n - 1] > 0
            score = np.where(hit, elsewhere[n - 1] / np.maximum(context, 1), np.where(possible, alpha * score, score))
            backed = np.where(possible, ~hit, backed)
        logs = np.bincount(owner, np.log(score), n_docs) if len(score) else np.zeros(n_docs)
        return pa.table([docs.column("id"), pa.array(length, pa.int64()), pa.array(np.bincount(owner, backed, n_docs).astype(np.int64)), pa.array(logs, pa.float64())], names=names)

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed before they are dealt into blocks."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        texts = [pack((t.as_py() or "").encode()) for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.binary())], names=["id", "block", "text"])


def _unpacked(column: pa.ChunkedArray) -> list[str]:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    return [unpack(t.as_py()).decode() for t in column]


def layout(size: int, block_bytes: int, part_bytes: int, most_blocks: int = 1 << 14) -> tuple[int, int]:
    """How many blocks of documents and how many partitions of the hash space a corpus of ``size`` bytes gets.

    Every block sends every partition one row, as every task of a shuffle does. Above ``most_blocks``
    both grow with the square root of the corpus, so their product, the number of rows, stays in
    proportion to it; what a task holds then grows with the square root too.
    """
    blocks, parts = size // block_bytes + 1, size // part_bytes + 1
    if blocks > most_blocks:
        share = math.sqrt(most_blocks / blocks)
        blocks, parts = math.ceil(blocks * share), math.ceil(parts * share)
    return blocks, parts


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, alpha: float = ALPHA, block_bytes: int = 8 << 20, part_bytes: int = 10 << 20) -> DataFrame:
    """Per row: the id, ``n_words``, ``n_backoff`` (words whose longest n-gram occurs nowhere else), ``logprob`` and its mean."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    blocks, parts = layout(size, block_bytes, part_bytes)
    kind = id_type(docs, id_col)
    # Blocks have about block_bytes each; very long texts make a block longer by one text at most.
    block = F.pmod(F.xxhash64(id_col, F.octet_length(text_col), F.substring(text_col, 1, 64)), F.lit(blocks))
    rows = docs.select(F.col(id_col).alias("id"), block.alias("block"), F.col(text_col).alias("text")).mapInArrow(_packed, f"id {kind}, block long, text binary")
    asked = rows.groupBy("block").applyInArrow(_requests(order, parts), "part long, block long, n long, words long, grams binary, counts binary")
    told = asked.groupBy("part").applyInArrow(_replies, "part long, block long, n long, words long, totals binary")
    out = rows.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_scores(order, alpha), f"id {kind}, n_words long, n_backoff long, logprob double")
    return out.select(F.col("id").alias(id_col), "n_words", "n_backoff", F.round("logprob", 6).alias("logprob"), F.round(F.when(F.col("n_words") > 0, F.col("logprob") / F.col("n_words")), 6).alias("mean_logprob"))


#: Words that no trigram reaches, at the start of a text, back off from bigrams.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), p AS (
  SELECT doc_id, i, w[i] AS u, CASE WHEN i > 1 THEN w[i - 1] END AS c, CASE WHEN i > 2 THEN w[i - 2] END AS e FROM d, unnest(range(1, len(w) + 1)) AS r(i)
), n AS (SELECT count(*) AS n FROM p),
l AS (SELECT doc_id, len(w) AS len FROM d),
u AS (SELECT u, count(*) AS t FROM p GROUP BY u), ud AS (SELECT doc_id, u, count(*) AS t FROM p GROUP BY ALL),
b AS (SELECT c, u, count(*) AS t FROM p WHERE c IS NOT NULL GROUP BY ALL), bd AS (SELECT doc_id, c, u, count(*) AS t FROM p WHERE c IS NOT NULL GROUP BY ALL),
g AS (SELECT e, c, u, count(*) AS t FROM p WHERE e IS NOT NULL GROUP BY ALL), gd AS (SELECT doc_id, e, c, u, count(*) AS t FROM p WHERE e IS NOT NULL GROUP BY ALL),
x AS (
  SELECT p.doc_id, p.i, u.t - ud.t AS uni, coalesce(b.t - bd.t, 0) AS bi, coalesce(g.t - gd.t, 0) AS tri,
         coalesce(uc.t - ucd.t, 0) AS ctx, coalesce(bc.t - bcd.t, 0) AS ctx2, n.n - l.len AS rest
  FROM p JOIN u ON p.u = u.u JOIN ud ON p.doc_id = ud.doc_id AND p.u = ud.u
  LEFT JOIN b ON p.c = b.c AND p.u = b.u LEFT JOIN bd ON p.doc_id = bd.doc_id AND p.c = bd.c AND p.u = bd.u
  LEFT JOIN g ON p.e = g.e AND p.c = g.c AND p.u = g.u LEFT JOIN gd ON p.doc_id = gd.doc_id AND p.e = gd.e AND p.c = gd.c AND p.u = gd.u
  LEFT JOIN u AS uc ON p.c = uc.u LEFT JOIN ud AS ucd ON p.doc_id = ucd.doc_id AND p.c = ucd.u
  LEFT JOIN b AS bc ON p.e = bc.c AND p.c = bc.u LEFT JOIN bd AS bcd ON p.doc_id = bcd.doc_id AND p.e = bcd.c AND p.c = bcd.u
  JOIN l ON p.doc_id = l.doc_id, n
), s AS (
  SELECT doc_id, count(*) AS n_words, sum((CASE WHEN i > 2 THEN tri = 0 WHEN i = 2 THEN bi = 0 ELSE false END)::BIGINT)::BIGINT AS n_backoff,
         sum(ln(CASE WHEN tri > 0 THEN tri::DOUBLE / ctx2 ELSE (CASE WHEN i > 2 THEN 0.4::DOUBLE ELSE 1 END)
           * CASE WHEN bi > 0 THEN bi::DOUBLE / ctx ELSE (CASE WHEN i > 1 THEN 0.4::DOUBLE ELSE 1 END) * (CASE WHEN uni > 0 THEN uni::DOUBLE ELSE 0.5 END) / greatest(rest, 1) END END)) AS lp
  FROM x GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_backoff, 0)::BIGINT AS n_backoff,
       round(coalesce(lp, 0), 6) AS logprob, round(lp / n_words, 6) AS mean_logprob
FROM d LEFT JOIN s ON d.doc_id = s.doc_id
"""
