"""Benchmark decontamination by latent semantic retrieval, with sequence and answer checks.

1. Every document becomes the numbers of its words in the benchmark's vocabulary, once, in the shared
   folder. Passage frequencies of all documents give the weights of the words.
2. Passages of all documents, together as heavy as ``mass`` passages if there are more, and all benchmark items, these
   ``item_weight`` times as heavy as a passage of that mass, are TF-IDF vectors; words are
   hashed to at most ``max_terms`` columns. A distributed randomised SVD of that matrix (Halko,
   Martinsson and Tropp 2011) gives the latent basis: each partition multiplies its rows with the
   current basis and sends one dense sketch, partial sums meet in a tree.
3. Retrieval: every document, whole, is a run of windows of as many segments of ``SEGMENT`` words as
   each item is long, one window from every ``STRIDE``-th segment on. Windows are projected by sums
   over their segments, in each of which a word counts once, and all items with a cosine of ``cosine`` or more
   are candidates, however many. A lower rank only brings more candidates.
4. Candidates are verified on the words: the longest common subsequence of window and item must
   cover ``verbatim`` of the item, or ``paraphrase`` of it while the item's answer, its last words,
   stands there together.

Items of fewer than ``least_words`` words have no vector worth the name: they are found exactly, as a
whole phrase. Scripts without blanks are cut into characters. The broadcast model is bounded by
``max_terms * rank`` numbers and ``max_items`` items; a larger benchmark is searched in parts.

Defined results: null or empty texts contain nothing; items of fewer than ``least_phrase`` words
(nulls and empty ones included) cannot be told from chance and are left out; repeated documents each
give their rows, repeated items count by id; documents without an id give rows without an id; empty
tables give an empty result; only id and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.llm.rows import id_type, row_key, without
from factgraph.runtime import materialise

#: Words of a passage and of a segment; a window begins at every so many-th segment.
PASSAGE, SEGMENT, STRIDE = 48, 8, 2
#: So many words on both sides of a window are read with it when it is verified.
MARGIN = SEGMENT
#: ASCII other than letters and digits parts words.
_TABLE = bytes(c if chr(c).isalnum() else 32 for c in range(128)) + bytes(range(128, 256))
#: Thai, Lao, Khmer, Myanmar, kana and Han: scripts that put no blanks between words.
_UNSPACED = re.compile("([฀-໿က-႟ក-៿぀-ヿ㐀-鿿\U00020000-\U0003ffff])")


def _line(text: str | None) -> bytes:
    if not text:
        return b""
    line = text.lower().encode()
    # Those scripts need three bytes or more a character, with a first byte that no others have.
    if not line.isascii() and (np.frombuffer(line, np.uint8) >= 0xE0).any():
        line = _UNSPACED.sub(r" \1 ", line.decode()).encode()
    return line.translate(_TABLE)


def words_of(text: str | None) -> list[bytes]:
    return _line(text).split()


@dataclass
class Items:
    """The benchmark: ids and words as numbers; the words' numbers, and how many columns they are hashed to."""

    ids: list
    codes: list[np.ndarray]
    terms: dict[bytes, int]
    n_columns: int

    @classmethod
    def read(cls, benchmark: DataFrame, id_col: str, text_col: str, least_phrase: int, max_terms: int) -> Items:
        rows = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null").distinct().collect()
        found = sorted(((r["id"], w) for r in rows if len(w := words_of(r["text"])) >= least_phrase), key=lambda x: (x[0], x[1]))
        names = sorted({w for _, ws in found for w in ws})
        terms = {w: k for k, w in enumerate(names)}
        return cls([i for i, _ in found], [np.array([terms[w] for w in ws], np.int64) for _, ws in found], terms, min(len(names), max_terms))

    def many(self, lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all words of many lines (-1: not in the benchmark), and where each line begins."""
        split = pc.ascii_split_whitespace(pa.array(lines, pa.large_binary()).cast(pa.large_string()))
        words = split.flatten()
        place = pc.index_in(words, value_set=pa.array(list(self.terms), pa.large_binary()).cast(pa.large_string()))
        codes = place.fill_null(-1).to_numpy(zero_copy_only=False)
        filled = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
        sizes = np.bincount(split.value_parent_indices().to_numpy()[filled], minlength=len(lines))
        return codes[filled], np.concatenate(([0], np.cumsum(sizes)))


def _encode(items: Items, most: int = 8 << 20):
    """Documents as compressed word numbers, about ``most`` bytes of text at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                lines, held, begin = [], 0, at
                while at < batch.num_rows and held < most:
                    lines.append(_line(batch.column(2)[at].as_py()))
                    held += len(lines[-1])
                    at += 1
                codes, starts = items.many(lines)
                packed = [pack(codes[a:b].astype("<i4").tobytes()) for a, b in zip(starts[:-1], starts[1:], strict=True)]
                part = batch.slice(begin, at - begin)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(starts), pa.int64()), pa.array(packed, pa.binary())], names=["id", "row", "n", "codes"])

    return run


def encoded(docs: DataFrame, items: Items, *, id_col: str, text_col: str) -> DataFrame:
    """(id, row, n, codes) of every document, in the shared folder."""
    rows = docs.select(F.col(id_col).alias("id"), row_key(docs).alias("row"), F.col(text_col).alias("text"))
    return materialise(rows.mapInArrow(_encode(items), f"id {id_type(docs, id_col)}, row long, n long, codes binary"))


def _blocks(batches: Iterator[pa.RecordBatch], most: int = 300_000) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of (..., n, codes) with their word numbers and where each row's begin, about ``most`` words at a time."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        sizes = batch.column(batch.num_columns - 2).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            base = ends[at] - sizes[at]
            stop = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
            part = batch.slice(at, stop - at)
            found = [np.frombuffer(unpack(c.as_py(), max_output_size=4 * int(n) + 1), "<i4") for c, n in zip(part.column(batch.num_columns - 1), sizes[at:stop], strict=True)]
            yield part, np.concatenate(found).astype(np.int64), np.concatenate(([0], np.cumsum(sizes[at:stop])))
            at = stop


def distinct(keys: np.ndarray) -> np.ndarray:
    """The different numbers, in order."""
    keys = np.sort(keys)
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


def _array_row(data: np.ndarray, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([data.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["data", "total"])


def _passages(codes: np.ndarray, starts: np.ndarray, v: int) -> tuple[np.ndarray, int]:
    """The sorted keys (passage times ``v`` plus word) of all known words, repeats included, and how many passages there are."""
    sizes = np.diff(starts)
    per_line = -(-sizes // PASSAGE)
    first = np.cumsum(per_line) - per_line
    passage = np.repeat(first, sizes) + (np.arange(len(codes)) - np.repeat(starts[:-1], sizes)) // PASSAGE
    known = codes >= 0
    return np.sort(passage[known] * v + codes[known]), int(per_line.sum())


def _frequencies(items: Items):
    """How many passages hold each word, and how many passages there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, passages, v = np.zeros(len(items.terms), np.int64), 0, len(items.terms)
        for _, codes, starts in _blocks(batches):
            keys, n = _passages(codes, starts, v)
            counts += np.bincount(distinct(keys) % v, minlength=v)
            passages += n
        yield _array_row(counts, passages)

    return run


def _vector(codes: np.ndarray, idf: np.ndarray, n_columns: int) -> tuple[np.ndarray, np.ndarray]:
    """The unit TF-IDF vector of a passage, sparse: (columns, values)."""
    terms, counts = np.unique(codes[codes >= 0], return_counts=True)
    values = np.sqrt(counts) * idf[terms]
    return terms % n_columns, values / max(float(np.linalg.norm(values)), 1e-12)


def _edges(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal numbers begins."""
    return np.flatnonzero(np.diff(sorted_keys, prepend=-1))


def _run_sums(rows: np.ndarray, at: np.ndarray, most: int = 32) -> np.ndarray:
    """The sum of each run of rows that begins at ``at``: the j-th rows of all runs at once, what long runs have beyond ``most`` apart."""
    sizes = np.diff(np.append(at, len(rows)))
    order = np.argsort(-sizes, kind="stable")
    at, sizes = at[order], sizes[order]
    dense = np.zeros((len(at), rows.shape[1]), rows.dtype)
    for j in range(min(most, int(sizes.max(initial=0)))):
        n = int(np.searchsorted(-sizes, -j, "left"))
        dense[:n] += rows.take(at[:n] + j, axis=0)
    for k in range(int(np.searchsorted(-sizes, -most, "left"))):
        dense[k] += rows[at[k] + most : at[k] + sizes[k]].sum(axis=0)
    out = np.empty_like(dense)
    out[order] = dense
    return out


def _vectors(codes: np.ndarray, starts: np.ndarray, idf: np.ndarray, n_columns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The unit TF-IDF vectors (``_vector``) of all passages, sparse: (passage, column, value), by passage."""
    keys, n = _passages(codes, starts, len(idf))
    at = _edges(keys)
    passage, terms = np.divmod(keys[at], len(idf))
    values = np.sqrt(np.diff(np.append(at, len(keys)))) * idf[terms]
    norms = np.sqrt(np.bincount(passage, values * values, minlength=n))
    return passage, terms % n_columns, values / np.maximum(norms[passage], 1e-12)


def _sketch(items: Items, idf: np.ndarray, basis: np.ndarray):
    """The sum, over all passages, of their vector times its projection."""
    small = basis.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(basis.shape, np.float64)
        for _, codes, starts in _blocks(batches, 50_000):
            passage, column, value = _vectors(codes, starts, idf, items.n_columns)
            if not len(passage):
                continue
            value = value.astype(np.float32)[:, None]
            at = _edges(passage)
            row = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(passage))))
            projected = _run_sums(small.take(column, axis=0) * value, at)
            order = np.argsort(column, kind="stable")
            at = _edges(column[order])
            total[column[order[at]]] += _run_sums(projected.take(row[order], axis=0) * value[order], at)
        yield _array_row(total, 1)

    return run


def _fold(dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for batch in batches:
            for data, k in zip(batch.column(0), batch.column(1), strict=True):
                part = np.frombuffer(data.as_py(), dtype)
                total, n = part.copy() if total is None else total + part, n + k.as_py()
        if total is not None:
            yield _array_row(total, n)

    return run


def _tree_sum(parts: DataFrame, dtype, shape: tuple[int, ...], fan_in: int = 16) -> tuple[np.ndarray, int]:
    """The sum of one array per partition, folded ``fan_in`` at a time on the executors; the driver gets one.

    Every fold is a shuffle of its own, so the pass that makes the arrays keeps all of its tasks.
    """
    n = parts.rdd.getNumPartitions()
    while n > 1:
        n = -(-n // fan_in)
        parts = parts.repartition(n).mapInArrow(_fold(dtype), "data binary, total long")
    total, count = np.zeros(int(np.prod(shape)), dtype), 0
    for row in parts.collect():
        total, count = total + np.frombuffer(row["data"], dtype), count + row["total"]
    return total.reshape(shape), count


@dataclass
class Model:
    items: Items
    #: Of each word number, its weight times its row of the basis.
    basis: np.ndarray
    #: Of each item, its unit vector.
    latent: np.ndarray
    #: Items by the number of segments of their windows.
    classes: dict[int, np.ndarray]
    #: Items that are found as whole phrases, by their number of words.
    phrases: dict[int, list[int]]
    cosine: float
    verbatim: float
    paraphrase: float
    answer: int
    masks: dict[int, tuple[dict[int, int], dict[int, int]]] = field(default_factory=dict)
    #: Whether an item has a word, as one table of bits, or as sorted numbers if that would be large.
    table: np.ndarray | None = None
    pairs: np.ndarray | None = None

    def holds(self, item: np.ndarray, codes: np.ndarray) -> np.ndarray:
        n, v = len(self.items.codes), len(self.items.terms)
        if self.pairs is None:
            self.pairs = np.unique(np.concatenate([i * (v + 1) + c for i, c in enumerate(self.items.codes)]))
            if n * (v + 1) <= 1 << 26:
                self.table = np.zeros(n * (v + 1), bool)
                self.table[self.pairs] = True
        # An unknown word has the number -1, and so the last place of an item's row, which no word has.
        keys = item * (v + 1) + np.where(codes < 0, v, codes)
        if self.table is not None:
            return self.table[keys]
        return self.pairs[np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)] == keys

    def masks_of(self, item: int) -> tuple[dict[int, int], dict[int, int]]:
        """Per word the bits of its places, in the item and in its answer."""
        if item not in self.masks:
            codes = self.items.codes[item].tolist()
            self.masks[item] = tuple(place_bits(c) for c in (codes, codes[-self.answer :]))
        return self.masks[item]


def fit(codes: DataFrame, items: Items, *, rank: int, power: int, mass: int, item_weight: float, least_words: int, seed: int, **checks) -> Model:
    """The latent model of encoded documents and the items."""
    v = len(items.terms)
    df, passages = _tree_sum(codes.select("n", "codes").mapInArrow(_frequencies(items), "data binary, total long"), np.int64, (v,))
    idf = np.log((passages + len(items.ids) + 1.0) / (df + 1.0))
    own = [_vector(c, idf, items.n_columns) for c in items.codes]
    rank = min(rank, items.n_columns)
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(items.n_columns, rank)))[0]
    for _ in range(power + 1):
        sketch, _ = _tree_sum(codes.select("n", "codes").mapInArrow(_sketch(items, idf, basis), "data binary, total long"), np.float64, basis.shape)
        sketch *= min(1.0, mass / max(1, passages))
        for t, x in own:
            np.add.at(sketch, t, item_weight**2 * np.outer(x, x @ basis[t]))
        basis = np.linalg.qr(sketch)[0]
    latent = np.array([x @ basis[t] for t, x in own])
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
    words = (basis[np.arange(v) % items.n_columns] * idf[:, None]).astype(np.float32)
    sizes = np.array([len(c) for c in items.codes])
    # A window is about as long as its item.
    segments = -(-(sizes + SEGMENT // 2) // SEGMENT)
    classes = {int(k): np.flatnonzero((segments == k) & (sizes >= least_words)) for k in np.unique(segments[sizes >= least_words])}
    phrases = {int(n): np.flatnonzero(sizes == n).tolist() for n in np.unique(sizes[sizes < least_words])}
    return Model(items, words, latent.astype(np.float32), classes, phrases, **checks)


def place_bits(codes: list[int]) -> dict[int, int]:
    bits: dict[int, int] = {}
    for i, c in enumerate(codes):
        bits[c] = bits.get(c, 0) | 1 << i
    return bits


def common_subsequence(bits: dict[int, int], size: int, window: list[int]) -> int:
    """Length of the longest common subsequence of a window and ``size`` words with these bits, bit-parallel (Hyyro 2004)."""
    full = (1 << size) - 1
    row = full
    for w in window:
        if m := bits.get(w):
            u = row & m
            row = ((row + u) | (row - u)) & full
    return size - row.bit_count()


def candidates(codes: np.ndarray, starts: np.ndarray, model: Model) -> tuple[np.ndarray, ...]:
    """(line, first word, number of words, item, cosine) of every window and item that are close in the latent space."""
    v, sizes = len(model.items.terms), np.diff(starts)
    most = max(model.classes, default=0)
    none = np.zeros(0, np.int64)
    if not most:
        return none, none, none, none, np.zeros(0)
    # Each line's segments, and empty ones behind them, so that no window reaches into the next line.
    per_line = -(-sizes // SEGMENT) + most - 1
    per_line += per_line % STRIDE
    first = np.cumsum(per_line) - per_line
    segment = np.repeat(first, sizes) + (np.arange(len(codes)) - np.repeat(starts[:-1], sizes)) // SEGMENT
    known = codes >= 0
    keys = distinct(segment[known] * v + codes[known])
    at, terms = keys // v, keys % v
    vectors = np.zeros((int(per_line.sum()) + most, model.basis.shape[1]), np.float32)
    # The j-th different word of every segment that has so many, for one j after another: those with the most words first.
    edges = np.flatnonzero(np.diff(at, prepend=-1))
    counts = np.diff(np.append(edges, len(at)))
    order = np.argsort(-counts, kind="stable")
    edges, counts = edges[order], counts[order]
    dense = np.zeros((len(edges), vectors.shape[1]), np.float32)
    for j in range(SEGMENT):
        n = int(np.searchsorted(-counts, -j, "left"))
        dense[:n] += model.basis.take(terms[edges[:n] + j], axis=0)
    vectors[at[edges]] = dense
    rows = int(per_line.sum()) // STRIDE
    windows, found = np.zeros((rows, vectors.shape[1]), np.float32), []
    for k in range(1, most + 1):
        windows += vectors[k - 1 : k - 1 + rows * STRIDE : STRIDE]
        if k in model.classes:
            items = model.classes[k]
            norms = np.sqrt(np.einsum("ij,ij->i", windows, windows))
            close = windows @ model.latent[items].T
            hits = np.flatnonzero((close >= np.maximum(model.cosine * norms, 1e-6)[:, None]).ravel())
            at, which = hits // len(items), hits % len(items)
            found.append((at * STRIDE, np.full(len(at), k), items[which], close[at, which] / norms[at]))
    at, k, item, cosine = (np.concatenate(x) for x in zip(*found, strict=True))
    line = np.searchsorted(first, at, "right") - 1
    begin, length = (at - first[line]) * SEGMENT, k * SEGMENT
    able = enough(codes, starts, line, begin, length, item, model)
    return line[able], begin[able], length[able], item[able], cosine[able]


def enough(codes: np.ndarray, starts: np.ndarray, line: np.ndarray, begin: np.ndarray, length: np.ndarray, item: np.ndarray, model: Model) -> np.ndarray:
    """Whether a window, as ``verify`` reads it, holds as many of the item's words as the least share needs, in any order."""
    a = starts[line] + np.maximum(0, begin - MARGIN)
    b = np.minimum(starts[line + 1], starts[line] + begin + length + MARGIN)
    sizes = np.array([len(c) for c in model.items.codes])
    held = np.zeros(len(a), np.int64)
    for j in range(int((b - a).max()) if len(a) else 0):
        inside = np.flatnonzero(a + j < b)
        held[inside] += model.holds(item[inside], codes[a[inside] + j])
    return held >= np.ceil(model.paraphrase * sizes[item] - 1e-9)


def answered(bits: dict[int, int], size: int, words: list[int]) -> bool:
    """Whether three quarters of the answer stand in order within twice its length."""
    need = -(-3 * size // 4)
    return any(common_subsequence(bits, size, words[i : i + 2 * size]) >= need for i in range(0, max(1, len(words) - size), max(1, size // 2)))


def verify(words: list[int], windows: list[tuple[int, int, float]], item: int, model: Model) -> tuple[float, float, bool, int] | None:
    """(cosine, share of the item, answer found, word offset) of the best window that passes; None if none does.

    A window is (first word, number of words, cosine); it is read with ``MARGIN`` words more on both sides.
    """
    bits, tail = model.masks_of(item)
    size, best = len(model.items.codes[item]), None
    for begin, length, cosine in windows:
        a = max(0, begin - MARGIN)
        part = words[a : begin + length + MARGIN]
        share = common_subsequence(bits, size, part) / size
        if share < model.paraphrase or best and share <= best[1]:
            continue
        told = answered(tail, min(size, model.answer), part)
        if share >= model.verbatim or told:
            best = (cosine, share, told, a)
        if share == 1:
            break
    return best


def phrases(codes: np.ndarray, starts: np.ndarray, model: Model) -> Iterator[tuple[int, int, int]]:
    """(line, item, word offset) of the first place where a line holds a short item, word for word."""
    for n, items in model.phrases.items():
        if len(codes) < n:
            continue
        every = np.lib.stride_tricks.sliding_window_view(codes, n)
        begins = np.isin(codes[: len(codes) - n + 1], [model.items.codes[i][0] for i in items])
        spots = np.flatnonzero(begins)
        line = np.searchsorted(starts, spots, "right") - 1
        spots, line = spots[whole := spots + n <= starts[line + 1]], line[whole]
        wanted: dict[tuple[int, ...], list[int]] = {}
        for i in items:
            wanted.setdefault(tuple(model.items.codes[i].tolist()), []).append(i)
        seen = set()
        for at, row, text in zip(spots.tolist(), line.tolist(), map(tuple, every[spots].tolist()), strict=True):
            for i in wanted.get(text, ()):
                if (row, i) not in seen:
                    seen.add((row, i))
                    yield row, i, at - int(starts[row])


def _search(model: Model, item_type: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, codes, starts in _blocks(batches):
            line, begin, length, item, cosine = candidates(codes, starts, model)
            rows = [(row, i, 1.0, 1.0, True, at) for row, i, at in phrases(codes, starts, model)]
            order = np.lexsort((-cosine, item, line))
            pairs = line[order] * len(model.items.ids) + item[order]
            edges = np.concatenate((np.flatnonzero(np.diff(pairs, prepend=-1)), [len(pairs)])) if len(pairs) else np.zeros(1, int)
            text_of, text = -1, []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                some = order[a:b]
                row, i = int(line[some[0]]), int(item[some[0]])
                if row != text_of:
                    text_of, text = row, codes[starts[row] : starts[row + 1]].tolist()
                hit = verify(text, list(zip(begin[some].tolist(), length[some].tolist(), cosine[some].tolist(), strict=True)), i, model)
                if hit:
                    rows.append((row, i, *hit))
            at = pa.array([r[0] for r in rows], pa.int64())
            columns = [part.column(0).take(at), part.column(1).take(at), pa.array([model.items.ids[r[1]] for r in rows], item_type)]
            columns += [pa.array([r[k] for r in rows], t) for k, t in ((2, pa.float64()), (3, pa.float64()), (4, pa.bool_()), (5, pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "row", "item", "cosine", "overlap", "answered", "word_offset"])

    return run


def found(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rank: int = 96, power: int = 1, mass: int = 16_000, item_weight: float = 6.0,
    least_words: int = 8, least_phrase: int = 3, max_items: int = 20_000, max_terms: int = 1 << 16, cosine: float = 0.6, verbatim: float = 0.8, paraphrase: float = 0.4, answer: int = 6, seed: int = 0,
) -> DataFrame:
    """(id, row, item, cosine, overlap, answered, word_offset): documents by id and ``row_key``, and the items that they contain."""
    from pyspark.sql.pandas.types import to_arrow_type

    item_field = benchmark.select(item_col).schema[0].dataType
    schema = f"id {id_type(docs, id_col)}, row long, item {item_field.simpleString()}, cosine double, overlap double, answered boolean, word_offset long"
    n_parts = -(-2 * benchmark.select(item_col).distinct().count() // max_items)
    parts = []
    for p in range(n_parts):
        some = benchmark if n_parts == 1 else benchmark.where(F.pmod(F.xxhash64(item_col), F.lit(n_parts)) == p)
        items = Items.read(some, item_col, item_text_col, least_phrase, max_terms)
        if items.ids:
            codes = encoded(docs, items, id_col=id_col, text_col=text_col)
            model = fit(codes, items, rank=rank, power=power, mass=mass, item_weight=item_weight, least_words=least_words, seed=seed, cosine=cosine, verbatim=verbatim, paraphrase=paraphrase, answer=answer)
            parts.append(codes.mapInArrow(_search(model, to_arrow_type(item_field)), schema))
    return reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", item_col: str = "item_id", **options) -> DataFrame:
    """One row per document and benchmark item that it contains: ids, cosine, share of the item, answer, word offset."""
    hits = found(docs, benchmark, id_col=id_col, item_col=item_col, **options)
    return hits.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "cosine", "overlap", "answered", "word_offset")


def clean(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents that contain no benchmark item, unchanged; each row is judged by its own text, whatever its id."""
    return without(docs, found(docs, benchmark, id_col=id_col, **options).select("id", "row"), id_col)
