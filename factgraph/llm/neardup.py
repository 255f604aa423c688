"""Near-duplicate groups by shingle similarity, found by SimHash with multi-index hashing and verified exactly.

A text is the set of its five-word shingles (A-Z lower-cased, words split at ASCII white space,
XXH64 each). Two texts are near copies if the Jaccard similarity of their sets is at least 0.8, and
a group is whatever such pairs connect.

Candidates come from SimHash fingerprints of ``64 * WORDS`` bits. 64 bits cannot tell similarity 0.8
(9.7 bits apart on average, up to 19) from chance without balls of thousands of keys; a long
fingerprint can, since a bit of it differs with a probability of 0.15 at similarity 0.8 whatever its
length, and of 0.5 by chance. The fingerprint is cut into ``SEGMENTS`` segments of ``SEGMENT`` bits,
and two fingerprints meet where a segment agrees: a pair at 0.8 agrees on none with a probability of
(1 - 0.8485**14)**146 = 2e-7 (2e-6 for the worst sizes from five shingles on, 3e-4 for four of five
shingles), a closer pair with less. Those that meet are linked if the first ``CHECKED`` words differ in
at most ``DISTANCE`` bits (of 192, a pair at 0.8 differs in 29 on average, two unrelated texts in 96). Distinct fingerprints only
take part, and copies join by equality. Within a segment's key links are a spanning forest, not all
pairs, and what a batch of keys connects is sent as links of each fingerprint to the smallest one that
it reaches there. All segments find the same group again, each by links of its own, so the first
``FEW`` go ahead: the others send links between what these have not connected. Components of links
are clusters of candidates. Each cluster's sets then meet in one task,
once, where exact similarities are walked breadth first against the texts that no walk has reached
yet. A cluster is held in memory by that task. Comparisons grow with the square of the distinct texts, divided
by 2**SEGMENT.

Defined results: null, empty or blank texts have the empty set and are copies of each other; texts
of fewer than five words have one shingle, the whole sequence; repeated rows get one row each; an
empty table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.llm import simhash
from factgraph.llm.components import components
from factgraph.llm.rows import id_type
from factgraph.runtime import materialise

SHINGLE, SEED = 5, 42
#: Similarity of at least NUMERATOR / DENOMINATOR.
NUMERATOR, DENOMINATOR = 4, 5
#: 64-bit words of a fingerprint; bits of a segment; segments.
WORDS, SEGMENT, SEGMENTS = 32, 14, 146
#: Two fingerprints that meet are linked if so many words differ in at most so many bits, the first word in no more than ``FIRST``.
CHECKED, DISTANCE, FIRST = 3, 60, 28
#: So many segments are linked before the others.
FEW = 12
#: Runs of one key beyond this size are walked breadth first.
LARGE_RUN = 4096
_SLICE = 256
#: A sum of so many bits fits a byte.
_BLOCK = 255


def shingles(text: str | None, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The sorted different shingle hashes of a whole text."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) < size:
        return np.array([xxh64_intdigest(line, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    pairs = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.unique(np.fromiter((xxh64_intdigest(line[a:b], seed) for a, b in pairs), np.uint64, len(words) - size + 1))


def _words(hashes: np.ndarray) -> np.ndarray:
    """``WORDS`` words of each shingle, a row of them: XXH64 continued by SplitMix64."""
    z = hashes[:, None] + np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return z ^ z >> np.uint64(31)


def fingerprint(found: np.ndarray) -> np.ndarray:
    """The SimHash of a set of shingles in words: a bit is that of most shingles.

    If they are even, a word has the bits of the shingle whose word before it is the smallest.
    """
    counts, turn = np.zeros(64 * WORDS, np.int64), np.arange(WORDS)
    low, ties = np.full(WORDS, np.iinfo(np.uint64).max, np.uint64), np.zeros(WORDS, np.uint64)
    for at in range(0, len(found), _BLOCK):
        z = _words(found[at : at + _BLOCK])
        counts += np.unpackbits(z.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
        if len(found) % 2 == 0:
            place = z.argmin(axis=0)
            less = z[place, turn] < low
            low = np.where(less, z[place, turn], low)
            ties = np.where(less, z[place, (turn + 1) % WORDS], ties)
    even = np.unpackbits(np.roll(ties, 1).view(np.uint8), bitorder="little")
    return np.packbits(2 * counts + even > len(found), bitorder="little").view(np.uint64)


def _node(words: np.ndarray) -> np.ndarray:
    """The names of fingerprints, signed longs, from their checked words (one column each)."""
    out = np.zeros(words.shape[1], np.uint64)
    for word in words:
        out = (out ^ word) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out.view(np.int64)


def _name(found: np.ndarray) -> int:
    """A set's name, a signed long; 0 for the empty set."""
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(found.tobytes())).astype(np.int64)) if len(found) else 0


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, _SLICE):
            batch = whole.slice(at, _SLICE)
            sets = [shingles(text.as_py()) for text in batch.column(2)]
            prints = np.array([fingerprint(found) for found in sets], np.uint64)
            columns = [batch.column(0), batch.column(1), pa.array([_name(found) for found in sets], pa.int64())]
            columns += [pa.array(_node(prints[:, :CHECKED].T)), pa.array([row.tobytes() for row in prints], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "row", "fp", "node", "print"])


def _segments(batches: Iterator[pa.RecordBatch], first: int = 0, last: int = SEGMENTS) -> Iterator[pa.RecordBatch]:
    """One row per segment of each (node, print) or (node, print, root): its number and bits as the key, the checked words, the root."""
    numbers = np.arange(first, last, dtype=np.int32) << SEGMENT
    for whole in batches:
        for at in range(0, whole.num_rows, _SLICE):
            prints = np.frombuffer(b"".join(whole.column(1).slice(at, _SLICE).to_pylist()), np.uint64).reshape(-1, WORDS)
            bits = np.unpackbits(prints.view(np.uint8), axis=1, bitorder="little")[:, SEGMENT * first : SEGMENT * last].reshape(len(prints), last - first, SEGMENT)
            keys = np.broadcast_to(numbers, (len(prints), last - first)).copy()
            for j in range(SEGMENT):
                keys |= bits[:, :, j].astype(np.int32) << j
            names = {f"w{j}": prints[:, j].view(np.int64) for j in range(CHECKED)}
            if whole.num_columns > 2:
                names["root"] = whole.column(2).slice(at, _SLICE).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *(pa.array(np.repeat(x, last - first)) for x in names.values())], names=["key", *names])


def _close(words: np.ndarray, i, j) -> np.ndarray:
    return np.bitwise_count(words[:, i] ^ words[:, j]).sum(axis=0) <= DISTANCE


def _walk(words: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the close fingerprints of one large run, breadth first."""
    left, out = np.arange(words.shape[1]), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = _close(words, [at], left)
            hits = left[near].tolist()
            if hits:
                left = left[~near]
                queue += hits
                out += [(at, hit) for hit in hits]
    return out


def linked(keys: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Pairs of places (two columns) that connect what all close pairs under a common key connect; sorted by key."""
    edges = np.flatnonzero(np.diff(keys)) + 1
    starts = np.concatenate(([0], edges))
    sizes = np.diff(np.append(starts, len(keys)))
    out = [(start + i, start + j) for start, size in zip(starts[sizes > LARGE_RUN].tolist(), sizes[sizes > LARGE_RUN].tolist(), strict=True) for i, j in _walk(words[:, start : start + size])]
    size_of = np.repeat(sizes, sizes)
    at = np.flatnonzero((size_of > 1) & (size_of <= LARGE_RUN))
    # Trees of what is linked already; the rows of all runs are compared with those ``step`` places on at once.
    tree = np.arange(len(keys))
    first, most, step = words[0, at], int(size_of[at].max(initial=1)), 1
    while step < most:
        if not step & (step - 1):
            # The rows of runs that are still longer, side by side.
            at = at[size_of[at] > step]
            first = words[0, at]
        hits = np.flatnonzero(np.bitwise_count(first[step:] ^ first[:-step]) <= FIRST)
        i, j = at[hits], at[hits + step]
        new = (keys[i] == keys[j]) & (tree[i] != tree[j])
        i, j = i[new], j[new]
        close = _close(words, i, j)
        for a, b in zip(i[close].tolist(), j[close].tolist(), strict=True):
            top, other = a, b
            while tree[top] != top:
                top = int(tree[top])
            while tree[other] != other:
                other = int(tree[other])
            if top != other:
                tree[max(top, other)] = min(top, other)
                out.append((a, b))
        if close.any():
            while (tree[tree] != tree).any():
                tree = tree[tree]
        step += 1
    return np.array(out, np.int64).reshape(-1, 2)


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the edges (u, v) the components, as edges from the smallest node of each to all of its others."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    low = np.arange(len(nodes))
    while (low[a] != low[b]).any():
        # The tops of trees that an edge connects: the larger one goes below the smaller one.
        one, other = low[a], low[b]
        np.minimum.at(low, one, other)
        np.minimum.at(low, other, one)
        while (low[low] != low).any():
            low = low[low]
    others = low != np.arange(len(nodes))
    return nodes[low[others]], nodes[others]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Link sorted (key, words) rows; a run that a batch cuts off waits for the next batch.

    With a root behind the words, it is linked instead of the fingerprint, unless it is 0.
    """
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def emit(parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if parts:
            words = np.concatenate([x[1] for x in parts], axis=1)
            pairs = linked(np.concatenate([x[0] for x in parts]), words[:CHECKED])
            ends = [_node(words[:CHECKED, pairs[:, j]]) for j in (0, 1)]
            if len(words) > CHECKED:
                roots = words[CHECKED].view(np.int64)[pairs]
                ends = [np.where(roots[:, j] == 0, ends[j], roots[:, j]) for j in (0, 1)]
            low, others = stars(*ends)
            if len(low):
                yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(others)], names=["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys, *words = (column.to_numpy(zero_copy_only=False) for column in batch.columns)
        words = np.stack(words).view(np.uint64)
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if cut:
            yield from emit([*waiting, (keys[:cut], words[:, :cut])])
            waiting = []
        waiting.append((keys[cut:], words[:, cut:]))
    yield from emit(waiting)


def similar(sets: list[np.ndarray]) -> np.ndarray:
    """Per set the number of its component: walks over pairs of sets that are similar enough.

    The inverted index covers the sets that no walk has reached, and is made anew as they halve.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    label, left = np.full(len(sets), -1), np.ones(len(sets), bool)
    held = 0
    members = tokens = posts = np.zeros(0, np.int64)
    for seed in range(len(sets)):
        if not left[seed]:
            continue
        left[seed], label[seed], queue = False, seed, [seed]
        while queue:
            rest = int(left.sum())
            if not rest:
                label[queue] = seed
                break
            if 2 * rest <= held or not held:
                members, held = np.flatnonzero(left), rest
                every = np.concatenate([sets[m] for m in members])
                owner = np.repeat(np.arange(len(members)), sizes[members])
                order = np.argsort(every, kind="stable")
                tokens, posts = every[order], owner[order]
            at = queue.pop()
            a, b = np.searchsorted(tokens, sets[at], "left"), np.searchsorted(tokens, sets[at], "right")
            n = b - a
            spots = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
            shared = np.bincount(posts[spots], minlength=len(members))
            near = (NUMERATOR + DENOMINATOR) * shared >= NUMERATOR * (sizes[at] + sizes[members])
            hits = members[near & left[members]]
            left[hits], label[hits] = False, seed
            queue.extend(hits.tolist())
    return label


def _verify(table: pa.Table) -> pa.Table:
    """The components of one cluster; rows that are not the text that was asked for fall away."""
    sets = {}
    for fp, text in zip(table.column("fp"), table.column("text"), strict=True):
        found = shingles(text.as_py())
        if fp.as_py() == _name(found):
            sets[fp.as_py()] = found
    fps = np.array(list(sets), np.int64)
    return pa.table([pa.array(fps), pa.array(fps[similar(list(sets.values()))])], names=["node", "root"])


def candidates(prints: DataFrame) -> DataFrame:
    """(node, root) of the fingerprints (node, print) that have links: the smallest one that each can reach."""
    schema = "key int, w0 long, w1 long, w2 long"
    deal = lambda keyed: keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_links, "u long, v long")
    few = components(deal(prints.mapInArrow(lambda batches: _segments(batches, 0, FEW), schema)))
    rooted = prints.join(few, "node", "left").select("node", "print", F.coalesce("root", F.lit(0).cast("long")).alias("root"))
    more = deal(rooted.mapInArrow(lambda batches: _segments(batches, FEW), f"{schema}, root long"))
    return components(few.select(F.col("root").alias("u"), F.col("node").alias("v")).unionByName(more))


def groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(id, fp, component_id, row, component): the smallest id of each document's group; fp names its set of shingles.

    ``row`` is the column ``row_col``, or a hash of id and text.
    """
    row = F.col(row_col) if row_col else F.xxhash64(F.col(id_col), F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), row.alias("row"), F.col(text_col).alias("text"))
    found = materialise(rows.mapInArrow(_sketches, f"id {id_type(docs, id_col)}, row long, fp long, node long, print binary"))
    linked_nodes = candidates(found.where("fp <> 0").select("node", "print").dropDuplicates(["node"]))
    # One row of the documents for each set; sets that share a fingerprint are candidates without a link.
    sets = found.groupBy("fp").agg(F.min("row").alias("row"), F.min("node").alias("node"))
    shared = sets.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node", F.col("node").alias("root"))
    clusters = linked_nodes.unionByName(shared).groupBy("node").agg(F.min("root").alias("cluster"))
    # The sets of a cluster, each with its text.
    asked = sets.join(clusters, "node").select("fp", "row", "cluster")
    texts = rows.select("row", "text").join(asked, "row")
    roots = materialise(texts.groupBy("cluster").applyInArrow(_verify, "node long, root long"))
    return simhash.named(found.select("id", "row", "fp"), roots, id_col)


def representatives(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, one of each group: the row with the smallest id, whole and unchanged."""
    return simhash.representatives(docs, id_col=id_col, text_col=text_col, grouped=groups)
