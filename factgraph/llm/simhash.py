"""SimHash near-duplicate groups by multi-index hashing.

Fingerprints come from whole texts: A-Z lower-cased, words split at ASCII white space, four-word
shingles with repeats, XXH64 (seed 42) each, and a bit is 1 if it is set in over half of them.

Two fingerprints that differ in at most ``distance`` = 4 bits differ in at most 2 within one of
their two 32-bit segments. Both sides of such a pair enumerate the Hamming ball of radius 1 around
each segment (33 keys), so the pair meets under the key half-way between them; full distances are
then verified. Distinct fingerprints only take part, and copies join by equality, so a group of
exact copies costs one fingerprint. Keys are dealt out by hash; within a key, fingerprints that meet
are linked by a spanning forest instead of all pairs, which loses no connection: a small run
compares all its pairs at once, a large one is walked breadth first through an index over the
other segment. Components follow by star contraction, and every step is written to the shared
folder.

Defined results: a null, empty or blank text has fingerprint zero and links like any other; texts of
fewer than four words have one shingle, the whole sequence; repeated rows (and rows with a null id)
get one output row each, and a component without any id has a null component_id; an empty table gives an empty result; only the id and text columns are
read. Texts of any length are taken in blocks of shingles, in bounded memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.llm.components import components
from factgraph.llm.rows import id_type, row_key, without
from factgraph.runtime import materialise

SHINGLE, SEED, DISTANCE = 4, 42, 4
_BLOCK = 1 << 16
#: Runs of one key up to this size are compared pair by pair.
SMALL_RUN = 48


def fingerprint(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned 64-bit fingerprint of a whole text."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) < size:
        return xxh64_intdigest(line, seed)
    firsts, lasts = starts[: len(words) - size + 1], ends[size - 1 :]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(firsts), _BLOCK):
        pairs = zip(firsts[at : at + _BLOCK].tolist(), lasts[at : at + _BLOCK].tolist(), strict=True)
        hashes = np.array([xxh64_intdigest(line[a:b], seed) for a, b in pairs], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    ones = np.flatnonzero(2 * counts > len(firsts)).tolist()
    return sum(1 << i for i in ones)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found)], names=["id", "row", "fp"])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(id, row, fp) per row of ``docs``; fp is the fingerprint as a signed long, row the column ``row_col`` (null without)."""
    row = F.col(row_col) if row_col else F.lit(None).cast("long")
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), row.alias("row")).mapInArrow(_fingerprints, f"id {id_type(docs, id_col)}, row long, fp long")


def _near(some: np.ndarray, other: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    return np.bitwise_count(some ^ other) <= distance


def _walk(run: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """A spanning forest of the fingerprints in one large run, breadth first.

    Candidates are found by index: two fingerprints within 4 bits agree on at least one of five
    parts, so each visit reads five buckets and never the whole run.
    """
    cuts = (0, 13, 26, 39, 52, 64)
    parts = [(run >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    left, us, vs = np.ones(len(run), bool), [], []
    held, rest, orders, sorted_parts = 0, len(run), [], []
    for seed in range(len(run)):
        if not left[seed]:
            continue
        left[seed], rest = False, rest - 1
        queue = [seed]
        while queue:
            at = queue.pop()
            if 2 * rest <= held or not held:
                # The index covers those not reached yet, and is made anew as they halve.
                members = np.flatnonzero(left)
                held = max(1, len(members))
                orders = [members[np.argsort(p[members], kind="stable")] for p in parts]
                sorted_parts = [p[o] for p, o in zip(parts, orders, strict=True)]
            for p, o, s in zip(parts, orders, sorted_parts, strict=True):
                bucket = o[np.searchsorted(s, p[at], "left") : np.searchsorted(s, p[at], "right")]
                bucket = bucket[left[bucket]]
                hits = bucket[_near(run[bucket], run[at])]
                if len(hits):
                    left[hits] = False
                    rest -= len(hits)
                    queue.extend(hits.tolist())
                    us.append(np.full(len(hits), run[at]))
                    vs.append(run[hits])
    return us, vs


def _link_runs(keys: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges among fingerprints that share a key; both arrays are sorted by key."""
    edges = np.flatnonzero(np.diff(keys)) + 1
    starts, stops = np.concatenate(([0], edges)), np.concatenate((edges, [len(keys)]))
    sizes = stops - starts
    us, vs = [], []
    for size in np.unique(sizes[sizes > 1]):
        first = starts[sizes == size]
        if size > SMALL_RUN:
            for at in first.tolist():
                u, v = _walk(np.unique(found[at : at + size]))
                us += u
                vs += v
            continue
        table = found[first[:, None] + np.arange(size)]
        for i in range(size - 1):
            for j in range(i + 1, size):
                near = _near(table[:, i], table[:, j])
                us.append(table[near, i])
                vs.append(table[near, j])
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *us]), np.concatenate([none, *vs])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Link sorted (key, fp) rows; a run that a batch cuts off waits for the next batch."""
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def emit(parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if parts:
            u, v = _link_runs(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            if len(u):
                low, high = np.minimum(u.view(np.int64), v.view(np.int64)), np.maximum(u.view(np.int64), v.view(np.int64))
                pairs = np.unique(np.stack((low, high), axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    for batch in batches:
        keys, found = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if not len(keys):
            continue
        found = found.view(np.uint64)
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if cut:
            yield from emit([*waiting, (keys[:cut], found[:cut])])
            waiting = []
        waiting.append((keys[cut:], found[cut:]))
    yield from emit(waiting)


def links(found: DataFrame) -> DataFrame:
    """Edges (u, v) whose components are those of all pairs of distinct ``fp`` within 4 bits."""
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(32)])
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)
    # The segment's number stands above its 32 bits.
    balls = F.concat(F.transform(flips, lambda m: low.bitwiseXOR(m)), F.transform(flips, lambda m: high.bitwiseXOR(m) + F.lit(1 << 32)))
    rows = found.select("fp").distinct().select(F.explode(balls).alias("key"), "fp")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(_links, "u long, v long")


def groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(id, fp, component_id, row, component): the smallest id that each document reaches through links and copies.

    ``component`` names the group by a fingerprint, also where no row of it has an id; ``row`` is the
    column ``row_col``.
    """
    found = materialise(fingerprints(docs, id_col=id_col, text_col=text_col, row_col=row_col))
    return named(found, components(links(found)), id_col)


#: A component's name is sent to its fingerprints over so many keys.
SALTS = 16


def named(found: DataFrame, roots: DataFrame, id_col: str) -> DataFrame:
    """(id, fp, component_id, row, component) of ``found`` (id, row, fp), given the root of each fp that has links."""
    low = found.groupBy("fp").agg(F.min("id").alias("low"))
    named = materialise(low.join(roots, low["fp"] == roots["node"], "left").select("fp", "low", "root"))
    # Partial minima first: a component of very many fingerprints reaches its task as few rows. Its
    # name goes back to them under several keys, so that no task has to read all of them.
    linked = named.where("root is not null").withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)))
    tops = linked.groupBy("root").agg(F.min("low").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    alone = named.where("root is null").select("fp", F.col("low").alias("component_id"), F.col("fp").alias("component"))
    labels = materialise(alone.unionByName(linked.join(tops, ["root", "salt"]).select("fp", "component_id", F.col("root").alias("component"))))
    # A fingerprint that very many copies share is one key of this join; adaptive execution splits
    # such a partition, as the other side has one row for it.
    return found.join(labels, "fp").select(F.col("id").alias(id_col), "fp", "component_id", "row", "component")


def digest(docs: DataFrame, **names) -> DataFrame:
    out = groups(docs, **names)
    return out.select(out.columns[0], F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def best_rows(found: DataFrame) -> DataFrame:
    """(id, row) of every row of ``found`` (id, row, component) but the first of its component, by id (null last) and row."""
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    # Most components are one row, and send nothing.
    first = found.groupBy("component").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    spread = first.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    rest = found.withColumn("salt", F.pmod(F.xxhash64("id", "row"), F.lit(SALTS))).join(spread, ["component", "salt"])
    return rest.where(order != F.col("first")).select("id", "row")


def representatives(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", grouped=None) -> DataFrame:
    """The documents, one of each group of ``grouped``: the row with the smallest id, whole and unchanged.

    Rows are told apart by id and all columns, so an id that occurs with several texts loses no text
    that no other row has. Rows that are equal in every column are one document. A row without an id
    comes after all that have one.
    """
    grouped = grouped or groups
    keyed = docs.withColumn("row_key_", row_key(docs))
    found = materialise(grouped(keyed, id_col=id_col, text_col=text_col, row_col="row_key_").select(F.col(id_col).alias("id"), "row", F.col("component").alias("component")))
    kept = without(docs, best_rows(found), id_col)
    twice = found.groupBy("id", "row").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", "row")
    if twice.isEmpty():
        return kept
    # Rows equal in every column: few of those that are kept, and only these are compared whole.
    again = without(kept, twice, id_col, how="left_semi").dropDuplicates()
    return without(kept, twice, id_col).unionByName(again)
