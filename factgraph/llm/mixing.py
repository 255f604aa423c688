"""Mixing sources to target weights by Pfair scheduling (native).

Each source is cut into blocks of ``block`` documents in hash order. With a weight of ``k/total``,
block j is released at floor(j * total / k) and due at ceil((j + 1) * total / k); earliest deadline
first among the released fills one slot after another, so that after any number of slots each source
is less than one block away from its target. Weights become whole shares of 2**40, no further than
2**-40 from what was given: 0.001 blocks after 10**9 slots.

The timeline is cut into frames of ``FRAME`` slots or more, which are scheduled side by side. A source
has had either floor or ceil of its target at the start of a frame; the driver settles which, frame
after frame (``states``), so that all counts add up to the slots before it. From any such state the
deadlines can be met: of the blocks that must run between two slots of a frame there are at most
floor(w * t2) - ceil(w * t1) for each source, and so no more than slots. Within its frame earliest
deadline first finds that schedule, over as many blocks as the frame has slots.

Documents find their slot by arithmetic. Ranks within a source are split over hash ranges, so many
that each holds about ``bucket_rows`` rows: a source with a third of all rows is ranked by many
tasks, and offsets are prefix sums over a small table of counts. A range holds consecutive blocks in
each epoch; their slots are joined to the range, not to its documents. The schedule ends once every
document of every source has been used; sources that are exhausted earlier start another epoch, so
no row is dropped.

With ``period`` the weights are first rounded to whole shares of so many slots, at least 1 each, and
the schedule repeats after them; it then keeps to the rounded weights, not to the given ones.

Defined results: documents with a null source are a source of their own; rows equal in all that is
kept are separate documents that take adjacent ranks; a null id hashes like any other value; an empty
table gives an empty schedule; extra columns are carried only if named in ``keep``, and a column of
the schedule whose name is taken gets an underscore.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factgraph.runtime import materialise

BLOCK, BUCKET_ROWS, ALPHA = 16, 1000, 0.7
RESOLUTION = 1 << 40
#: Slots of a frame, if there are few sources.
FRAME = 512
MAX_SOURCES = 10_000


def shares(weights: dict[str, float], period: int) -> dict[str, int]:
    """Whole shares of the period, at least 1 each, by largest remainder."""
    names = sorted(weights)
    if not names:
        return {}
    if len(names) > period:
        raise ValueError("the period must be at least the number of sources")
    whole = math.fsum(weights.values())
    if whole <= 0 or min(weights.values()) < 0:
        raise ValueError("weights must be positive")
    spare = period - len(names)
    exact = {s: weights[s] / whole * spare for s in names}
    out = {s: 1 + math.floor(exact[s]) for s in names}
    rest = period - sum(out.values())
    for s in sorted(names, key=lambda s: (math.floor(exact[s]) - exact[s], s))[:rest]:
        out[s] += 1
    return out


def exact(weights: dict[str, float], resolution: int = RESOLUTION) -> dict[str, int]:
    """Whole shares of ``resolution``, at least 1 each, by largest remainder; none is 1 away from the exact share unless that is below 1."""
    if not all(0 < w < math.inf for w in weights.values()):
        raise ValueError("weights must be positive")
    whole = sum(map(Fraction, weights.values()))
    parts = {s: Fraction(w) * resolution / whole for s, w in weights.items()}
    out = {s: max(1, math.floor(p)) for s, p in parts.items()}
    order = sorted(parts, key=lambda s: (out[s] - parts[s], s))
    rest = resolution - sum(out.values()) if out else 0
    for s in order[: max(0, rest)]:
        out[s] += 1
    # Sources below one share took theirs from the largest.
    if rest < 0:
        out[max(out, key=lambda s: (out[s], s))] += rest
    return out


def _whole(value: Column) -> Column:
    return value.cast("decimal(38,0)")


def _div(a: Column, b: Column) -> Column:
    """Whole division of whole numbers that may be longer than a long; the quotient is a long."""
    return F.call_function("div", _whole(a), _whole(b))


def states(share: list[int], length: int) -> Iterator[list[int]]:
    """How many blocks of each source stand before each frame, without end.

    Each count is floor or ceil of the source's target and never falls, and all of them add up to
    the slots before the frame; what floors leave over goes to the largest remainders.
    """
    total, now = sum(share), [0] * len(share)
    for frame in count(1):
        yield now
        slots = frame * length
        now = [max(n, k * slots // total) for n, k in zip(now, share, strict=True)]
        spare = [i for i, k in enumerate(share) if now[i] * total < k * slots]
        spare.sort(key=lambda i: (now[i] * total - share[i] * slots, i))
        for i in spare[: slots - sum(now)]:
            now[i] += 1


def frames(spark: SparkSession, share: list[int], n_frames: int, length: int, most: int = 1 << 20) -> DataFrame:
    """(frame, jobs): the blocks of every frame, as many as it has slots, by deadline; ``share`` has the sources' shares.

    The driver holds the counts of about ``most`` sources and frames at a time, and writes them to
    the shared folder.
    """
    walk, parts, at, size = states(share, length), [], 0, max(1, most // max(1, len(share)))
    before, total = next(walk), sum(share)
    while at < n_frames or not parts:
        rows = []
        for frame in range(at, min(n_frames, at + size)):
            after = next(walk)
            rows += [{"frame": frame, "number": i, "share": share[i], "from": a, "to": b} for i, (a, b) in enumerate(zip(before, after, strict=True)) if a < b]
            before = after
        at += size
        part = _rows(spark, rows, "frame:bigint,number:int,share:bigint,from:bigint,to:bigint")
        parts.append(materialise(part) if n_frames > size else part)
    begin, end = F.col("frame") * length, (F.col("frame") + 1) * length
    rows = reduce(DataFrame.unionByName, parts).withColumnsRenamed({"number": "number_", "share": "share_"})
    jobs = rows.repartition("frame").withColumn("turn_", F.explode(F.sequence(F.col("from"), F.col("to") - 1)))
    share = _whole(F.col("share_"))
    release = F.greatest(_div(F.col("turn_").cast("decimal(19,0)") * F.lit(total).cast("decimal(18,0)"), share), begin)
    # ceil(a / b) is (a + b - 1) div b.
    due = F.least(_div((F.col("turn_") + 1).cast("decimal(19,0)") * F.lit(total).cast("decimal(18,0)") + F.col("share_") - 1, share), end)
    job = F.struct(due.alias("due"), F.col("number_").alias("number"), F.col("turn_").alias("turn"), release.alias("release"))
    return jobs.groupBy("frame").agg(F.sort_array(F.collect_list(job)).alias("jobs"))


def schedule(spark: SparkSession, share: list[int], n_frames: int, length: int = FRAME) -> DataFrame:
    """(number_, turn_, slot_) per block: earliest deadline first among the released blocks of each frame."""
    begin = F.col("frame") * length

    def step(state: Column, slot: Column) -> Column:
        # Jobs stand in the order of their deadlines, so the first that is released runs.
        chosen = F.get(F.filter(state["left"], lambda j: j["release"] <= slot), F.lit(0))
        return F.element_at(F.transform(F.array(chosen), lambda c: F.struct(F.filter(state["left"], lambda j: (j["number"] != c["number"]) | (j["turn"] != c["turn"])).alias("left"), F.concat(state["done"], F.array(c)).alias("done"))), 1)

    start = F.struct(F.col("jobs").alias("left"), F.slice("jobs", F.lit(1), F.lit(0)).alias("done"))
    order = F.aggregate(F.sequence(begin, begin + length - 1), start, step, lambda s: s["done"])
    placed = frames(spark, share, n_frames, length).select("frame", F.posexplode(order).alias("at", "job"))
    return placed.select(F.col("job.number").alias("number_"), F.col("job.turn").alias("turn_"), (begin + F.col("at")).alias("slot_"))


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def _rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table from the driver, as a literal."""
    return spark.range(1, numPartitions=1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("s")).select("s.*")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, *, id_col: str = "doc_id", source_col: str = "source", keep: tuple[str, ...] = (), alpha: float = ALPHA, period: int | None = None, block: int = BLOCK, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The schedule: ``keep`` (or id and source) with epoch, slot and position.

    ``weights`` gives each source its target; without it the targets are the source sizes to the
    power ``alpha``. Sources that ``weights`` does not name are an error, not dropped.
    """
    spark, names = docs.sparkSession, list(keep or (id_col, source_col))
    order = F.xxhash64(F.col(id_col), *[F.col(f"`{c}`") for c in names])
    rows = docs.select(_key(F.col(source_col)).alias("key_"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row_"), order.alias("hash_"), F.col(id_col).alias("id_"))
    found = {r["key_"]: r["n"] for r in rows.groupBy("key_").agg(F.count(F.lit(1)).alias("n")).limit(MAX_SOURCES + 1).collect()}
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    if weights is None:
        target = {s: n**alpha for s, n in found.items()}
    else:
        target = {"null" if s is None else f"={s}": w for s, w in weights.items()}
        if found.keys() - target.keys():
            raise ValueError(f"sources without a weight: {sorted(found.keys() - target.keys())}")
        target = {s: target[s] for s in found}
    if period is None:
        share = exact(target)
    else:
        share = shares(target, max(period, 1 << (4 * len(found)).bit_length()) if len(found) > period // 4 else period)
    needed, total = {s: -(-n // block) for s, n in found.items()}, sum(share.values())
    # No block of a source is released after the last deadline of those that are needed.
    bound = max((-(-n * total // share[s]) for s, n in needed.items()), default=0)
    length = max(FRAME, len(found) // 8)
    sources = [{"key_": s, "number_": i, "rows": n, "needed": needed[s]} for i, (s, n) in enumerate(sorted(found.items()))]
    # At most MAX_SOURCES rows.
    plan = F.broadcast(_rows(spark, sources, "key_:string,number_:int,rows:bigint,needed:bigint"))
    slots = materialise(schedule(spark, [share[s] for s in sorted(found)], -(-bound // length), length))
    last = slots.join(plan.select("number_", "needed"), "number_").where("turn_ = needed - 1").agg(F.max("slot_")).first()[0] if found else None
    end = 0 if last is None else last + 1
    slots = slots.where(F.col("slot_") < end)
    limits = [{"key_": s, "limit": -(-end * share[s] // max(1, total)) + 1} for s in sorted(found)]
    plan = F.broadcast(plan.join(_rows(spark, limits, "key_:string,limit:bigint"), "key_").select("key_", "number_", "rows", "limit"))
    buckets = max(64, min(1 << 20, sum(found.values()) // bucket_rows))
    rows = rows.withColumn("bucket_", F.pmod("hash_", F.lit(buckets)).cast("int"))
    tally = rows.groupBy("key_", "bucket_").agg(F.count(F.lit(1)).alias("n_"))
    before = F.sum("n_").over(Window.partitionBy("key_").orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1))
    offsets = tally.select("key_", "bucket_", "n_", F.coalesce(before, F.lit(0)).alias("before_")).join(plan, "key_")
    # The blocks that a bucket's documents lie in, epoch by epoch, and the slots of those that are scheduled.
    last = F.floor((F.col("limit") * block - 1 - F.col("before_")) / F.col("rows")).cast("long")
    runs = offsets.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    begin = F.col("before_") + F.col("epoch") * F.col("rows")
    within = F.sequence(F.floor(begin / block).cast("long"), F.floor((begin + F.col("n_") - 1) / block).cast("long"))
    runs = runs.withColumn("turn_", F.explode(within)).join(slots, ["number_", "turn_"])
    runs = runs.groupBy("key_", "bucket_", "before_", "rows", "epoch").agg(F.sort_array(F.collect_list(F.struct("turn_", "slot_"))).alias("slots"))
    runs = runs.groupBy("key_", "bucket_", "before_", "rows").agg(F.collect_list(F.struct("epoch", F.col("slots")[0]["turn_"].alias("base"), F.col("slots.slot_").alias("slots"))).alias("runs"))
    ranked = rows.withColumn("rank_", F.row_number().over(Window.partitionBy("key_", "bucket_").orderBy("hash_", "id_")) - 1)
    placed = ranked.join(runs, ["key_", "bucket_"])
    placed = placed.withColumn("first_", F.col("rank_") + F.col("before_"))
    element = lambda epoch: F.col("first_") + epoch * F.col("rows")
    slot = lambda r: F.get(r["slots"], (F.floor(element(r["epoch"]) / block) - r["base"]).cast("int"))
    uses = F.transform("runs", lambda r: F.struct(r["epoch"].alias("epoch"), slot(r).alias("slot")))
    placed = placed.withColumn("use_", F.explode(F.filter(uses, lambda u: u["slot"].isNotNull())))
    position = F.col("use_.slot") * block + element(F.col("use_.epoch")) % block
    added = {"epoch": F.col("use_.epoch"), "slot": F.col("use_.slot"), "position": position.cast("long")}
    return placed.select(*[F.col(f"row_.`{c}`").alias(c) for c in names], *[c.alias(free(n, names)) for n, c in added.items()])


def free(name: str, taken: list[str]) -> str:
    """The name, with as many trailing underscores as it takes to differ from all others in any case."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name
