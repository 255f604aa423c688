"""Fixpoints over edge tables: chains, closures, bounded search, cycles, reachability."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.runtime import materialise

#: After so many rounds of a fixpoint what was found is written as one table, so that plans stay small.
_FOLD = 16


def closure(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(src, dst, depth): everything that each node reaches, at its smallest depth.

    A frontier loop: each round joins the newest pairs with the edges and keeps those not seen yet,
    so cyclic and dense graphs do not blow up as path enumeration would, and the loop ends when a
    round finds nothing new. Rounds go to the shared
    folder, which cuts lineage and survives lost executors.
    """
    step = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct()
    seen = frontier = materialise(step.withColumn("depth", F.lit(1)))
    for depth in count(2):
        hop = frontier.select("src", F.col("dst").alias("mid")).join(step.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").distinct()
        frontier = materialise(hop.join(seen, ["src", "dst"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        seen = seen if depth % _FOLD else materialise(seen)
    return seen


def bounded_search(edges: DataFrame, root: str, *, direction: str = "callees", max_depth: int = 3) -> DataFrame:
    """(node, depth) of a breadth-first search from one node."""
    if direction not in ("callees", "callers", "both"):
        raise ValueError("direction must be callees, callers or both")
    if not 1 <= max_depth <= 10:
        raise ValueError("max_depth must be between 1 and 10")
    out = edges.select("src", "dst")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    step = {"callees": out, "callers": back, "both": out.unionByName(back)}[direction].distinct()
    seen = frontier = materialise(step.sparkSession.range(1).select(F.lit(root).alias("node"), F.lit(0).alias("depth")))
    for depth in range(1, max_depth + 1):
        hop = frontier.join(step, frontier["node"] == step["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = materialise(hop.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def on_cycles(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Nodes that reach themselves, with the smallest node of their strongly connected component and its size."""
    return components_of(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")))


def cycle_edges(edges: DataFrame) -> DataFrame:
    """(src, dst, component): the edges that lie on cycles, which name the cycles of a component."""
    nodes = components_of(edges)
    a, b = (nodes.select(F.col("node").alias(x), F.col("component").alias(c)) for x, c in (("src", "component"), ("dst", "other")))
    return edges.select("src", "dst").distinct().join(a, "src").join(b, "dst").where("component = other").select("src", "dst", "component")


def reached(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Every node that some root reaches, roots included."""
    step = edges.select("src", "dst").distinct()
    seen = frontier = materialise(roots.select("node").distinct())
    for depth in count(1):
        hop = frontier.join(step, frontier["node"] == step["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = materialise(hop.join(seen, "node", "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        seen = seen if depth % _FOLD else materialise(seen)
    return seen


def mermaid(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(part, line): the lines of a Mermaid graph, the head first, then a line per edge and per node without edges going out.

    Identifiers are made safe, labels are the names as they are.
    """
    name = lambda c: F.col(c).cast("string")
    box = lambda c: F.concat(F.translate(name(c), ".- ", "___"), F.lit('["'), name(c), F.lit('"]'))
    lines = edges.sparkSession.range(1, numPartitions=1).select(F.lit(0).alias("part"), F.lit("graph TD").alias("line"))
    lines = lines.unionByName(edges.select(F.lit(1).alias("part"), F.concat(F.lit("  "), box("src"), F.lit(" --> "), box("dst")).alias("line")))
    if nodes is not None:
        alone = nodes.select("node").distinct().join(edges.select(F.col("src").alias("node")), "node", "left_anti")
        lines = lines.unionByName(alone.select(F.lit(1).alias("part"), F.concat(F.lit("  "), box("node")).alias("line")))
    return lines


def adjacency(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, targets): the sorted targets of every node, none for a node without."""
    found = edges.groupBy(F.col("src").alias("node")).agg(F.sort_array(F.collect_set("dst")).alias("targets"))
    return nodes.select("node").distinct().join(found, "node", "left").withColumn("targets", F.coalesce("targets", F.array().cast(found.schema["targets"].dataType)))


def call_graph(edges: DataFrame, root: str, *, direction: str = "callees", max_depth: int = 3, max_nodes: int = 100) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, depth, ordinal) and edges (src, dst, depth, is_cycle) around one node, each with truncated_by_depth and truncated_by_nodes.

    Breadth first; nodes are numbered in the order in which they are found, by the number of the node
    that leads to them and by name, and no more than ``max_nodes`` are taken. Edges start at nodes
    that were read, that is at less than ``max_depth``, and join nodes that were taken; an edge is on a
    cycle if its end leads back to its start within the graph. Depth is cut if a node stands at
    ``max_depth``.
    """
    if direction not in ("callees", "callers", "both"):
        raise ValueError("direction must be callees, callers or both")
    if not 1 <= max_depth <= 10 or max_nodes < 1:
        raise ValueError("max_depth must be between 1 and 10, max_nodes at least 1")
    out = edges.select("src", "dst", F.lit(False).alias("turned"))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(True).alias("turned"))
    step = {"callees": out, "callers": back, "both": out.unionByName(back)}[direction].distinct()
    spark = edges.sparkSession
    seen = materialise(spark.range(1, numPartitions=1).select(F.lit(root).alias("node"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("ordinal")))
    n, cut = 1, False
    for depth in range(1, max_depth + 1):
        # At most max_nodes rows, so the numbering is over a bounded table.
        open_ = F.broadcast(seen.where(F.col("depth") == depth - 1))
        hop = step.join(open_.select(F.col("node").alias("src"), "ordinal"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("ordinal").alias("parent"))
        new = hop.join(F.broadcast(seen.select("node")), "node", "left_anti").orderBy("parent", "node").limit(max_nodes - n + 1).collect()
        cut = cut or len(new) > max_nodes - n
        new = new[: max_nodes - n]
        if not new:
            break
        kind = edges.select("src").schema[0].dataType.simpleString()
        rows = spark.createDataFrame([(r["node"], depth, n + i) for i, r in enumerate(new)], f"node {kind}, depth int, ordinal bigint")
        seen, n = materialise(seen.unionByName(rows)), n + len(new)
    flags = {"truncated_by_depth": F.lit(not seen.where(F.col("depth") == max_depth).isEmpty()), "truncated_by_nodes": F.lit(cut)}
    read = F.broadcast(seen.where(F.col("depth") < max_depth).select(F.col("node").alias("src"), "depth"))
    taken = step.join(read, "src").join(F.broadcast(seen.select(F.col("node").alias("dst"))), "dst")
    ends = [F.when(F.col("turned"), F.col(b)).otherwise(F.col(a)).alias(a) for a, b in (("src", "dst"), ("dst", "src"))]
    taken = materialise(taken.select(*ends, "depth").groupBy("src", "dst").agg(F.min("depth").alias("depth")))
    # The closure of a graph of at most max_nodes nodes.
    round_trip = closure(taken, "src", "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(True).alias("is_cycle"))
    found = taken.join(round_trip, ["src", "dst"], "left").withColumn("is_cycle", F.coalesce("is_cycle", F.lit(False)) | (F.col("src") == F.col("dst")))
    return seen.withColumns(flags), found.withColumns(flags)


def components_of(edges: DataFrame) -> DataFrame:
    """(node, component): strongly connected components of more than one node, or of one that calls itself, by their smallest node.

    Forward and backward colouring (Orzan 2004): nodes take the smallest name that reaches them, and
    from each name's own node whatever reaches it back within its colour is one component, which is
    taken out. Nothing larger than the edges is ever made.
    """
    edges = materialise(edges.select("src", "dst").distinct())
    loops = edges.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component"))
    found = []
    left = edges.where("src <> dst")
    while not left.isEmpty():
        # Nodes without a way in or a way out are on no cycle.
        left = materialise(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        nodes = left.select(F.col("src").alias("node")).unionByName(left.select(F.col("dst").alias("node"))).distinct()
        colour = materialise(nodes.withColumn("colour", F.col("node")))
        while True:
            lower = left.join(colour.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("low"))
            new = materialise(colour.join(lower, "node", "left").select("node", F.least("colour", F.coalesce("low", "colour")).alias("colour")))
            same = new.join(colour.withColumnRenamed("colour", "old"), "node").where("colour <> old").isEmpty()
            colour = new
            if same:
                break
        a, b = colour.select(F.col("node").alias("src"), F.col("colour").alias("ca")), colour.select(F.col("node").alias("dst"), F.col("colour").alias("cb"))
        within = materialise(left.join(a, "src").join(b, "dst").where("ca = cb").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        group = reached(within, colour.where("node = colour").select("node")).join(colour, "node").select("node", F.col("colour").alias("component"))
        group = materialise(group)
        found.append(group)
        gone = group.select("node")
        left = materialise(left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti"))
    none = loops.where("false")
    whole = reduce(DataFrame.unionByName, found, none)
    sizes = whole.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    large = whole.join(sizes, "component").select("node", "component", "size")
    return large.unionByName(loops.join(large, "node", "left_anti").withColumn("size", F.lit(1).cast("long")))
