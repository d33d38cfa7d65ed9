"""Reach in a graph: shortest paths between many pairs, neighbourhoods, and clusters of mutual reach.

Edges have columns a and b. Each round joins the edges to what the round before has changed, is
written to the shared folder and read again, so that lost executors cost a round's tasks only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.shared import scratch, stage

#: Sources that share a row of a round.
BITS = 32


def both_ways(edges: DataFrame) -> DataFrame:
    """Edges that can be walked in either direction."""
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def reached(edges: DataFrame, sources: DataFrame, most: int, wanted: DataFrame | None = None, undirected: bool = False) -> DataFrame:
    """source, node, hops and parent of the nodes that each source(source) reaches in at most so many hops, itself included.

    hops is the least number; parent is the least node from which it is reached so. Only nodes that
    the last round has reached are joined to the edges, and only new ones are kept. With
    wanted(source, target) a source whose targets are all reached goes no further. Nodes are numbered
    in their order and BITS sources are bits of one row, so a round handles each edge once for all of them.
    """
    spark = edges.sparkSession
    cut = scratch(spark, "reached")
    start = sources.where("source IS NOT NULL").select(F.col("source").alias("node")).distinct()
    edges = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    ends = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node")))
    # partitions of a sorted table and the rows in them are counted upwards: ids in the order of the nodes
    nodes = cut(ends.union(start).distinct().orderBy("node").select("node", F.monotonically_increasing_id().alias("id")), keep=True)
    for c in "ab":
        edges = edges.join(nodes.withColumnsRenamed({"node": c, "id": f"_{c}"}), c)
    e = edges.select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    e = cut((both_ways(e) if undirected else e).distinct(), keep=True)
    nth = start.join(nodes, "node").orderBy("id").select("node", "id", F.monotonically_increasing_id().alias("nth"))
    bit = F.expr(f"shiftleft(1L, CAST(nth % {BITS} AS INT))")
    nth = cut(nth.withColumns({"block": F.floor(F.col("nth") / BITS).cast("long"), "mask": bit}), keep=True)
    if wanted is not None:
        of = nth.select(F.col("node").alias("source"), "block", "mask")
        ids = nodes.select(F.col("node").alias("target"), F.col("id").alias("node"))
        wanted = cut(wanted.join(of, "source").join(ids, "target", "left").select("node", "block", "mask"), keep=True)
    last = seen = cut(nth.groupBy(F.col("id").alias("node"), "block").agg(F.bit_or("mask").alias("mask")), keep=True)
    levels = []
    for _ in range(most):
        if wanted is not None:
            met = wanted.join(seen.withColumnRenamed("mask", "_met"), ["node", "block"], "left").where(F.coalesce(F.col("mask").bitwiseAND(F.col("_met")), F.lit(0)) == 0)
            open_ = met.groupBy("block").agg(F.bit_or("mask").alias("_open"))
            last = last.join(open_, "block").select("node", "block", F.col("mask").bitwiseAND(F.col("_open")).alias("mask")).where("mask <> 0")
        step = last.join(e, last["node"] == e["a"]).select(F.col("b").alias("node"), "block", "a", "mask")
        new = step.join(seen.withColumnRenamed("mask", "_seen"), ["node", "block"], "left")
        new = new.withColumn("mask", F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("_seen", F.lit(0).cast("long"))))).where("mask <> 0")
        new = new.groupBy("node", "block").agg(F.bit_or("mask").alias("mask"), *(F.min(F.expr(f"CASE WHEN (mask & {1 << j}L) <> 0 THEN a END")).alias(f"p{j}") for j in range(BITS)))
        new = cut(new.select("node", "block", "mask", F.array(*(f"p{j}" for j in range(BITS))).alias("parents")), keep=True)
        if new.isEmpty():
            break
        levels.append(new)
        last = new.select("node", "block", "mask")
        seen = cut(seen.union(last).groupBy("node", "block").agg(F.bit_or("mask").alias("mask")))
    name = lambda c: nodes.select(F.col("node").alias(c), F.col("id").alias(f"_{c}"))
    found = nth.select(F.col("node").alias("source"), "node", F.lit(0).alias("hops"), F.lit(None).cast(nodes.schema["node"].dataType).alias("parent"))
    if levels:
        rows = reduce(DataFrame.union, (x.select("node", "block", F.lit(k).alias("hops"), F.posexplode("parents").alias("at", "_parent")) for k, x in enumerate(levels, 1)))
        rows = rows.where("_parent IS NOT NULL").select(F.col("node").alias("_node"), (F.col("block") * BITS + F.col("at")).alias("nth"), "hops", "_parent")
        rows = rows.join(nth.select(F.col("node").alias("source"), "nth"), "nth").join(name("node"), "_node").join(name("parent"), "_parent")
        found = found.union(rows.select("source", "node", "hops", "parent"))
    return cut(found, keep=True)


def walked(found: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """source, target, hops and path of pairs(source, target), or of all that are found: parents followed from the target to the source.

    A round a hop, over the paths that haven't come to their source yet.
    """
    cut = scratch(found.sparkSession, "walked")
    start = found.withColumnRenamed("node", "target")
    if pairs is not None:
        start = pairs.select("source", "target").distinct().join(start, ["source", "target"])
    back = found.where("hops > 0").select("source", F.col("node").alias("at"), F.col("parent").alias("next"))
    now, ended = start.select("source", "target", "hops", F.array("target").alias("path"), F.col("parent").alias("at")), []
    while True:
        now = cut(now, keep=True)
        path = F.when(F.col("at").isNull(), F.col("path")).otherwise(F.concat(F.array("at"), "path"))
        ended.append(now.where("at IS NULL OR at = source").select("source", "target", "hops", path.alias("path")))
        left = now.where("at <> source")
        if left.isEmpty():
            return reduce(DataFrame.union, ended)
        now = left.join(back, ["source", "at"]).select("source", "target", "hops", F.concat(F.array("at"), "path").alias("path"), F.col("next").alias("at"))


def shortest(edges: DataFrame, pairs: DataFrame, most: int = 6) -> DataFrame:
    """source, target, hops and path of the pairs(source, target) that at most so many hops join.

    Of the shortest paths it is the one whose last step comes from the least node, and so on
    backwards. A pair of one node has the path of that node; nulls and pairs that repeat give nothing more.
    """
    pairs = stage(pairs.where("source IS NOT NULL AND target IS NOT NULL").select("source", "target").distinct(), "pairs")
    return walked(reached(edges, pairs.select("source"), most, pairs), pairs)


def _dealt(df: DataFrame) -> DataFrame:
    """A side of a join that is shuffled and never sent whole: rounds are many, and each would send its tables over the driver."""
    return df.hint("merge")


def _least(edges: DataFrame, cut) -> DataFrame:
    """node, least: the smallest node from which each node of the edges can be reached, itself included.

    A label is a node that reaches its bearer, so that node's own label reaches it as well: labels
    take those before them and jump to their label's label, and long ways take few rounds.
    """
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = cut(nodes.select("node", F.col("node").alias("least")), keep=True)
    while True:
        near = edges.join(_dealt(labels.withColumnRenamed("node", "a")), "a").groupBy("b").agg(F.min("least").alias("before"))
        new = labels.join(_dealt(near), labels["node"] == near["b"], "left").select("node", F.col("least").alias("old"), F.least("least", "before").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("least").alias("jumped"))
        new = cut(new.join(_dealt(jump), "to").select("node", "old", F.least("to", "jumped").alias("least")), keep=True)
        labels = new.select("node", "least")
        if new.where("old <> least").isEmpty():
            return labels


def _trimmed(edges: DataFrame, cut) -> DataFrame:
    """Edges whose start has an edge before it and whose end has one after it, until all are so: ends of chains are in no cycle."""
    n = edges.count()
    while n:
        starts, ends = edges.select(F.col("a").alias("b")).distinct(), edges.select(F.col("b").alias("a")).distinct()
        edges = cut(edges.join(_dealt(starts), "b", "left_semi").join(_dealt(ends), "a", "left_semi").select("a", "b"), keep=True)
        n, before = edges.count(), n
        if n == before:
            break
    return edges


def clusters(edges: DataFrame) -> DataFrame:
    """node, cluster: the smallest node of those that each node reaches and is reached from, itself included.

    Each round labels nodes with the smallest node that reaches them, and finds those that reach it
    back within the label: they are that node's cluster. They go, and so do edges between labels,
    which no cluster has. Nodes that lie in no cycle are clusters of their own. An edge with a null
    end is none; loops and repeated edges change nothing.
    """
    cut = scratch(edges.sparkSession, "clusters")
    whole = cut(edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL").distinct(), keep=True)
    left, found = whole.where("a <> b"), []
    while True:
        left = _trimmed(left, cut)
        if left.isEmpty():
            break
        label = _least(left, cut)
        of = {c: label.select(F.col("node").alias(c), F.col("least").alias(f"of_{c}")) for c in "ab"}
        inside = cut(left.join(_dealt(of["a"]), "a").join(_dealt(of["b"]), "b").where("of_a = of_b").select("a", "b", F.col("of_a").alias("of")), keep=True)
        back = _least(inside.select(F.col("b").alias("a"), F.col("a").alias("b")), cut)
        own = label.join(_dealt(back.withColumnRenamed("least", "reaches")), "node").where("least = reaches").select("node", F.col("least").alias("cluster"))
        # the smallest node of a label may have no edge inside it; it is alone then
        found.append(cut(own, keep=True))
        roots = label.where("node = least").select("node").union(found[-1].select("node")).distinct()
        for c in "ab":
            inside = inside.join(_dealt(roots.withColumnRenamed("node", c)), c, "left_anti")
        left = cut(inside.select("a", "b"), keep=True)
    nodes = whole.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    if not found:
        return nodes.select("node", F.col("node").alias("cluster"))
    return nodes.join(_dealt(reduce(DataFrame.union, found)), "node", "left").select("node", F.coalesce("cluster", "node").alias("cluster"))
