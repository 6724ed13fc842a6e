"""Walks of a graph as set operations: what is reached, in which order, and what nothing needs any more.

An edge table (src, dst) of any size; each round is joins and aggregations, ends in the shared folder,
and only whether it found anything comes to the driver.  Rounds are as many as the longest path has
steps.  Null ends are left out, repeated edges count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from textloom.operators.ordering import stored


def _edges(edges: DataFrame, src: str, dst: str) -> DataFrame:
    return stored(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null").distinct())


def reached(edges: DataFrame, starts: DataFrame, start: str = "node", src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, depth): what can be reached from any start, by the fewest steps; the starts have depth 0, whether or not they have edges."""
    steps = _edges(edges, src, dst)
    found = frontier = stored(starts.select(F.col(start).alias("node")).where("node is not null").distinct().withColumn("depth", F.lit(0)))
    depth = 0
    while True:
        depth += 1
        further = steps.join(frontier.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        frontier = stored(further.join(found, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return found
        found = stored(found.union(frontier))


def levels(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, level): every node after all that lead to it, from 0; null for nodes on a cycle and behind one."""
    steps = _edges(edges, src, dst)
    nodes = steps.select(F.col("src").alias("node")).union(steps.select("dst")).distinct()
    waits = stored(steps.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("open")))
    now = stored(nodes.join(waits, "node", "left_anti").withColumn("level", F.lit(0)))
    done, level = now, 0
    while True:
        level += 1
        # the frontier's edges are taken off, and a node is free when none is left
        off = steps.join(now.select(F.col("node").alias("src")), "src", "left_semi").groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("off"))
        waits = stored(waits.join(off, "node", "left").select("node", (F.col("open") - F.coalesce("off", F.lit(0))).alias("open")))
        now = stored(waits.where("open = 0").select("node", F.lit(level).alias("level")))
        if now.isEmpty():
            return done.union(waits.select("node", F.lit(None).cast("int")))
        waits = waits.where("open > 0")
        done = stored(done.union(now))


def orphaned(edges: DataFrame, removed: DataFrame, node: str = "node", src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, round): the removed nodes (round 0), and those all of whose successors are removed by then, which nothing needs any more.

    A node without successors is a result and stays.
    """
    steps = _edges(edges, src, dst)
    needs = stored(steps.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("open")))
    gone = now = stored(removed.select(F.col(node).alias("node")).where("node is not null").distinct().withColumn("round", F.lit(0)))
    turn = 0
    while True:
        turn += 1
        off = steps.join(now.select(F.col("node").alias("dst")), "dst", "left_semi").groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("off"))
        needs = stored(needs.join(off, "node", "left").select("node", (F.col("open") - F.coalesce("off", F.lit(0))).alias("open")))
        now = stored(needs.where("open = 0").join(gone, "node", "left_anti").select("node", F.lit(turn).alias("round")))
        if now.isEmpty():
            return gone
        gone = stored(gone.union(now))
