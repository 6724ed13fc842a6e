"""Connected components of an edge table, by star contraction.

Every round replaces each node's larger neighbours' edges by edges to its least
neighbour, then its smaller ones' likewise; stars remain after a number of rounds that
grows with the logarithm of the longest chain.  All work is joins and aggregations that
combine on the map side, each round ends in the shared folder, and only two numbers a
round come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from textloom.llm import _text
from textloom.llm._text import stored


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component) of every node of an edge table of longs; component is the least id reachable.

    Rounds go on until nothing changes, and a round's table is deleted when the next one is
    written.  Loops and repeated edges do no harm, edges with a null end are left out, and no
    edges give an empty table.
    """
    pairs = edges.select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b")).where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col("a") != F.col("b"))).distinct()
    now, before = stored(pairs), None
    while True:
        path = _text.written[-1]
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        now = stored(_small_star(_large_star(now)))
        _text.drop(now.sparkSession, path)
    return now.select(F.col("b").alias("id"), F.col("a").alias("component")).union(now.select(F.col("a"), F.col("a")).distinct())


def _large_star(pairs: DataFrame) -> DataFrame:
    """Each node's larger neighbours are joined to the least of the node and its neighbours."""
    both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select("b", "a"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = both.where(F.col("v") > F.col("u")).join(least, "u")
    return out.select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are joined to the least of these."""
    least = pairs.groupBy("b").agg(F.min("a").alias("m"))
    out = pairs.join(least, "b").select(F.col("m"), F.explode(F.array("a", "b")).alias("n"))
    return out.where(F.col("m") != F.col("n")).select(F.col("m").alias("a"), F.col("n").alias("b")).distinct()
