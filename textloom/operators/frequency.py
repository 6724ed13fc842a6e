"""Aged frequency sketches, and a cache that admits by them.

A count-min sketch is a table (row, cell, count): every access counts in one cell of each of
``depth`` rows.  Tables of several tasks, streams or days are merged by adding cells, and
ageing halves all counts once a period, so that a sketch of periods is a sum of its periods' own sketches with weights 1, 1/2, 1/4, ..
The sketch's size is fixed by its width, whatever the number of items.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from textloom.operators.ordering import joined, numbered, stored

DEPTH, WIDTH = 4, 1 << 16


def cells(item: Column, depth: int = DEPTH, width: int = WIDTH) -> Column:
    """The item's (row, cell) structs, one for each row of the sketch."""
    place = lambda k: F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(k)), item.cast("string"))), 1, 12), 16, 10).cast("long"), F.lit(width))
    return F.array(*[F.struct(F.lit(k).alias("row"), place(k).alias("cell")) for k in range(depth)])


def sketch(accesses: DataFrame, item: str, keys: list[str] | None = None, depth: int = DEPTH, width: int = WIDTH) -> DataFrame:
    """(keys, row, cell, count double): accesses counted by cell, each distinct item hashed once after its accesses are added up.

    A null item isn't counted.
    """
    keys = keys or []
    known = accesses.where(F.col(item).isNotNull()).groupBy(*keys, item).agg(F.count(F.lit(1)).alias("count"))
    spread = known.select(*keys, "count", F.explode(cells(F.col(item), depth, width)).alias("c"))
    return spread.groupBy(*keys, "c.row", "c.cell").agg(F.sum("count").cast("double").alias("count"))


def merged(*sketches: DataFrame) -> DataFrame:
    """The sum of sketches (row, cell, count)."""
    whole = reduce(DataFrame.unionByName, [s.select("row", "cell", "count") for s in sketches])
    return whole.groupBy("row", "cell").agg(F.sum("count").alias("count"))


def aged(old: DataFrame, periods: int = 1) -> DataFrame:
    """A sketch after so many halvings; cells below a millionth are left out."""
    return old.withColumn("count", F.col("count") / float(2**periods)).where("count >= 1e-6")


def by_period(accesses: DataFrame, item: str, period: str, depth: int = DEPTH, width: int = WIDTH) -> DataFrame:
    """(period, row, cell, count): the aged sketch at the end of each period in which a cell was counted, before its next halving.

    The periods are whole numbers, fewer than a thousand apart.  A cell's periods, not its accesses, are ordered.
    """
    own = sketch(accesses, item, [period], depth, width)
    # 2 ** (period - first) can be added up, and divided by 2 ** (now - first) at the end
    since = F.col(period) - F.min(period).over(Window.partitionBy("row", "cell"))
    scaled = own.withColumn("__since", since)
    total = F.sum(F.col("count") * F.pow(F.lit(2.0), F.col("__since"))).over(Window.partitionBy("row", "cell").orderBy(period).rowsBetween(Window.unboundedPreceding, 0))
    return scaled.withColumn("count", total / F.pow(F.lit(2.0), F.col("__since"))).drop("__since")


def estimates(items: DataFrame, counts: DataFrame, item: str, depth: int = DEPTH, width: int = WIDTH, out: str = "estimate") -> DataFrame:
    """``items`` with ``out``: the least count of the item's cells, never below its true aged count.

    The distinct items' cells meet the sketch by (row, cell).
    """
    spread = items.select(item).where(F.col(item).isNotNull()).distinct().select(item, F.explode(cells(F.col(item), depth, width)).alias("c")).select(item, "c.row", "c.cell")
    found = spread.join(counts, ["row", "cell"], "left").groupBy(item).agg(F.min(F.coalesce("count", F.lit(0.0))).alias(out))
    return items.join(found, item, "left")


def admitted(cache: DataFrame, accesses: DataFrame, counts: DataFrame, capacity: int, item: str = "sha", used: str = "last_used", depth: int = DEPTH, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """The cache (item, used) after a period's accesses (item, used), and what became of each item that was asked for or cached.

    counts: the aged sketch with the period's accesses in it.  Items asked for are candidates unless cached, the most frequent
    first; room that is left takes the first of them.  Then the k-th candidate meets the k-th cached item in order of going (used longest
    ago first, unused ones of this period before used ones), and takes its place only if it was asked for more
    often, as both are estimated.  Ties go by the item.  No key's rows are in one task: places come from ``numbered``.

    outcome: hit, admitted, refused, kept, evicted (an item that was hit may be evicted afterwards, and is told as evicted).
    """
    asked = accesses.where(F.col(item).isNotNull()).groupBy(item).agg(F.max(used).alias("asked"))
    both = cache.select(item, F.col(used).alias("kept")).join(asked, item, "full_outer")
    told = stored(estimates(both, counts, item, depth, width))
    held = told.where("kept is not null").select(item, F.greatest("kept", "asked").alias(used), "estimate", F.col("asked").isNotNull().alias("hit"))
    fresh = told.where("kept is null").select(item, F.col("asked").alias(used), "estimate")
    n = held.count()
    room, over = max(0, capacity - n), max(0, n - capacity)
    candidates = numbered(fresh, [], [F.desc("estimate"), F.col(item)], "place")
    victims = numbered(held, [], [F.col(used), F.col(item)], "place")
    # places beyond the room meet the cached items in order
    pairs = candidates.where(F.col("place") >= room).withColumn("place", F.col("place") - room).select("place", F.col(item).alias("new"), F.col(used).alias("new_used"), F.col("estimate").alias("wanted"))
    # a cache that is over its capacity loses its first ones in any case
    met = joined(victims.withColumn("goes", F.col("place") < over).withColumn("place", F.col("place") - over), pairs, ["place"], "full_outer")
    wins = F.coalesce(F.col("wanted") > F.col("estimate"), F.lit(False))
    met = stored(met.withColumn("wins", wins))
    free_places = candidates.where(F.col("place") < room).select(item, used, F.lit("admitted").alias("outcome"))
    old = met.where(F.col(item).isNotNull()).select(item, used, F.when(F.col("wins") | F.col("goes"), "evicted").when(F.col("hit"), "hit").otherwise("kept").alias("outcome"))
    new = met.where(F.col("new").isNotNull()).select(F.col("new").alias(item), F.col("new_used").alias(used), F.when(F.col("wins"), "admitted").otherwise("refused").alias("outcome"))
    outcomes = stored(free_places.union(old).union(new))
    return outcomes.where(F.col("outcome").isin("admitted", "hit", "kept")).select(item, used), outcomes
