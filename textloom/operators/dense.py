"""Dense embedding around the encoder: each distinct text once, cache first, back to positions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from textloom.functions.text import text_hash
from textloom.operators.ordering import stored

#: Ranges that are counted at once, and rows that are ordered at the end, where the limit of a cache is found.
PARTS, BAND = 1_000, 100_000


def positions(texts: DataFrame, keys: list[str], text_col: str, pos_col: str) -> DataFrame:
    """One row for each distinct text of a request: its hash, how often and where first it stands."""
    return texts.groupBy(*keys, text_hash(F.col(text_col)).alias("sha")).agg(F.count(F.lit(1)).alias("copies"), F.min(pos_col).alias("first_pos"))


def request_positions(requests: DataFrame, key: str, texts_col: str) -> DataFrame:
    """(key, sha, positions): where each distinct text stands in a request's list of texts, from 0, in order.

    A request's list is bounded by its cap, and so is each list of positions.
    """
    rows = requests.select(key, F.posexplode(texts_col).alias("pos", "text"))
    return rows.groupBy(key, text_hash(F.col("text")).alias("sha")).agg(F.array_sort(F.collect_list("pos")).alias("positions"))


def exact_usage(texts: DataFrame, cache: DataFrame, request: str, length: str, text_col: str = "text") -> DataFrame:
    """(request, tokens): lengths of each request's distinct texts that the cache (sha, ...) lacks; 0 where it has all.

    Only hashes and lengths are shuffled.
    """
    marked = partition(texts.select(request, length, text_col), cache, text_col)
    distinct = marked.groupBy(request, "sha").agg(F.max(F.when(~F.col("hit"), F.col(length))).alias("n"))
    return distinct.groupBy(request).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("tokens"))


def spliced(items: DataFrame, cache: DataFrame, compute: Callable[[DataFrame], DataFrame], value: str = "ids") -> DataFrame:
    """``items`` (sha, ..) with ``value`` and ``cached``: from the cache (sha, value) where it has the hash, the rest computed, each distinct item once.

    compute: gives a table of items its ``value`` column.  Order is the caller's: rows keep their own position columns.
    """
    known = cache.select("sha", F.col(value).alias("__v"), F.lit(True).alias("cached")).dropDuplicates(["sha"])
    fresh = compute(items.join(known.select("sha"), "sha", "left_anti").dropDuplicates(["sha"])).select("sha", F.col(value).alias("__v"), F.lit(False).alias("cached"))
    return items.join(known.unionByName(fresh), "sha").withColumnRenamed("__v", value)


def partition(texts: DataFrame, cache: DataFrame, text_col: str = "text") -> DataFrame:
    """``texts`` with sha and ``hit``: whether the cache (sha, ...) has it.  Only hashes are joined."""
    known = cache.select("sha").distinct().withColumn("__hit", F.lit(True))
    return texts.withColumn("sha", text_hash(F.col(text_col))).join(known, "sha", "left").withColumn("hit", F.coalesce("__hit", F.lit(False))).drop("__hit")


def embed(texts: DataFrame, encode: Callable[[Column], Column], cache: DataFrame | None = None, text_col: str = "text", out_col: str = "embedding") -> DataFrame:
    """``texts`` with their vectors: cached ones by join, each other distinct text encoded once, then joined to all its positions.

    Texts themselves are shuffled once, to find the distinct ones; vectors go back by hash.
    """
    hashed = texts.withColumn("sha", text_hash(F.col(text_col)))
    distinct = hashed.select("sha", text_col).dropDuplicates(["sha"])
    misses = distinct if cache is None else distinct.join(cache.select("sha"), "sha", "left_anti")
    vectors = misses.select("sha", encode(F.col(text_col)).alias(out_col))
    if cache is not None:
        vectors = vectors.unionByName(cache.select("sha", out_col))
    return hashed.join(vectors, "sha", "left")


def updated_cache(cache: DataFrame, used: DataFrame, capacity: int) -> DataFrame:
    """The cache after use: of (sha, ..., last_used) the ``capacity`` rows used last, ties by hash; 0 turns it off.

    ``last_used`` is a whole number.  Counts by ranges of time, and within one moment by the hash's beginning, narrow down
    where the limit falls, ``PARTS`` ranges at a time; only what is left there (at most ``BAND`` rows) is ordered.
    """
    rows = cache.unionByName(used)
    latest = stored(rows.groupBy("sha").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "sha"]), "last_used").alias("r")).select("sha", "r.*"))
    # smaller is kept first: time from the last on, then the hash's first 60 bits
    moment = -F.col("last_used").cast("long")
    place = F.conv(F.substring("sha", 1, 15), 16, 10).cast("long")
    kept, band, left = F.lit(False), F.lit(True), capacity
    for at in (moment, place):
        low, high = latest.where(band).agg(F.min(at), F.max(at)).first()
        while low is not None and high > low and left > 0:
            width = -(-(high - low + 1) // PARTS)
            counts = dict(latest.where(band & at.between(low, high)).groupBy(F.floor((at - F.lit(low)) / F.lit(width)).cast("int")).count().collect())
            before, part = 0, 0
            for part in sorted(counts):
                if before + counts[part] >= left:
                    break
                before += counts[part]
            else:
                part, before = part + 1, sum(counts.values())
            kept = kept | (band & (at < low + part * width))
            low, high, left = low + part * width, min(high, low + (part + 1) * width - 1), left - before
            if counts.get(part, 0) <= BAND:
                break
        if low is not None:
            band = band & at.between(low, high)
        if low is None or low < high or left <= 0:
            break  # few enough rows of several moments, which are ordered by both
    whole = latest.where(kept)
    return whole.union(latest.where(band & ~kept).orderBy(F.desc("last_used"), "sha").limit(max(left, 0)))


def mean_pooled(vectors: DataFrame, key: str, vector_col: str) -> DataFrame:
    """(key, pos, value): mean of a group's vectors place by place, scaled to unit length."""
    long = vectors.select(key, F.posexplode(vector_col).alias("pos", "v"))
    mean = long.groupBy(key, "pos").agg(F.avg(F.col("v").cast("double")).alias("mean"))
    size = mean.groupBy(key).agg(F.sqrt(F.sum(F.col("mean") * F.col("mean"))).alias("size"))
    return mean.join(size, key).select(key, "pos", F.when(F.col("size") > 0, F.col("mean") / F.col("size")).otherwise(F.col("mean")).alias("value"))
