"""Sparse term weights: threshold, best terms, parallel arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from textloom.functions.numeric import sparse_weight
from textloom.functions.text import let


def max_pooled(logits: DataFrame, keys: list[str], logit: str) -> DataFrame:
    """Largest ln(1 + logit) of each key over a sequence; what isn't positive counts as 0."""
    weight = F.when(F.col(logit) > 0, F.log(F.lit(1.0) + F.col(logit))).otherwise(F.lit(0.0))
    return logits.groupBy(*keys).agg(F.max(weight).alias("weight"))


def row_max_pooled(logits: Column, mask: Column) -> Column:
    """Largest ln(1 + logit) of each term over the places that the mask has, of an array of places' logits; nothing below 0."""
    weights = F.zip_with(logits, mask, lambda row, m: F.transform(row, lambda x: F.when((x > 0) & (m > 0), F.log(F.lit(1.0) + x)).otherwise(F.lit(0.0))))
    return F.aggregate(F.slice(weights, F.lit(2), F.greatest(F.size(weights) - 1, F.lit(0))), F.get(weights, F.lit(0)), lambda s, row: F.zip_with(s, row, lambda a, b: F.greatest(a, b)))


def row_terms(ids: Column) -> Column:
    """(term, weight) of each distinct id of an array, ln(1 + count), inside the row: a sort and the steps between its runs."""

    def runs(x: Column) -> Column:
        starts = F.filter(F.transform(x, lambda t, i: F.when((i == 0) | (t != F.get(x, i - 1)), i)), lambda i: i.isNotNull())

        def weighed(s: Column) -> Column:
            return F.transform(s, lambda at, k: F.struct(F.get(x, at).alias("term"), sparse_weight((F.coalesce(F.get(s, k + 1), F.size(x)) - at).cast("double")).alias("weight")))

        return let(starts, weighed)

    return let(F.array_sort(ids), runs)


def row_top_terms(terms: Column, k: int, least: float = 0.0) -> Column:
    """The ``k`` heaviest (term, weight) over ``least``, ties by term, in order."""
    keyed = F.transform(F.filter(terms, lambda p: p["weight"] > least), lambda p: F.struct((-p["weight"]).alias("w"), p["term"].alias("term")))
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda p: F.struct(p["term"].alias("term"), (-p["w"]).alias("weight")))


def top_terms(weights: DataFrame, key: str, k: int, least: float = 0.0) -> DataFrame:
    """The ``k`` heaviest terms over ``least`` of each text, ties by term, with ``rank`` from 1."""
    w = Window.partitionBy(key).orderBy(F.desc("weight"), F.asc("term"))
    return weights.where(F.col("weight") > least).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def unzipped(top: DataFrame, key: str, pairs: str) -> DataFrame:
    """(key, indices, values): a row's pairs as two arrays, in their order."""
    return top.select(key, F.transform(pairs, lambda x: x["term"]).alias("indices"), F.transform(pairs, lambda x: x["weight"]).alias("values"))


def truncated(pairs: Column, k: Column, least: Column) -> Column:
    """First ``k`` of the pairs over ``least``, their order kept."""
    return F.slice(F.filter(pairs, lambda p: p["weight"] > least), F.lit(1), k)
