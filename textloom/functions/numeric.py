"""Numeric scalars: calibration, vectors, widths, memory estimates, ALiBi tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from textloom.functions.text import let

CLAMP = 50.0


def clamped(x: Column) -> Column:
    """Within +-CLAMP; NaN stays."""
    return F.when(F.isnan(x), x).otherwise(F.greatest(F.lit(-CLAMP), F.least(F.lit(CLAMP), x)))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-clamped(x)))


def calibrated(score: Column, normalize: Column) -> Column:
    """Probability, or the raw score where ``normalize`` is 'none'."""
    return F.when(F.coalesce(normalize, F.lit("sigmoid")) == "none", score).otherwise(sigmoid(score))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalised(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    scaled = lambda p: F.transform(p["v"], lambda x: F.when(p["n"] > 0, x / p["n"]).otherwise(x))
    return let(v, lambda w: let(F.struct(w.alias("v"), norm(w).alias("n")), scaled))


def masked_mean(tokens: Column, mask: Column, dims: int) -> Column:
    """Mean of the token vectors that the mask has, scaled to unit length; zeros if it has none."""
    real = F.transform(mask, lambda m: m.cast("double"))
    n = F.greatest(F.aggregate(real, F.lit(0.0), lambda s, m: s + m), F.lit(1.0))
    zero = F.array(*[F.lit(0.0)] * dims)
    weighted = F.zip_with(tokens, real, lambda v, m: F.transform(v, lambda x: x.cast("double") * m))
    return l2_normalised(F.aggregate(weighted, zero, lambda s, v: F.zip_with(s, v, lambda a, b: a + b), lambda s: F.transform(s, lambda x: x / n)))


def cosine(a: Column, b: Column, least: float = 1e-12) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(least)) * F.greatest(norm(b), F.lit(least)))


def sparse_weight(x: Column) -> Column:
    """ln(1 + x) of positive x, else 0."""
    return F.when(x > 0, F.log(F.lit(1.0) + x)).otherwise(F.lit(0.0))


def rounded_width(n: Column, cap: Column) -> Column:
    """Next power of two, capped; 1 for n <= 1."""
    return F.when(n <= 1, F.lit(1)).otherwise(F.least(cap, F.expr("1").cast("long") * F.pow(F.lit(2), F.char_length(F.bin((n - 1).cast("long")))).cast("long"))).cast("long")


def attention_bytes(batch: Column, heads: Column, width: Column) -> Column:
    """Bytes of one float32 score for each pair of places, head and row."""
    return batch.cast("double") * heads * width * width * 4


def heads_of(model: Column) -> Column:
    return F.when(F.contains(model, F.lit("e5-large")), 16).otherwise(12)


def batch_bucket(n: Column) -> Column:
    """Label of a batch size; none and over 16 are the last one."""
    return F.when((n < 1) | (n > 16), "32+").when(n <= 1, "1").when(n <= 2, "2").when(n <= 4, "4").when(n <= 8, "8").otherwise("16")


def width_bucket(n: Column) -> Column:
    return F.when(n <= 64, "64").when(n <= 128, "128").when(n <= 256, "256").when(n <= 384, "384").otherwise("512+")


def waste(padded_tokens: Column, real: Column) -> Column:
    """Share of padding, within 0 and 1; 0 where nothing was padded."""
    return F.when(padded_tokens == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (padded_tokens - real) / padded_tokens)))


def total_order_desc(v: Column) -> list[Column]:
    """Sort keys: NaN first, then descending, with 0.0 ahead of -0.0."""
    return [v.desc(), (v.cast("string") == "-0.0").asc()]


def alibi_slopes(spark: SparkSession, heads: int) -> DataFrame:
    """(head, slope): a geometric series; beyond a power of two, every other slope of the doubled series."""
    whole = 1 << (heads.bit_length() - 1)
    h = F.col("head")
    first = F.pow(F.lit(2.0), -(h + 1) * 8.0 / whole)
    more = F.pow(F.lit(2.0), -((h - whole) * 2 + 1) * 8.0 / (2 * whole))
    return spark.range(heads).select(F.col("id").cast("int").alias("head"), F.lit(1).alias("one")).select("head", F.when(h < whole, first).otherwise(more).alias("slope"))


def alibi_bias(spark: SparkSession, heads: int, width: int) -> DataFrame:
    """(head, i, j, bias): minus the slope times the distance."""
    i, j = (spark.range(width).select(F.col("id").cast("int").alias(c)) for c in "ij")
    grid = alibi_slopes(spark, heads).crossJoin(i).crossJoin(j)
    return grid.select("head", "i", "j", (-F.col("slope") * F.abs(F.col("i") - F.col("j"))).alias("bias"))


@F.pandas_udf(T.StringType())
def base64_floats(vectors: pd.Series) -> pd.Series:
    """Base64 of the vector's little-endian 32-bit floats."""
    import base64

    import numpy as np

    return vectors.map(lambda v: None if v is None else base64.b64encode(np.asarray(v, "<f4").tobytes()).decode())
