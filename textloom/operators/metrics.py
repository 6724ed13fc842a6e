"""Telemetry over event tables: counters, gauges, histograms, running totals, percentiles, exposition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

_SECONDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0)
#: Upper bounds of histogram buckets, by the ends of series' names (a full name counts first).
LADDERS = {
    "_duration_seconds": _SECONDS,
    "batch_size": (1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0, 128.0),
    "embed_batch_wait_ms": (1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0, 1000.0, 5000.0),
    "padding_waste_ratio": (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0),
    "embed_subbatch_groups": (1.0, 2.0, 3.0, 4.0, 6.0, 8.0, 12.0, 16.0, 32.0),
    "embed_batch_tokens": (128.0, 256.0, 512.0, 1024.0, 2048.0, 4096.0, 8192.0, 16384.0),
    "embed_texts_per_request": (1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0, 128.0, 256.0, 512.0, 1024.0),
    "embed_rerank_pairs_per_request": (1.0, 5.0, 10.0, 15.0, 20.0, 30.0, 50.0, 100.0),
    "embed_batch_token_budget": (1000.0, 4000.0, 16000.0, 64000.0, 128000.0, 256000.0, 1000000.0, 4000000.0),
    "embed_inference_attention_scratch_bytes": (1048576.0, 16777216.0, 67108864.0, 268435456.0, 1073741824.0, 4294967296.0),
    "embed_inference_peak_bytes": (16777216.0, 67108864.0, 268435456.0, 536870912.0, 1073741824.0, 2147483648.0, 4294967296.0, 8589934592.0),
    "embed_batch_max_effective_seq": (1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0, 128.0, 256.0, 512.0),
    "embed_input_array_size": (1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0, 128.0, 256.0, 512.0),
    "embed_rerank_input_docs_size": (1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0, 128.0, 256.0, 512.0),
}


def ladder(series: str) -> tuple[float, ...]:
    """Bucket bounds of a series: those of its name, or of the longest end that it has."""
    ends = [e for e in LADDERS if series.endswith(e)]
    return LADDERS[max(ends, key=len)] if ends else _SECONDS


def counter(events: DataFrame, labels: list[str], value: Column | None = None) -> DataFrame:
    return events.groupBy(*labels).agg(F.sum(F.lit(1).cast("long") if value is None else value).alias("total"))


def gauge(events: DataFrame, labels: list[str], value: str, order: list[str]) -> DataFrame:
    """The last value by labels."""
    return events.groupBy(*labels).agg(F.max_by(value, F.struct(*order)).alias("value"))


def histogram(events: DataFrame, labels: list[str], value: str, bounds: tuple[float, ...]) -> DataFrame:
    """(labels, le, count, sum, n): cumulative counts at each bound and +Inf.  One aggregation; the buckets are unfolded after it."""
    counts = [F.count_if(F.col(value) <= b).alias(f"b{k}") for k, b in enumerate(bounds)]
    total = events.groupBy(*labels).agg(*counts, F.count(value).alias("n"), F.sum(value).alias("sum"))
    rows = [F.struct(F.lit(f"{b:g}").alias("le"), F.col(f"b{k}").alias("count")) for k, b in enumerate(bounds)]
    rows.append(F.struct(F.lit("+Inf").alias("le"), F.col("n").alias("count")))
    return total.select(*labels, "n", "sum", F.explode(F.array(*rows)).alias("r")).select(*labels, "r.le", "r.count", "n", "sum")


def histograms(events: DataFrame, series: str, value: str, ladders: dict[str, tuple[float, ...]]) -> DataFrame:
    """(series, le, count, n, sum): each series' cumulative counts at its own bounds and +Inf, of all series in one pass and one aggregation.

    Rows of a series without a ladder are left out.
    """
    bounds = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, map(float, x))) for kv in ladders.items() for x in kv])
    mine = F.element_at(bounds, F.col(series))
    # a value falls in one bucket, the first whose bound it doesn't pass; cumulative counts are of buckets, not of rows
    bucket = F.when(F.col(value).isNotNull(), F.aggregate(mine, F.lit(0), lambda n, b: n + (F.col(value) > b).cast("int")))
    counts = events.withColumn("__bounds", mine).where("__bounds is not null").groupBy(series, bucket.alias("__bucket")).agg(F.count(F.lit(1)).alias("c"), F.sum(value).alias("s"))
    whole = counts.groupBy(series).agg(F.map_from_entries(F.collect_list(F.when(F.col("__bucket").isNotNull(), F.struct("__bucket", "c")))).alias("by"), F.coalesce(F.sum(F.when(F.col("__bucket").isNotNull(), F.col("c"))), F.lit(0)).alias("n"), F.sum("s").alias("sum"))
    rungs = [(name, k, f"{b:g}") for name, steps in ladders.items() for k, b in enumerate(steps)] + [(name, len(steps), "+Inf") for name, steps in ladders.items()]
    rung = events.sparkSession.createDataFrame(rungs, f"`{series}` string, k int, le string")
    up_to = F.aggregate(F.sequence(F.lit(0), F.col("k")), F.lit(0).cast("long"), lambda n, i: n + F.coalesce(F.element_at("by", i), F.lit(0).cast("long")))
    return whole.join(F.broadcast(rung), series).select(series, "le", up_to.alias("count"), "n", "sum")


def running_total(events: DataFrame, keys: list[str], order: list[str], delta: str, slice_of: Column) -> DataFrame:
    """``events`` with ``running``: the sum of ``delta`` up to the row in its key's order.

    Rows are summed within slices (``slice_of`` grows with the order, e.g. the hour) and slices' totals ahead are added, so a key's rows aren't sorted in one task.
    """
    sliced = events.withColumn("__slice", slice_of)
    totals = sliced.groupBy(*keys, "__slice").agg(F.sum(delta).alias("__sum"))
    before = totals.withColumn("__before", F.coalesce(F.sum("__sum").over(Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__sum")
    w = Window.partitionBy(*keys, "__slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return sliced.join(before, [*keys, "__slice"]).withColumn("running", F.sum(delta).over(w) + F.col("__before")).drop("__slice", "__before")


def latency_summary(rows: DataFrame, keys: list[str], value: str, width: float = 1.0, shares: tuple[tuple[str, float], ...] = (("p50", 0.5), ("p90", 0.9), ("p99", 0.99))) -> DataFrame:
    """Count, mean, worst and percentiles by the rule index = int(n x p) into the sorted values.

    Exact without sorting a key's rows in one task: values are counted in buckets of ``width``, the bucket that holds the index is found from
    the counts, and only that bucket's values are ordered.
    """
    bucketed = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"), F.floor(F.col(value) / width).alias("__b"))
    counts = bucketed.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__c"), F.sum("__v").alias("__s"), F.max("__v").alias("__m"))
    w = Window.partitionBy(*keys)
    upto = counts.withColumn("__n", F.sum("__c").over(w)).withColumn("__before", F.sum("__c").over(w.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__c"))
    places = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.greatest(F.lit(0), F.least(F.col("__n") - 1, F.floor(F.col("__n") * p))).alias("at")) for name, p in shares]))
    wanted = upto.withColumn("__p", places).where((F.col("__p.at") >= F.col("__before")) & (F.col("__p.at") < F.col("__before") + F.col("__c")))
    inside = bucketed.join(wanted.select(*keys, "__b", "__before", "__p"), [*keys, "__b"])
    row = F.row_number().over(Window.partitionBy(*keys, "__b", "__p.name").orderBy("__v")) - 1 + F.col("__before")
    found = inside.withColumn("__row", row).where(F.col("__row") == F.col("__p.at")).groupBy(*keys).agg(*[F.max(F.when(F.col("__p.name") == name, F.col("__v"))).alias(name) for name, _ in shares])
    whole = counts.groupBy(*keys).agg(F.sum("__c").alias("n"), (F.sum("__s") / F.sum("__c")).alias("mean"), F.max("__m").alias("worst"))
    return whole.join(found, keys)


def exposition(samples: DataFrame, name: Column, labels: list[str], value: Column) -> DataFrame:
    """One text line a sample: name{label="value",..} value."""
    escaped = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    inside = F.concat_ws(",", *[F.concat(F.lit(f'{c}="'), escaped(c), F.lit('"')) for c in labels])
    return samples.select(F.concat(name, F.when(F.lit(bool(labels)), F.concat(F.lit("{"), inside, F.lit("}"))).otherwise(F.lit("")), F.lit(" "), value.cast("string")).alias("value"))
