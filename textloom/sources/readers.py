"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.functions import classify
from textloom.operators import metrics, requests


def request_lines(spark: SparkSession, path: str, kind: str, default_model: str | None = None, stream: bool = False) -> DataFrame:
    """Requests of one kind from files of a JSON object a line, batch or stream."""
    reader = spark.readStream if stream else spark.read
    lines = reader.text(path).withColumnRenamed("value", "json")
    return requests.parsed(lines.where(F.trim("json") != ""), "json", kind, default_model)


def corpus_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files that aren't blank."""
    return spark.read.text(path).where(F.trim("value") != "")


def arena_extensions(spark: SparkSession, path: str) -> DataFrame:
    """(bin_num, total) of a runtime's log."""
    bins = spark.read.text(path).select(classify.extended_bin(F.col("value")).alias("bin_num")).where("bin_num IS NOT NULL")
    return metrics.counter(bins, ["bin_num"])


def static_shapes(files: DataFrame, name: str = "name") -> DataFrame:
    """(batch, file) of graphs with a fixed batch size, in order of size: an explicit number wins over the name without one, which means 1."""
    n = F.regexp_extract(name, r"^model_quantized_static_b([0-9]+)\.onnx$", 1).try_cast("int")
    plain = F.col(name) == "model_quantized_static.onnx"
    found = files.select(F.col(name).alias("file"), F.when(plain, 1).otherwise(n).alias("batch"), plain.alias("plain")).where("batch >= 1")
    return found.groupBy("batch").agg(F.min_by("file", F.struct("plain", "file")).alias("file")).orderBy("batch")


def routed(batches: DataFrame, shapes: DataFrame, size: str = "items") -> DataFrame:
    """Batches with the graph of exactly their size, or ``dynamic``."""
    fixed = shapes.select(F.col("batch").alias("__batch"), F.col("file").alias("__file"))
    return batches.join(fixed, F.col(size) == F.col("__batch"), "left").withColumn("route", F.coalesce("__file", F.lit("dynamic"))).drop("__batch", "__file")


def write_exposition(samples: DataFrame, path: str) -> None:
    samples.write.mode("overwrite").text(path)


def bench_lines(results: DataFrame, columns: list[str]) -> DataFrame:
    """``results`` as lines of a markdown table, without its head."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return results.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def write_bench_table(results: DataFrame, columns: list[str], path: str) -> None:
    """A markdown table in one file: a bench has a line for each scenario."""
    head = [f"| {' | '.join(columns)} |", "|" + "---|" * len(columns)]
    lines = bench_lines(results, columns).withColumn("part", F.lit(1))
    top = results.sparkSession.createDataFrame([(line, 0) for line in head], "line string, part int").withColumn("at", F.monotonically_increasing_id())
    whole = top.unionByName(lines.withColumn("at", F.xxhash64("line")))
    whole.coalesce(1).sortWithinPartitions("part", "at").select("line").write.mode("overwrite").text(path)


def write_bench(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)
