"""Tables in the shared folder, and positions in an order for keys of any size."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

_cleaned: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in a local session without it one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        from pathlib import Path
        from tempfile import gettempdir

        base = Path(gettempdir(), "textloom-checkpoints").as_uri()
    return f"{base.rstrip('/')}/textloom-tables-{spark.sparkContext.applicationId}"


def deleted(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system, if the session still runs."""
    jvm = spark._jvm
    if jvm is None or spark.sparkContext._jsc is None:
        return
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: lineage ends there, and what was random stays as it was written."""
    spark = df.sparkSession
    top = shared_dir(spark)
    path = f"{top}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if top not in _cleaned:
        _cleaned.add(top)
        import atexit

        atexit.register(deleted, spark, top)
    return spark.read.schema(df.schema).parquet(path)


def free(columns: list[str], *names: str) -> list[str]:
    """The names, made longer until no column has them."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """An equi-join in which a null key meets a null key; the right side's key columns go."""
    theirs = free([*left.columns, *right.columns], *[f"__r_{c}" for c in on])
    renamed = right.select(*[F.col(c).alias(t) for c, t in zip(on, theirs, strict=True)], *[c for c in right.columns if c not in on])
    same = [left[c].eqNullSafe(renamed[t]) for c, t in zip(on, theirs, strict=True)]
    return left.join(renamed, same, how).drop(*theirs)


def numbered(rows: DataFrame, keys: list[str], order: list[str | Column], pos: str = "pos") -> DataFrame:
    """``rows`` with ``pos`` (long, from 0): the place of each row among its key's in the given order.

    Rows are dealt by ranges of (keys, order), so that a key of any size is many tasks' work; a task counts
    its rows of each key, and only these counts are added up by key.  Ties keep one order, as it is stored.  Null keys
    are one key.
    """
    by = [*map(F.col, keys), *[F.col(c) if isinstance(c, str) else c for c in order]]
    at, part, first, n = free(rows.columns, "__at", "__part", "__first", "__n")
    # ids grow along the ranges: the task's number above 33 bits, the row's place in the task below
    tagged = stored(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(at, F.monotonically_increasing_id())).withColumn(part, F.shiftright(at, 33))
    runs = tagged.groupBy(*keys, part).agg(F.min(at).alias(first), F.count(F.lit(1)).alias(n))
    before = F.sum(n).over(Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    starts = runs.select(*keys, part, (F.col(first) - F.coalesce(before, F.lit(0))).alias(first))
    return joined(tagged, starts, [*keys, part]).withColumn(pos, F.col(at) - F.col(first)).drop(at, part, first)
