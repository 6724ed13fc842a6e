"""A cache of vectors kept by micro-batches, in which an update touches only the buckets of its keys.

Keys are dealt to buckets by hash.  A batch is written as one new version that holds a folder
for each bucket it touches: its rows alone, deletions marked, or, where a bucket has collected
``most`` versions, that bucket's rows merged.  A commit file then names each bucket's versions.
Data without a commit doesn't count: what a failed attempt left is deleted by the next one, and a micro-batch
that is repeated after its commit changes nothing.  One writer at a time, as a streaming query is.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from textloom.operators.ordering import deleted, numbered


class VectorLog:
    """path: a folder that all executors reach.  columns: DDL of the rows, with ``sha`` and ``last_used``."""

    def __init__(self, spark: SparkSession, path: str, columns: str = "sha string, embedding array<double>, last_used long", buckets: int = 64, most: int = 4):
        self.spark, self.path, self.buckets, self.most = spark, path.rstrip("/"), buckets, most
        self.schema = T.StructType.fromDDL(columns)
        jvm = spark._jvm
        self._hadoop = jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # ---- commits

    def _commits(self) -> list[int]:
        top = self._hadoop.Path(f"{self.path}/log")
        names = [s.getPath().getName() for s in self._fs.listStatus(top)] if self._fs.exists(top) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def _commit(self, version: int) -> dict:
        stream = self._fs.open(self._hadoop.Path(f"{self.path}/log/{version:08d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def state(self) -> dict:
        """The last commit: version, epoch, and the live versions of each bucket, oldest first."""
        commits = self._commits()
        return self._commit(commits[-1]) if commits else {"version": 0, "epoch": -1, "buckets": {}}

    def _publish(self, commit: dict) -> None:
        """Write the commit beside its place, then move it there: it is whole, or not there."""
        final = self._hadoop.Path(f"{self.path}/log/{commit['version']:08d}.json")
        draft = self._hadoop.Path(f"{self.path}/log/{commit['version']:08d}.draft")
        stream = self._fs.create(draft, True)
        stream.write(bytearray(json.dumps(commit, sort_keys=True).encode()))
        stream.close()
        if not self._fs.rename(draft, final):
            raise OSError(f"version {commit['version']} was committed by another writer")

    # ---- rows

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("sha"), F.lit(self.buckets)).cast("int")

    def _rows(self, buckets: dict[str, list[int]]) -> DataFrame:
        """The rows of the buckets' live versions, with bucket, v and deleted."""
        stored = T.StructType([*self.schema.fields, *T.StructType.fromDDL("deleted boolean, v long, bucket int").fields])
        paths = [f"{self.path}/data/v={v}/bucket={b}" for b, versions in buckets.items() for v in versions]
        if not paths:
            return self.spark.createDataFrame([], stored)
        return self.spark.read.schema(stored).option("basePath", f"{self.path}/data").parquet(*paths)

    def _latest(self, rows: DataFrame) -> DataFrame:
        """One row a key: that of the latest version, unless it is a deletion."""
        columns = [f.name for f in self.schema.fields]
        newest = rows.groupBy("bucket", "sha").agg(F.max_by(F.struct(*[c for c in columns if c != "sha"], "deleted"), "v").alias("r"))
        return newest.select("bucket", "sha", "r.*").where(~F.col("deleted")).select("bucket", *columns)

    def snapshot(self) -> DataFrame:
        """The cache as of the last commit."""
        return self._latest(self._rows(self.state()["buckets"])).drop("bucket")

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The cached rows of ``keys`` (sha): only their buckets are read."""
        live = self.state()["buckets"]
        wanted = {str(r[0]) for r in keys.select(self._bucket()).distinct().collect()}
        return self._latest(self._rows({b: v for b, v in live.items() if b in wanted})).drop("bucket").join(keys.select("sha").distinct(), "sha", "left_semi")

    def update(self, changes: DataFrame, epoch: int) -> list[int]:
        """Upsert rows (the columns, and ``deleted`` if any are deletions); of a key's rows in one batch the last used counts.

        Returns the buckets that were written; none for an epoch that is committed already.
        """
        before = self.state()
        if epoch <= before["epoch"]:
            return []
        version, columns = before["version"] + 1, [f.name for f in self.schema.fields]
        gone = F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in changes.columns else F.lit(False)
        one = changes.where(F.col("sha").isNotNull()).withColumn("deleted", gone).groupBy("sha").agg(F.max_by(F.struct(*[c for c in columns if c != "sha"], "deleted"), F.struct("last_used", ~F.col("deleted"))).alias("r"))
        rows = one.select("sha", "r.*").select(*columns, "deleted", self._bucket().alias("bucket"))
        touched = sorted(r[0] for r in rows.select("bucket").distinct().collect())
        live = before["buckets"]
        full = [b for b in touched if len(live.get(str(b), [])) >= self.most]
        parts = [rows.where(~F.col("bucket").isin(full)) if full else rows]
        if full:
            old = self._rows({str(b): live[str(b)] for b in full})
            new = rows.where(F.col("bucket").isin(full)).withColumn("v", F.lit(version).cast("long"))
            parts.append(self._latest(old.unionByName(new)).withColumn("deleted", F.lit(False)).select(*columns, "deleted", "bucket"))
        # what a failed attempt at this version left goes first
        deleted(self.spark, f"{self.path}/data/v={version}")
        if touched:
            whole = reduce(DataFrame.unionByName, parts)
            whole.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/v={version}")
        after = live | {str(b): [version] if b in full else [*live.get(str(b), []), version] for b in touched}
        # a merged bucket may have no row left, and then has no folder
        if full:
            kept = self._fs.listStatus(self._hadoop.Path(f"{self.path}/data/v={version}"))
            there = {s.getPath().getName().removeprefix("bucket=") for s in kept}
            after = {b: v for b, v in after.items() if v != [version] or b in there}
        self._publish({"version": version, "epoch": epoch, "buckets": after})
        return touched

    def trim(self, capacity: int, epoch: int) -> list[int]:
        """Delete all but the ``capacity`` keys used last, ties by hash; only their buckets are touched."""
        placed = numbered(self.snapshot().select("sha", "last_used"), [], [F.desc("last_used"), F.col("sha")], "place")
        out = placed.where(F.col("place") >= capacity).drop("place").withColumn("deleted", F.lit(True))
        for f in self.schema.fields:
            if f.name not in ("sha", "last_used"):
                out = out.withColumn(f.name, F.lit(None).cast(f.dataType))
        return self.update(out, epoch)

    def vacuum(self) -> list[int]:
        """Delete the folders of versions that the last commit names for no bucket; returns the versions."""
        used = {v for versions in self.state()["buckets"].values() for v in versions}
        top = self._hadoop.Path(f"{self.path}/data")
        found = [int(s.getPath().getName().removeprefix("v=")) for s in self._fs.listStatus(top)] if self._fs.exists(top) else []
        old = sorted(v for v in found if v not in used)
        for v in old:
            deleted(self.spark, f"{self.path}/data/v={v}")
        return old


def log_writer(log: VectorLog, capacity: int | None = None) -> Callable[[DataFrame, int], None]:
    """For ``writeStream.foreachBatch``: each micro-batch is one update, and with ``capacity`` one trim."""

    def write(batch: DataFrame, epoch: int) -> None:
        # two commits an epoch, each of which is passed over if it is there already
        log.update(batch, 2 * epoch)
        if capacity is not None:
            log.trim(capacity, 2 * epoch + 1)

    return write
