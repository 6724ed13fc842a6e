"""Streams against their batch twins."""

import time

from pyspark.sql import functions as F

from textloom.operators import batching
from textloom.streaming import coalescer


def test_coalescer_equals_the_fold(spark, tmp_path):
    rows = [(k, i, (i * 7919) % 400, f"2024-01-01 00:00:{i // 100:02d}.{i % 100:02d}") for k in ("a", "b") for i in range(60)]
    table = spark.createDataFrame(rows, "model string, item long, len int, t string").withColumn("arrived", F.to_timestamp("t")).drop("t")
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    budget = batching.Budget(1500, 8, 350)
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    out = coalescer.coalesced(stream, "model", "item", "len", "arrived", budget, wait_seconds=3600.0)
    q = out.writeStream.format("memory").queryName("coalesced").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    # a query with timeouts of processing time never runs out of batches, so it's stopped once the file is read
    end = time.monotonic() + 90
    while time.monotonic() < end and not any(p["numInputRows"] for p in q.recentProgress):
        time.sleep(0.2)
    q.stop()
    got = {(r["model"], r["batch"]): (r["items"], r["first"], r["max_len"]) for r in spark.table("coalesced").collect()}
    packed = batching.packed(table, ["model"], ["item"], budget)
    want = {(r["model"], r["batch"]): (r["n"], r["f"], r["m"]) for r in packed.groupBy("model", "batch").agg(F.count(F.lit(1)).alias("n"), F.min("item").alias("f"), F.max("len").alias("m")).collect()}
    last = {m: max(b for k, b in want if k == m) for m in ("a", "b")}
    assert got == {k: v for k, v in want.items() if k[1] != last[k[0]]}


def test_liveness_equals_the_fold(spark, tmp_path):
    kinds = ["ok", "timeout", "error", "error", "error", "none", "error", "success", "timeout"]
    rows = [(w, float(i * 40), kinds[(i * 5 + len(w)) % len(kinds)]) for w in ("w", "ww") for i in range(50)]
    table = spark.createDataFrame(rows, "worker string, at double, result string")
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    q = coalescer.liveness(stream, "worker", "at", "result").writeStream.format("memory").queryName("liveness").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r["worker"], r["at"], r["label"], r["failures"]) for r in spark.table("liveness").collect())
    want = sorted((r["worker"], r["at"], r["label"], r["failures"]) for r in batching.heartbeats(table, ["worker"], ["at"]).collect())
    assert got == want and {"kill", "suppressed"} <= {x[2] for x in got}


def test_cache_writer(spark, tmp_path):
    write = coalescer.cache_writer(str(tmp_path / "cache"), 2)
    batch = lambda *rows: spark.createDataFrame(list(rows), "sha string, embedding array<double>, last_used long")
    write(batch(("a", [1.0], 1), ("b", [2.0], 2)), 0)
    write(batch(("a", [1.0], 3), ("c", [3.0], 4)), 1)
    write(batch(("a", [1.0], 3), ("c", [3.0], 4)), 1)
    assert {r["sha"] for r in spark.read.parquet(str(tmp_path / "cache" / "v=1")).collect()} == {"a", "c"}
