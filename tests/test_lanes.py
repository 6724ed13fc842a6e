"""Lanes of a stream against the batch twin, and deadlines by timers."""

import time

import pytest
from pyspark.sql import functions as F

from textloom.operators import batching
from textloom.streaming import lanes


@pytest.fixture(scope="module")
def store(spark):
    for k, v in lanes.STORE.items():
        spark.conf.set(k, v)
    yield
    for k in lanes.STORE:
        spark.conf.unset(k)


def table(spark, n, keys=("a", "b")):
    rows = [(k, i + 10_000 * j, (i * 7919) % 400, i) for j, k in enumerate(keys) for i in range(n)]
    return spark.createDataFrame(rows, "model string, item long, len int, t long").withColumn("arrived", F.timestamp_seconds("t")).drop("t")


def run(spark, df, tmp_path, name, until):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"cp-{name}")).start()
    end = time.monotonic() + 120
    try:
        while time.monotonic() < end and q.isActive and not until(q):
            time.sleep(0.3)
    finally:
        q.stop()
    assert q.exception() is None
    return spark.table(name).collect()


def test_lanes_equal_the_fold(spark, store, tmp_path):
    rows = table(spark, 120)
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    budget = batching.Budget(1500, 8, 350)
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    out = lanes.coalesced(stream, "model", "item", "len", "arrived", budget, wait_seconds=3600.0, lanes=3)
    got = run(spark, out, tmp_path, "lanes_fold", lambda q: any(p["numInputRows"] for p in q.recentProgress))
    packed = batching.packed(rows.withColumn("lane", lanes.lane(F.col("item"), 3)), ["model", "lane"], ["arrived", "item"], budget)
    want = {(r.model, r.lane, r.batch): (r.n, r.m, r.t, r.ids) for r in packed.groupBy("model", "lane", "batch").agg(F.count(F.lit(1)).alias("n"), F.max("len").alias("m"), F.sum("len").alias("t"), F.array_sort(F.collect_list("item")).alias("ids")).collect()}
    last = {k[:2]: max(b for m, lane, b in want if (m, lane) == k[:2]) for k in want}
    assert {(r.model, r.lane, r.batch): (r["items"], r.max_len, r.total, sorted(r.members)) for r in got} == {k: v for k, v in want.items() if k[2] != last[k[:2]]}
    assert {r.closed_by for r in got} == {"budget"} and len({r.lane for r in got}) == 3


def test_deadlines(spark, store, tmp_path):
    rows = table(spark, 9, ("a",))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    out = lanes.coalesced(stream, "model", "item", "len", "arrived", batching.Budget(10**6, 100, 10**6), wait_seconds=1.0, lanes=2)
    got = run(spark, out, tmp_path, "lanes_deadline", lambda q: spark.table("lanes_deadline").count() >= 2)
    assert {r.closed_by for r in got} == {"timeout"} and sorted(i for r in got for i in r.members) == list(range(9))
    assert all((r["items"], r.first, r.last) == (len(r.members), r.members[0], r.members[-1]) for r in got)
