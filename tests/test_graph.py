"""Walks against plain loops, counters of jobs, and checks at joins."""

import re
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import graph, requests
from textloom.plans.catalog import QUERIES
from textloom.streaming.telemetry import Counters


@pytest.fixture(scope="module")
def edges():
    rng = np.random.default_rng(5)
    dag = {(int(a), int(b)) for a, b in rng.integers(0, 60, (110, 2)) if a < b}
    return sorted(dag), sorted(dag | {(70, 71), (71, 72), (72, 70), (72, 73), (59, 70)})


def table(spark, rows):
    return spark.createDataFrame([*rows, *rows[:5], (None, 1), (1, None)], "src int, dst int")


def depths(edges, starts):
    found, frontier = dict.fromkeys(starts, 0), set(starts)
    while frontier:
        frontier = {b for a, b in edges if a in frontier} - found.keys()
        found |= {b: max(found.values()) + 1 for b in frontier}
    return found


def test_reached(spark, edges):
    for rows in edges:
        for starts in ([0], [3, 71, 999], []):
            df = spark.createDataFrame([(s,) for s in starts] + [(None,)], "node int")
            assert {r.node: r.depth for r in graph.reached(table(spark, rows), df).collect()} == (depths(rows, starts) if starts else {})


def test_levels(spark, edges):
    for rows in edges:
        into = defaultdict(set)
        for a, b in rows:
            into[b].add(a)
        level, nodes = {}, {x for e in rows for x in e}
        while True:
            ready = {n for n in nodes - level.keys() if all(a in level for a in into[n])}
            if not ready:
                break
            level |= {n: max((level[a] + 1 for a in into[n]), default=0) for n in ready}
        want = {n: level.get(n) for n in nodes}
        assert {r.node: r.level for r in graph.levels(table(spark, rows)).collect()} == want


def test_orphans(spark, edges):
    rows = edges[1]
    out = defaultdict(set)
    for a, b in rows:
        out[a].add(b)
    for first in ([59], [40, 50, 55, 58, 59], [70], [1000]):
        gone = dict.fromkeys(first, 0)
        for turn in range(1, 99):
            more = {n for n in out if n not in gone and all(b in gone for b in out[n])}
            if not more:
                break
            gone |= dict.fromkeys(more, turn)
        df = spark.createDataFrame([(n,) for n in first], "node int")
        assert {r.node: r["round"] for r in graph.orphaned(table(spark, rows), df).collect()} == gone


def test_walk_over_pages(spark, small):
    links = defaultdict(set)
    pages = spark.read.parquet(f"{small}/pages.parquet").collect()
    for r in pages:
        for t in re.findall(r'<a [^>]*href="([^"]*)"', r.html or ""):
            links[r.page_id].add(t)
    first = min(r.page_id for r in pages)
    both = [(("p", p), ("l", t)) for p, ts in links.items() for t in ts]
    want = {n[1]: d // 2 for n, d in depths(both + [(b, a) for a, b in both], [("p", first)]).items() if n[0] == "p"}
    assert {r.page_id: r.depth for r in QUERIES["page_walk"](spark, small).collect()} == want and len(want) > 1


def test_counters_of_a_batch_job(spark, tmp_path):
    counters = Counters()
    rows = spark.range(1_000).withColumn("len", F.col("id") % 7)
    for k in range(2):
        before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
        watched = counters.watched(rows, "texts_total", n=F.count(F.lit(1)), tokens=F.sum("len"))
        watched.write.parquet(str(tmp_path / f"out{k}"))
        ran = set(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - set(before)
        counters.collect()
        # the counters cost no job of their own
        assert set(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - set(before) == ran
    want = spark.read.parquet(str(tmp_path / "out0")).agg(F.count(F.lit(1)), F.sum("len")).first()
    assert counters.collect() == {("texts_total", "n"): 2 * want[0], ("texts_total", "tokens"): 2 * want[1]}
    assert [r.value for r in counters.lines(spark).orderBy("value").collect()] == [f'texts_total{{counter="n"}} {2.0 * want[0]}', f'texts_total{{counter="tokens"}} {2.0 * want[1]}']


def test_counters_of_a_stream(spark, tmp_path):
    spark.range(900).repartition(3).write.parquet(str(tmp_path / "in"))
    counters = Counters()
    spark.streams.addListener(counters)
    try:
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = counters.watched(stream, "seen", n=F.count(F.lit(1)), sum=F.sum("id")).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        end = time.monotonic() + 30
        while time.monotonic() < end and counters.totals.get(("seen", "n")) != 900:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(counters)
    assert counters.collect() == {("seen", "n"): 900, ("seen", "sum"): sum(range(900))}


def test_a_wrong_number_of_results_fails(spark):
    asked = spark.createDataFrame([("a", 2), ("b", 1), ("c", 0)], "id string, n int")
    right = spark.createDataFrame([("a", 2), ("b", 1)], "id string, m long")
    assert {tuple(r) for r in requests.checked(asked, right, "id", "n", "m").collect()} == {("a", 2, 2), ("b", 1, 1), ("c", 0, None)}
    wrong = spark.createDataFrame([("a", 2), ("b", 3)], "id string, m long")
    assert {(r.id, r.error) for r in requests.counted(asked, wrong, "id", "n", "m").collect()} == {("a", None), ("b", "b: expected 1 results, got 3"), ("c", None)}
    with pytest.raises(Exception, match="b: expected 1 results, got 3"):
        requests.checked(asked, wrong, "id", "n", "m").collect()
    with pytest.raises(Exception, match="a: expected 2 results, got 0"):
        requests.checked(asked, wrong.where("id = 'x'"), "id", "n", "m").select("n").collect()
