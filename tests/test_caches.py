"""Sketches against exact counts, admission against a plain loop, and the cache that is kept by buckets."""

import hashlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import frequency
from textloom.plans.catalog import QUERIES
from textloom.streaming.vector_log import VectorLog, log_writer


def places(item, depth=frequency.DEPTH, width=frequency.WIDTH):
    return [(k, int(hashlib.md5(f"{k}:{item}".encode()).hexdigest()[:12], 16) % width) for k in range(depth)]


@pytest.fixture(scope="module")
def accesses():
    rng = np.random.default_rng(2)
    return [(int(p), f"i{int(x)}") for p in range(6) for x in rng.zipf(1.4, 400) % 300 if p != 3]


def test_estimates_are_bounded(spark, accesses):
    depth, width = 4, 128
    df = spark.createDataFrame(accesses + [(0, None)], "period long, item string")
    true, last = Counter(), 5
    for p, i in accesses:
        true[i] += 0.5 ** (last - p)
    counts = frequency.by_period(df, "item", "period", depth, width)
    # by halving step by step, and by weights at once
    step = None
    for p in range(6):
        own = frequency.sketch(df.where(F.col("period") == p), "item", depth=depth, width=width)
        step = own if step is None else frequency.merged(frequency.aged(step), own)
    asked = spark.createDataFrame([(i,) for i in true], "item string")
    est = {r.item: r.estimate for r in frequency.estimates(asked, step, "item", depth, width).collect()}
    cells = Counter()
    for i, n in true.items():
        for c in places(i, depth, width):
            cells[c] += n
    assert est == pytest.approx({i: min(cells[c] for c in places(i, depth, width)) for i in true})
    # never too low, and rarely more than e / width of the total too high
    over = [est[i] - n for i, n in true.items()]
    assert min(over) >= -1e-9
    assert np.mean(np.array(over) > np.e / width * sum(true.values())) <= np.exp(-depth) * 2
    at_end = {(r["row"], r["cell"]): r["count"] for r in counts.where("period = 5").collect()}
    assert at_end == pytest.approx({k: v for k, v in cells.items() if k in at_end})
    assert frequency.estimates(spark.createDataFrame([("never",), (None,)], "item string"), step, "item", depth, 1 << 30).where("estimate > 0").count() == 0


def admission(cache, asked, estimate, capacity):
    """One period by a loop: cache and asked are {item: last use}."""
    held = {i: max(t, asked.get(i, t)) for i, t in cache.items()}
    fresh = sorted((i for i in asked if i not in cache), key=lambda i: (-estimate[i], i))
    order = sorted(held, key=lambda i: (held[i], i))
    room, over = max(0, capacity - len(held)), max(0, len(held) - capacity)
    outcome = {i: "evicted" for i in order[:over]} | {i: "admitted" for i in fresh[:room]} | {i: "refused" for i in fresh[room:]}
    for i in order[over:]:
        outcome[i] = "hit" if i in asked else "kept"
    for new, old in zip(fresh[room:], order[over:], strict=False):
        if estimate[new] > estimate[old]:
            outcome[new], outcome[old] = "admitted", "evicted"
    return {i: held.get(i, asked.get(i)) for i, o in outcome.items() if o in ("hit", "kept", "admitted")}, outcome


@pytest.mark.parametrize("capacity", [0, 3, 40, 1_000])
def test_admission(spark, accesses, capacity):
    cache, asked, want = spark.createDataFrame([], "sha string, last_used long"), [], {}
    counts, cells = None, Counter()
    for p in range(3):
        own = [(i, p * 1_000 + k) for k, (q, i) in enumerate(accesses) if q == p]
        df = spark.createDataFrame(own, "sha string, last_used long")
        counts = frequency.sketch(df, "sha") if counts is None else frequency.merged(frequency.aged(counts), frequency.sketch(df, "sha"))
        cells = Counter({c: n / 2 for c, n in cells.items()})
        for i, _ in own:
            cells.update(places(i))
        asked = {i: max(t for j, t in own if j == i) for i, _ in own}
        estimate = {i: min(cells[c] for c in places(i)) for i in {*asked, *want}}
        limit = capacity if p < 2 else capacity // 2
        cache, outcomes = frequency.admitted(cache, df, counts, limit)
        want, told = admission(want, asked, estimate, limit)
        assert {r.sha: r.outcome for r in outcomes.collect()} == told
        assert {r.sha: r.last_used for r in cache.collect()} == want and len(want) <= limit


def test_admission_query(spark, small):
    rows = QUERIES["cache_admission"](spark, small).collect()
    events = spark.read.parquet(f"{small}/events.parquet").select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("i"), F.datediff("ts", F.lit("2020-01-01").cast("date")).alias("day")).collect()
    cells, cache, want = Counter(), {}, set()
    for week in sorted({e.day // 7 for e in events}):
        cells = Counter({c: n / 2 for c, n in cells.items()})
        asked = {}
        for e in events:
            if e.day // 7 == week:
                asked[e.i] = max(asked.get(e.i, 0), e.day)
                cells.update(places(e.i))
        cache, told = admission(cache, asked, {i: min(cells[c] for c in places(i)) for i in {*asked, *cache}}, 200)
        want |= {(week, i, o) for i, o in told.items()}
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)


# ---------------------------------------------------------------- the log


COLUMNS = "sha string, embedding array<double>, last_used long"


def batch(spark, *rows):
    return spark.createDataFrame([(*r, False)[:4] if len(r) < 4 else r for r in rows], COLUMNS + ", deleted boolean")


def written(path, version):
    return {int(p.name.removeprefix("bucket=")) for p in Path(path, "data", f"v={version}").glob("bucket=*")}


def content(log):
    return {r.sha: (r.embedding, r.last_used) for r in log.snapshot().collect()}


def test_updates_touch_their_buckets_only(spark, tmp_path):
    log = VectorLog(spark, str(tmp_path), buckets=32, most=3)
    want = {f"k{i}": ([float(i)], i) for i in range(200)}
    log.update(batch(spark, *[(k, *v) for k, v in want.items()]), 0)
    assert len(written(tmp_path, 1)) == 32 and content(log) == want
    for epoch in range(1, 9):
        change = {f"k{i}": ([float(-epoch)], 1_000 * epoch + i) for i in (3, 7, 150)} | {f"new{epoch}": ([0.5], 9)}
        want |= change
        touched = log.update(batch(spark, *[(k, *v) for k, v in change.items()]), epoch)
        assert 0 < len(touched) <= len(change) and set(touched) == written(tmp_path, epoch + 1)
        assert content(log) == want
    assert max(map(len, log.state()["buckets"].values())) <= 4
    assert {r.sha for r in log.lookup(spark.createDataFrame([("k3",), ("none",), ("k9",)], "sha string")).collect()} == {"k3", "k9"}
    gone = log.vacuum()
    assert 1 not in gone and content(log) == want


def test_deletions_and_merged_buckets(spark, tmp_path):
    log = VectorLog(spark, str(tmp_path), buckets=1, most=1)
    log.update(batch(spark, ("a", [1.0], 1), ("b", [2.0], 2), ("a", [3.0], 5)), 0)
    assert content(log) == {"a": ([3.0], 5), "b": ([2.0], 2)}
    log.update(batch(spark, ("a", None, 6, True)), 1)
    assert content(log) == {"b": ([2.0], 2)} and log.state()["buckets"] == {"0": [2]}
    log.update(batch(spark, ("b", None, 7, True)), 2)
    assert content(log) == {} and log.state()["buckets"] == {}
    log.update(batch(spark, ("b", [4.0], 8)), 3)
    assert content(log) == {"b": ([4.0], 8)} and log.update(batch(spark).limit(0), 4) == []
    assert set(log.vacuum()) == {1, 2, 3}


def test_a_failed_write_and_a_repeated_epoch(spark, tmp_path):
    log = VectorLog(spark, str(tmp_path), buckets=4)
    log.update(batch(spark, ("a", [1.0], 1)), 0)
    broken = batch(spark, ("a", [2.0], 2), ("c", [2.0], 2)).withColumn("embedding", F.when(F.col("sha") == "c", F.raise_error(F.lit("lost")).cast("array<double>")).otherwise(F.col("embedding")))
    with pytest.raises(Exception, match="lost"):
        log.update(broken, 1)
    # data without a commit, as a writer that is lost before its commit leaves it
    log._publish, publish = (lambda commit: (_ for _ in ()).throw(OSError("lost"))), log._publish
    with pytest.raises(OSError, match="lost"):
        log.update(batch(spark, ("a", [9.0], 9), ("z", [9.0], 9)), 1)
    log._publish = publish
    assert content(log) == {"a": ([1.0], 1)} and written(tmp_path, 2)
    again = VectorLog(spark, str(tmp_path), buckets=4)
    assert again.update(batch(spark, ("b", [3.0], 3)), 1) and content(again) == {"a": ([1.0], 1), "b": ([3.0], 3)}
    assert again.update(batch(spark, ("b", [7.0], 7)), 1) == [] and content(again)["b"] == ([3.0], 3)


def test_stream_with_a_limit(spark, tmp_path):
    rows = [(f"k{i % 30}", [float(i)], i) for i in range(90)]
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(str(tmp_path / "in"))
    log = VectorLog(spark, str(tmp_path / "log"), buckets=8, most=2)
    stream = spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream.writeStream.foreachBatch(log_writer(log, 10)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert len(content(log)) == 10 and {r for _, r in content(log).values()} <= set(range(90))
    assert log.state()["epoch"] == 5
