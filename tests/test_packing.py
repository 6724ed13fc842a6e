"""Batches and sub-batches of whole keys against the fold, and against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import batching, ordering, packing

BUDGETS = [batching.Budget(900, 8, 250), batching.Budget(900, 7, 250, padded=False), batching.Budget(1500, 16, 400, length_ratio=1.5), batching.Budget(50, 1, 10), batching.Budget(10**9, 50, 10**9)]


@pytest.fixture(scope="module")
def items(spark):
    rng = np.random.default_rng(1)
    rows = [(k, i, None if rng.random() < 0.01 else int(rng.integers(0, 300)) if rng.random() < 0.9 else int(rng.integers(0, 5)), int(rng.integers(1, 4)) if rng.random() < 0.95 else 20, "clash") for k, n in (("hot", 700), (None, 90), ("one", 1), ("b", 33)) for i in rng.permutation(n).tolist()]
    return ordering.stored(spark.createDataFrame(rows, "source string, i long, len int, texts int, entry string").repartition(5))


def same(a, b):
    names = ["source", "i", "batch", "head", "carried", "reason"]
    assert sorted(map(str, a.select(names).collect())) == sorted(map(str, b.select(names).collect()))


@pytest.mark.parametrize("budget", BUDGETS)
@pytest.mark.parametrize("chunk", [10, 64])
def test_chunks_equal_the_fold(items, budget, chunk):
    whole = items.drop("entry").fillna(0, ["len"])
    same(packing.packed(whole, ["source"], ["i"], budget, chunk=chunk), batching.packed(whole, ["source"], ["i"], budget))


def test_texts_and_clashing_columns(items):
    both = {"texts": "texts", "total": "sum"}
    rows = items.withColumn("sum", F.coalesce("len", F.lit(0)) * F.col("texts")).withColumnsRenamed({"entry": "__pos"})
    for b in BUDGETS[:3]:
        same(packing.packed(rows, ["source"], ["i"], b, chunk=16, **both), batching.packed(rows.fillna(0, ["len"]), ["source"], ["i"], b, **both))
    assert packing.packed(rows.limit(0), ["source"], ["i"], BUDGETS[0]).count() == 0


def test_no_task_has_the_whole_key(spark, items):
    """The tables of a chunked key: rows go to groups by chunk, and only entries meet by key."""
    plan = packing.packed(items.drop("entry"), ["source"], ["i"], BUDGETS[0], chunk=64)._jdf.queryExecution().optimizedPlan().toString()
    by_key = [line for line in plan.splitlines() if "FlatMapGroupsInArrow" in line]
    assert len(by_key) == 3 and sum("__chunk" in line.split("(")[0] for line in by_key) == 2


def test_positions(spark):
    rows = spark.range(20_000).select((F.col("id") * 7919 % 20_000).alias("v"), F.when(F.col("id") % 3 == 0, "x").when(F.col("id") % 3 == 1, "y").alias("k"))
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = ordering.numbered(rows, ["k"], [F.desc("v")]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for k in ("x", "y", None):
        ours = sorted((r for r in got if r.k == k), key=lambda r: r.pos)
        assert [r.pos for r in ours] == list(range(len(ours))) and all(a.v > b.v for a, b in zip(ours, ours[1:], strict=False))
    assert len(got) == 20_000


def plan(lens, ratio):
    """Groups by a loop over a request's lengths, longest first."""
    out, group, widest = {}, -1, None
    for n, i in sorted((-max(n or 1, 1), i) for i, n in lens):
        n = np.float32(-n)
        if widest is None or widest / n > np.float32(ratio):
            group, widest = group + 1, n
        out[i] = group
    return out


@pytest.mark.parametrize("ratio", [2.0, 1.1, 1.5, 7.3, 1.0001])
def test_groups_of_like_length(spark, ratio):
    rng = np.random.default_rng(4)
    rows = [(k, i, None if i == 3 else int(x)) for k, top, n in (("hot", 5_000, 900), (None, 40, 50), ("same", 1, 9), ("huge", 16_000_000, 60)) for i, x in enumerate(rng.integers(0, top, n))]
    rows += [("edge", i, x) for i, x in enumerate([1, 2, 4, 8, 3, 6, 12, 24, 7, 14, 28, 0])]
    got = packing.length_groups(spark.createDataFrame(rows, "k string, i int, len long"), ["k"], ratio=ratio).collect()
    for key in {k for k, _, _ in rows}:
        want = plan([(i, n) for k, i, n in rows if k == key], ratio)
        assert {r.i: r.group for r in got if r.k == key} == want


def test_one_group(spark):
    rows = spark.createDataFrame([("a", 5), ("a", 500)], "k string, len int")
    for ratio in (1.0, 0.0, float("nan")):
        assert {r.group for r in packing.length_groups(rows, ["k"], ratio=ratio).collect()} == {0}
    assert packing.length_groups(rows.limit(0), ["k"]).count() == 0
