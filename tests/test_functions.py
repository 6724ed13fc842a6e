"""Literal cases of the scalar functions and the small operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions import classify, config, numeric, text
from textloom.operators import batching, dense, encoders, metrics, requests, rerank, sparse
from textloom.sources import readers


def one(spark, column, **values):
    schema = ", ".join(f"{k} {t}" for k, (_, t) in values.items()) or "x int"
    row = tuple(v for v, _ in values.values()) or (1,)
    return spark.createDataFrame([row], schema).select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(("n", "cap", "want"), [(0, 256, 1), (1, 256, 1), (3, 256, 4), (5, 256, 8), (9, 256, 16), (17, 256, 32), (65, 256, 128), (200, 256, 256), (200, 200, 200), (257, 256, 256), (150, 300, 256), (250, 300, 256), (257, 300, 300)])
def test_rounded_width(spark, n, cap, want):
    assert one(spark, numeric.rounded_width(F.col("n"), F.col("cap")), n=(n, "long"), cap=(cap, "long")) == want


def test_sigmoid(spark):
    rows = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 1.0, -100.0, 100.0, math.nan)], "x double").select(numeric.sigmoid(F.col("x"))).collect()
    got = [r[0] for r in rows]
    assert got[:3] == pytest.approx([0.2689414, 0.5, 0.7310586]) and 0 <= got[3] < got[4] <= 1 and math.isnan(got[5])
    assert one(spark, numeric.calibrated(F.col("x"), F.lit("none")), x=(-15.0, "double")) == -15.0


@pytest.mark.parametrize(("scores", "top_n", "want"), [([1.0, 5.0, 3.0, 2.0], 2, [1, 2]), ([0.1, 0.9, 0.5], None, [1, 2, 0]), ([1.0, 2.0, 3.0], 0, []), ([1.0, 2.0], 10, [1, 0]), ([2.0, 2.0, math.nan], None, [2, 0, 1]), ([-0.0, 0.0], None, [1, 0])])
def test_ranking(spark, scores, top_n, want):
    rows = spark.createDataFrame([("q", i, s) for i, s in enumerate(scores)], "q string, i int, s double")
    assert [r["i"] for r in rerank.ranked(rows, ["q"], "s", "i", top_n).orderBy("rank").collect()] == want


@pytest.mark.parametrize(("lens", "ratio", "want"), [
    ([500, 10], 2.0, [[0], [1]]), ([200, 120], 2.0, [[0, 1]]), ([200, 100], 2.0, [[0, 1]]), ([201, 100], 2.0, [[0], [1]]), ([500, 10, 300], 1.0, [[0, 1, 2]]), ([500, 10, 300], math.nan, [[0, 1, 2]]),
    ([100] * 4, 2.0, [[0, 1, 2, 3]]), ([0, 0, 5], 2.0, [[2], [0, 1]]), ([], 2.0, []), ([10, 500, 60], 2.0, [[1], [2], [0]]),
])
def test_sub_batches(spark, lens, ratio, want):
    got = one(spark, batching.sub_batches(F.col("lens"), F.col("ratio")), lens=(lens, "array<int>"), ratio=(ratio, "double"))
    groups = {}
    for x in got:
        groups.setdefault(x["group"], []).append(x["pos"])
    assert [sorted(groups[g]) for g in sorted(groups)] == want


def test_packing(spark):
    def pack(queue, **limits):
        rows = spark.createDataFrame([("k", i, n, t) for i, (n, t) in enumerate(queue)], "k string, i int, len int, texts int")
        return [r["batch"] for r in batching.packed(rows, ["k"], ["i"], batching.Budget(**limits), texts="texts").orderBy("i").collect()]

    assert pack([(500, 1), (50, 1)], tokens=1000, items=32, longest=1000) == [1, 2]
    assert pack([(500, 1), (499, 1)], tokens=1000, items=32, longest=1000, padded=False) == [1, 1]
    assert pack([(500, 1), (500, 1)], tokens=1000, items=32, longest=1000, padded=False) == [1, 2]
    assert pack([(5, 1)] * 3, tokens=1000, items=2, longest=1000) == [1, 1, 2]
    assert pack([(500, 1)] + [(50, 1)] * 10, tokens=1000, items=32, longest=1000) == [1] + [2] * 10
    assert pack([(5, 3), (5, 2)], tokens=1000, items=4, longest=1000) == [1, 2]
    assert pack([(10, 1), (16, 1)], tokens=1000, items=4, longest=1000, length_ratio=1.5) == [1, 2]


def test_buckets(spark):
    sizes = spark.createDataFrame([(n,) for n in (0, 1, 2, 3, 4, 5, 8, 9, 16, 17, 32, 100)], "n int").select(numeric.batch_bucket(F.col("n"))).collect()
    assert [r[0] for r in sizes] == ["32+", "1", "2", "4", "4", "8", "8", "16", "16", "32+", "32+", "32+"]
    widths = spark.createDataFrame([(n,) for n in (0, 64, 65, 128, 129, 256, 257, 384, 385, 512, 1024)], "n int").select(numeric.width_bucket(F.col("n"))).collect()
    assert [r[0] for r in widths] == ["64", "64", "128", "128", "256", "256", "384", "384", "512+", "512+", "512+"]
    assert one(spark, numeric.attention_bytes(F.lit(8), F.lit(12), F.lit(512))) == 100_663_296


def test_settings(spark):
    ratio = [r[0] for r in spark.createDataFrame([(s,) for s in (None, "", "two", "-1", "inf", "NaN", " 3.5 ", "0")], "s string").select(config.ratio_or(F.col("s"))).collect()]
    assert ratio == [2.0] * 6 + [3.5, 0.0]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in (None, "", "max", "MAX", "0", "x", "64")], "s string").select(config.warm_up_length(F.col("s"))).collect()]
    assert got == [128, 128, None, None, 128, 128, 64]
    assert one(spark, config.reranker_spec(F.col("s")), s=("r:/m:512:true", "string"))["valid"] and not one(spark, config.reranker_spec(F.col("s")), s=("r:/m:512", "string"))["valid"]
    assert one(spark, config.sparse_spec(F.col("s")), s=("s:/m:512", "string"))["max_len"] == 512
    assert [tuple(x) for x in one(spark, config.scenarios(F.col("s")), s=("1x20, 4x10", "string"))] == [(1, 20), (4, 10)]
    assert one(spark, config.semaphore_cap(F.col("s"), F.lit(1), F.lit(2)), s=("0", "string")) is None
    assert one(spark, config.cached_graph_path(F.lit("m"), F.lit(12))) == "m.12.optimized.onnx"
    assert one(spark, config.cache_decision(F.lit(True), F.lit(1), F.lit(False))) == "miss"
    assert one(spark, config.ratio_threshold(F.col("s")), s=("-1", "string")) is None
    assert one(spark, config.seconds_or(F.col("s"), 30.0), s=("0", "string")) == 30.0
    assert one(spark, config.shrinks_arena(F.lit(None).cast("boolean"), F.lit(False))) is True
    assert one(spark, classify.dispatch_status(F.lit("timeout"), 0)) == 503 and one(spark, classify.unsupported(F.lit("POOL_X"), ["POOL_"]))


def test_hashes_keep_pairs_apart(spark):
    rows = spark.createDataFrame([("ab", "c"), ("a", "bc")], "q string, d string").select(text.pair_hash(F.col("q"), F.col("d"))).distinct()
    assert rows.count() == 2


def test_pooling(spark):
    hidden, mask = np.array([[[1, 2], [3, 4], [100, 100]], [[1, 2], [3, 4], [5, 6]]], np.float32), np.array([[1, 1, 0], [0, 0, 0]])
    got = encoders.pool(hidden, mask)
    assert got[0] == pytest.approx(np.array([2, 3]) / math.sqrt(13)) and not got[1].any()
    assert one(spark, numeric.l2_normalised(F.col("v")), v=([0.0, 0.0], "array<double>")) == [0.0, 0.0]
    enc = encoders.HashEncoder(4, 16)
    both = spark.createDataFrame([("a b c", "c d"), ("", "x")], "a string, b string").select(enc.dense(F.col("a")).alias("v"), enc.pair(F.col("a"), F.col("b")).alias("p")).collect()
    assert all(sum(x * x for x in r["v"]) == pytest.approx(1) for r in both) and both[1]["p"] == -4.0


def test_cache_flow(spark):
    texts = spark.createDataFrame([(0, "hit1"), (1, "miss_a"), (2, "hit2"), (3, "miss_b"), (4, "miss_a")], "pos int, text string")
    cache = spark.createDataFrame([("hit1",), ("hit2",)], "t string").select(text.text_hash(F.col("t")).alias("sha"), F.array(F.lit(9.0)).alias("embedding"))
    split = dense.partition(texts, cache)
    assert sorted(r["pos"] for r in split.where("hit").collect()) == [0, 2]
    out = {r["pos"]: r["embedding"] for r in dense.embed(texts, lambda t: F.array(F.char_length(t).cast("double")), cache).collect()}
    assert out == {0: [9.0], 1: [6.0], 2: [9.0], 3: [6.0], 4: [6.0]}


def test_sparse(spark):
    logits = spark.createDataFrame([(1, 7, -1.0), (1, 7, 2.0), (1, 8, 0.0), (1, 9, 2.0)], "id int, term int, x double")
    pooled = sparse.max_pooled(logits, ["id", "term"], "x")
    top = sparse.top_terms(pooled, "id", 2)
    assert [(r["term"], r["rank"]) for r in top.orderBy("rank").collect()] == [(7, 1), (9, 2)]
    assert sparse.top_terms(pooled, "id", 0).count() == 0


def test_requests(spark):
    record = F.parse_json(F.col("j"))
    docs = one(spark, requests.documents(record), j=('{"documents": ["a", {"text": "b"}]}', "string"))
    assert docs == ["a", "b"]
    rows = spark.createDataFrame([('{"query": "q", "documents": ["a"], "normalize": "softmax"}',), ('{"query": "q", "documents": ["a"]}',)], "j string")
    assert [r["valid"] for r in requests.parsed(rows, "j", "rerank").collect()] == [False, True]
    assert requests.parsed(spark.createDataFrame([('{"input": "x"}',)], "j string"), "j", "sparse").first()["top_k"] == 256


def test_metrics(spark):
    assert metrics.ladder("embed_request_duration_seconds")[0] == 0.005 and metrics.ladder("embed_rerank_padding_waste_ratio")[-1] == 1.0
    assert metrics.ladder("embed_worker_batch_size")[-1] == 128.0
    rows = spark.createDataFrame([("a", float(x)) for x in range(7)], "k string, v double")
    s = metrics.latency_summary(rows, ["k"], "v").first()
    assert (s["n"], s["p50"], s["p90"], s["p99"], s["worst"]) == (7, 3.0, 6.0, 6.0, 6.0)
    line = metrics.exposition(spark.createDataFrame([('a"b', 2)], "m string, n int"), F.lit("x"), ["m"], F.col("n")).first()[0]
    assert line == 'x{m="a\\"b"} 2'


def test_readers(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"input": ["a", "b"]}\n\n{"input": "c"}\n')
    assert [len(r["input"]) for r in readers.request_lines(spark, str(tmp_path / "r.json"), "embed").collect()] == [2, 1]
    (tmp_path / "log").write_text("Extending BFCArena bin_num:3 (\nother\nExtending BFCArena bin_num:3\n \n")
    assert [tuple(r) for r in readers.arena_extensions(spark, str(tmp_path / "log")).collect()] == [(3, 2)]
    assert readers.corpus_lines(spark, str(tmp_path / "log")).count() == 3
    files = spark.createDataFrame([("model_quantized_static.onnx",), ("model_quantized_static_b1.onnx",), ("model_quantized_static_b8.onnx",), ("model_quantized_static_b0.onnx",), ("x",)], "name string")
    shapes = readers.static_shapes(files)
    assert {(r["batch"], r["file"]) for r in shapes.collect()} == {(1, "model_quantized_static_b1.onnx"), (8, "model_quantized_static_b8.onnx")}
    routes = readers.routed(spark.createDataFrame([(8,), (3,)], "items int"), shapes)
    assert {(r["items"], r["route"]) for r in routes.collect()} == {(8, "model_quantized_static_b8.onnx"), (3, "dynamic")}
    readers.write_exposition(spark.createDataFrame([("x 1",)], "value string"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()[0] == "x 1"


def test_strict_settings(spark):
    rows = spark.createDataFrame([("1K", "1.5"), (None, None)], "a string, b string")
    got = rows.select(config.byte_count(F.col("a"), strict=True).alias("a"), config.ratio_threshold(F.col("b"), strict=True).alias("b")).collect()
    assert [tuple(r) for r in got] == [(1024, 1.5), (None, 0.0)]
    for text, f in (("1T", config.byte_count), ("x", config.ratio_threshold)):
        with pytest.raises(Exception, match="not a"):
            spark.createDataFrame([(text,)], "s string").select(f(F.col("s"), strict=True)).collect()


def test_cache_limits_without_ordering_all(spark, monkeypatch):
    import random

    from textloom.operators import dense

    r = random.Random(5)
    monkeypatch.setattr(dense, "PARTS", 4)
    monkeypatch.setattr(dense, "BAND", 3)
    rows = [(f"{r.getrandbits(256):064x}", r.choice([1, 5, 5, 5, 900, -7])) for _ in range(120)]
    cache = spark.createDataFrame(rows, "sha string, last_used long")
    for n in (0, 1, 20, 77, 119, 120, 500):
        got = {x["sha"] for x in dense.updated_cache(cache, cache.limit(0), n).collect()}
        assert got == {s for s, _ in sorted(rows, key=lambda x: (-x[1], x[0]))[:n]}
    assert dense.updated_cache(cache.limit(0), cache.limit(0), 5).count() == 0


def test_bench_table_is_one_file(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", None)], "name string, n int").repartition(2)
    readers.write_bench_table(rows, ["name", "n"], f"{tmp_path}/t")
    lines = [x for f in tmp_path.glob("t/part-*") for x in f.read_text().splitlines()]
    assert lines[:2] == ["| name | n |", "|---|---|"] and sorted(lines[2:]) == ["| a | 1 |", "| b |  |"]
