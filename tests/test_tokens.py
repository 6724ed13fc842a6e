"""Pairs, vocabularies and the distribution of texts by tokens."""

import base64
import json

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers, processors

from textloom.functions import text
from textloom.operators import balance, encoders
from textloom.plans.catalog import QUERIES
from textloom.sources import vocabulary


def test_pairs_are_cut_as_the_library_cuts_them(spark):
    words = {"[CLS]": text.START, "[SEP]": text.END} | {f"w{i}": i + 10 for i in range(50)}
    t = Tokenizer(models.WordLevel(words, unk_token="w0"))
    t.pre_tokenizer = pre_tokenizers.Whitespace()
    t.post_processor = processors.TemplateProcessing(single="[CLS] $A [SEP]", pair="[CLS] $A [SEP] $B:1 [SEP]:1", special_tokens=[("[CLS]", text.START), ("[SEP]", text.END)])
    rows = [(a, b) for a in range(0, 14) for b in (*range(0, 14), 40)]
    df = spark.createDataFrame([(a, b, [10 + i % 50 for i in range(a)], [10 + (7 + i) % 50 for i in range(b)]) for a, b in rows], "a int, b int, q array<int>, d array<int>")
    for longest in (3, 4, 8, 11, 16, 60):
        got = {(r.a, r.b): r.p for r in df.select("a", "b", text.pair_ids(F.col("q"), F.col("d"), longest).alias("p")).collect()}
        t.enable_truncation(longest, strategy="longest_first", direction="right")
        for a, b in rows:
            want = t.encode(" ".join(f"w{i % 50}" for i in range(a)), " ".join(f"w{(7 + i) % 50}" for i in range(b)))
            assert (got[a, b].ids, got[a, b].segments) == (want.ids, want.type_ids), (a, b, longest)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_vocabulary_equals_the_library(spark, name):
    path = public_tokenizers.path(name)
    t = Tokenizer.from_file(path)
    rows = {r.term: r for r in vocabulary.vocabulary(spark, path).collect()}
    assert {i: r.token for i, r in rows.items()} == {i: k for k, i in t.get_vocab(with_added_tokens=True).items()}
    assert {i for i, r in rows.items() if r.special} == {i for i, a in t.get_added_tokens_decoder().items() if a.special}
    if name == "byte_bpe_50k.json":
        with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
        assert {i: bytes(r.bytes) for i, r in rows.items() if not r.added} == ranks
        assert rows[next(i for i, b in ranks.items() if b == " é".encode())].surface == " é"


def test_a_vocabulary_by_place(spark, tmp_path):
    file = {"model": {"type": "Unigram", "vocab": [["<unk>", 0.0], ["▁a", -1.5], ["<0x0A>", -2.0], ["b", -3]]}, "added_tokens": [{"id": 0, "content": "<unk>", "special": True}, {"id": 9, "content": "▁x", "special": False}]}
    path = tmp_path / "t.json"
    path.write_text(json.dumps(file))
    rows = sorted(tuple(r) for r in vocabulary.vocabulary(spark, str(path)).select("term", "token", "surface", "added", "special").collect())
    assert rows == [(0, "<unk>", "<unk>", True, True), (1, "▁a", " a", False, False), (2, "<0x0A>", "\n", False, False), (3, "b", "b", False, False), (9, "▁x", "▁x", True, False)]
    terms = spark.createDataFrame([(1,), (7,)], "term int")
    assert {tuple(r) for r in vocabulary.named(terms, vocabulary.vocabulary(spark, str(path))).collect()} == {(1, "▁a", " a"), (7, None, None)}


def test_sparse_terms_are_named(spark, small):
    rows = QUERIES["sparse_vocabulary"](spark, small).collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()]
    import hashlib
    import math
    import re
    from collections import Counter

    want = Counter()
    for x in docs:
        n = Counter(3 + int(hashlib.md5(w.encode()).hexdigest()[:7], 16) % 30519 for w in re.split("[ \\t\\r\\n]+", x or "") if w)
        best = sorted((-math.log(1 + c), i) for i, c in n.items() if math.log(1 + c) > 0.7)[:8]
        want.update(i for _, i in best)
    assert {r.term: r.documents for r in rows} == want and all(r.token == t.id_to_token(r.term) for r in rows)


def test_parts_have_alike_tokens_and_few_widths(spark, small):
    rng = np.random.default_rng(8)
    lens = [*rng.zipf(1.3, 3_000).clip(0, 400).tolist(), *[7] * 3_000, None]
    df = spark.createDataFrame(list(enumerate(int(x) if x is not None else None for x in lens)), "i long, len int")
    rows = balance.token_parts(df, "len", F.col("i"), 12).collect()
    assert sorted(r.i for r in rows) == list(range(len(lens)))
    cost = [sum(max(r.len or 1, 1) for r in rows if r.part == p) for p in range(12)]
    share = sum(cost) / 12
    # one text more or less, and the spread of a hash that deals texts of one length to several parts
    off = 400 + 4 * (share * 400) ** 0.5
    assert share - off <= min(cost) and max(cost) <= share + off
    spans = sorted((p, min(max(r.len or 1, 1) for r in rows if r.part == p), max(max(r.len or 1, 1) for r in rows if r.part == p)) for p in {r.part for r in rows})
    assert all(a[2] <= b[1] for a, b in zip(spans, spans[1:], strict=False))
    # padding of batches in the parts, and skew of tasks, against rows as they come
    waste = lambda groups: 1 - sum(map(sum, groups)) / sum(len(g) * max(g) for g in groups)
    chunked = lambda x: [x[k : k + 32] for k in range(0, len(x), 32)]
    as_they_come = waste(chunked([max(x or 1, 1) for x in lens]))
    dealt = balance.exchanged(df, "len", F.col("i"), 12).select("len", F.spark_partition_id().alias("task")).collect()
    assert {r.task for r in dealt} == set(range(12))
    by_task = [[max(r.len or 1, 1) for r in dealt if r.task == k] for k in range(12)]
    assert waste([g for t in by_task for g in chunked(t)]) < 0.2 * as_they_come
    assert balance.token_parts(df.limit(0), "len", F.col("i"), 12).count() == 0


def test_batches_follow_the_ratio(spark):
    lengths = [9, 1, 4, 2, 8, 0, 3]

    def opener(graph, tokenizer):
        return encoders.Model(lambda texts, longest: [[1] * int(t) for t in texts], lambda feed: feed["input_ids"], ["input_ids"])

    encoder = encoders.OnnxEncoder("g", "t-ratio", opener=opener, batch=3)
    assert [[lengths[i] for i in rows] for rows, _, _ in encoder.batches(list(map(str, lengths)), 2.0)] == [[9, 8], [4, 3, 2], [1, 0]]
    assert [len(rows) for rows, _, _ in encoder.batches(list(map(str, lengths)))] == [3, 3, 1]


def test_files_are_shipped(spark, tmp_path):
    weights = tmp_path / "shipped-weights.npy"
    np.save(weights, np.arange(6.0))
    encoders.ship(spark, str(weights))
    # workers have no such folder
    path = "/no/such/folder/shipped-weights.npy"

    @F.udf("double")
    def total(i):
        return float(encoders.mapped(path).sum() + i)

    assert [r.x for r in spark.range(3).select(total("id").alias("x")).collect()] == [15.0, 16.0, 17.0]
    with pytest.raises(FileNotFoundError):
        encoders.located(str(tmp_path / "never-there.onnx"))
