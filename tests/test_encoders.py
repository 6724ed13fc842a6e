"""The model encoders, with a stand-in tokenizer and graph."""

import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from textloom.operators import encoders

# workers can't import this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])
VOCABULARY = 11


def ids_of(text, longest):
    words = " ".join(text).split() if isinstance(text, tuple) else text.split()
    return [1 + sum(w.encode()) % (VOCABULARY - 1) for w in words][:longest]


def opener(kind):
    def open_model(graph, tokenizer):
        def run(feed):
            ids, mask = feed["input_ids"], feed["attention_mask"]
            if graph == "fixed":
                assert ids.shape == (2, 6)
            if kind == "dense":
                return np.stack([ids, ids * ids, ids * 0 + 1], 2).astype(np.float32)
            if kind == "pair":
                return (ids * mask).sum(1, keepdims=True).astype(np.float32) + (100 if graph == "fixed" else 0)
            out = np.zeros((*ids.shape, VOCABULARY), np.float32) - 1
            np.put_along_axis(out, ids[..., None], ids[..., None].astype(np.float32), 2)
            return out

        return encoders.Model(lambda texts, longest: [ids_of(t, longest) for t in texts], run, ["input_ids", "attention_mask"])

    return open_model


TEXTS = ["a bb ccc", "", None, "dd", "a bb ccc", "x " * 50, "e f"]


def test_dense_vectors(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    encoder = encoders.OnnxEncoder("g", "t", longest=6, batch=3, opener=opener("dense"))
    got = {r["id"]: r["v"] for r in rows.select("id", encoder.dense(F.col("text")).alias("v")).collect()}
    assert len(got) == len(TEXTS) and got[0] == got[4]
    for i, t in enumerate(TEXTS):
        ids = np.array(ids_of(t or "", 6), float)
        mean = np.stack([ids, ids * ids, ids * 0 + 1], 1).mean(0) if len(ids) else np.zeros(3)
        size = np.linalg.norm(mean)
        assert np.allclose(got[i], mean / size if size else mean, atol=1e-6)


def test_pair_scores_and_static_graphs(spark):
    rows = spark.createDataFrame([(i, t, "q") for i, t in enumerate(TEXTS)], "id int, text string, query string").coalesce(1)
    encoder = encoders.OnnxEncoder("g", "t", longest=6, batch=5, static={2: "fixed"}, opener=opener("pair"))
    got = {r["id"]: r["s"] for r in rows.select("id", encoder.pair(F.col("query"), F.col("text")).alias("s")).collect()}
    raw = {i: float(sum(ids_of(("q", t or ""), 6))) for i, t in enumerate(TEXTS)}
    # seven pairs are a batch of five, longest first, and one of two, which the fixed graph takes
    assert sorted(got[i] - raw[i] for i in raw) == [0.0] * 5 + [100.0] * 2
    assert encoder.scores([]).tolist() == []


def test_sparse_weights(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    encoder = encoders.OnnxEncoder("g", "t", longest=6, batch=2, opener=opener("sparse"))
    got = {r["id"]: [(p["term"], round(p["weight"], 5)) for p in r["p"]] for r in rows.select("id", encoder.sparse(F.col("text"), 2, 0.1).alias("p")).collect()}
    for i, t in enumerate(TEXTS):
        want = sorted(((k, round(float(np.log1p(k)), 5)) for k in set(ids_of(t or "", 6))), key=lambda p: (-p[1], p[0]))[:2]
        assert got[i] == want
    assert encoder.weights(["a"], 0, 0.0) == [[]]


def test_wrong_shapes_missing_files_and_inputs():
    bad = encoders.OnnxEncoder("b", "t", opener=opener("pair"))
    with pytest.raises(ValueError, match="width"):
        bad.vectors(["a b"])
    with pytest.raises(ValueError, match="expected"):
        encoders.OnnxEncoder("b2", "t", opener=opener("dense")).scores([("a", "b")])
    with pytest.raises(FileNotFoundError, match="nowhere"):
        encoders.open_onnx("/nowhere/model.onnx", "/nowhere/tokenizer.json")
    with pytest.warns(UserWarning, match="position_ids"):
        encoders.Model(lambda t, n: [], lambda f: None, ["input_ids", "position_ids"])


def test_tokenizer_truncates_pairs(tmp_path, monkeypatch):
    """The real tokenizer code, with a word-level vocabulary and a session that gives back its shape."""
    import types

    from tokenizers import Tokenizer, models, pre_tokenizers

    words = Tokenizer(models.WordLevel({w: i for i, w in enumerate(["[UNK]", "a", "b", "c"])}, unk_token="[UNK]"))
    words.pre_tokenizer = pre_tokenizers.Whitespace()
    words.save(str(tmp_path / "t.json"))
    (tmp_path / "g.onnx").write_bytes(b"")

    class Session:
        def __init__(self, *_):
            pass

        def get_inputs(self):
            return [types.SimpleNamespace(name="input_ids")]

        def run(self, _, feed):
            return [feed["input_ids"].sum(1, keepdims=True).astype(np.float32)]

    fake = types.SimpleNamespace(SessionOptions=types.SimpleNamespace, InferenceSession=Session)
    monkeypatch.setitem(sys.modules, "onnxruntime", fake)
    model = encoders.open_onnx(str(tmp_path / "g.onnx"), str(tmp_path / "t.json"))
    assert model.encode(["a b c zzz"], 3) == [[1, 2, 3]] and model.encode([("a a a a", "b")], 3) == [[1, 1, 2]]
    encoder = encoders.OnnxEncoder(str(tmp_path / "g.onnx"), str(tmp_path / "t.json"), longest=4)
    assert encoder.scores([("a b", "c"), ("c", "c")]).tolist() == [6.0, 6.0]
