"""Every query against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from textloom.plans.catalog import ORACLE_SQL, QUERIES


def plain(x):
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
        return None
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else x


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def db(small):
    c = duckdb.connect()
    for p in Path(small).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, db, name):
    got = QUERIES[name](spark, small).toPandas()
    if name not in ORACLE_SQL:
        assert len(got)
        return
    want = db.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_base64_vectors_decode(spark, small):
    import base64

    import numpy as np

    both = QUERIES["base64_vectors"](spark, small).join(spark.read.parquet(f"{small}/embeddings.parquet"), "vec_id").toPandas()
    for b64, v in zip(both["embedding_b64"], both["embedding"], strict=True):
        assert np.array_equal(np.frombuffer(base64.b64decode(b64), "<f4"), np.asarray(v, "<f4"))


def test_entry():
    import __spark_entry__

    assert set(ORACLE_SQL) <= set(__spark_entry__.queries())


def test_plans(spark, small):
    """Filters and columns reach the scan, and the rank filter is applied before the shuffle."""
    plan = QUERIES["rerank_topk"](spark, small)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
    scan = QUERIES["metric_counter"](spark, small)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<user_id:bigint,event_type:string>" in scan


def _whole_ids(text):
    import hashlib
    import re

    return [3 + int(hashlib.md5(w.encode()).hexdigest()[:7], 16) % 30519 for w in re.split("[ \\t\\r\\n]+", text or "") if w]


@pytest.fixture(scope="module")
def long_documents(spark, tmp_path_factory):
    """Texts with equal beginnings that differ after their 12th and 30th word."""
    d = str(tmp_path_factory.mktemp("long"))
    rows = [(i, "en", "ab"[i % 2], " ".join(["same"] * 40 + [f"w{k}" for k in range(i * 7)])) for i in range(1, 9)]
    spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").write.parquet(f"{d}/documents.parquet")
    return d, {i: _whole_ids(t) for i, _, _, t in rows}


def test_whole_texts_are_pooled(spark, long_documents):
    import hashlib
    import math

    d, ids = long_documents
    got = {r["doc_id"]: list(r)[1:] for r in QUERIES["scatter_vectors_whole"](spark, d).collect()}
    for i, tokens in ids.items():
        v = [sum(int(hashlib.md5(f"{t}:{k}".encode()).hexdigest()[:6], 16) / 8388608 - 1 for t in [1, *tokens, 2]) for k in range(4)]
        assert got[i] == pytest.approx([x / math.hypot(*v) for x in v], abs=2e-6)
    assert len(set(map(tuple, got.values()))) == len(ids) == len(got)


def test_whole_texts_are_padded_to_their_batch(spark, long_documents):
    d, ids = long_documents
    got = QUERIES["pad_mask_whole"](spark, d).collect()
    widths = {}
    for r in got:
        widths.setdefault((r["source"], r["batch"]), []).append(len(ids[r["doc_id"]]))
    assert sorted(r["doc_id"] for r in got) == sorted(ids)
    for r in got:
        own, width = ids[r["doc_id"]], max(widths[r["source"], r["batch"]])
        assert r["ids"].split() == [*map(str, own), *["0"] * (width - len(own))] and r["ones"] == len(own)
        assert r["mask"].split() == ["1"] * len(own) + ["0"] * (width - len(own))
