"""Settings as a typed object and as a table."""

import pytest

from textloom.operators.batching import Budget
from textloom.sources import options as o


def test_defaults(spark):
    got = o.options(spark, {})
    assert got == o.Options() and got.budget() == Budget()
    assert got.budget(rerank=True).items == 128


def test_values(spark):
    got = o.options(spark, {"EMBED_MODELS": "e5:/m/e5:768:512:1:true, jina:/m/j:768:256:0:0:model.onnx", "BATCHING_ENABLED": "TRUE", "BATCH_MAX": "8", "BATCH_MAX_TOKENS": "0", "BATCH_MAX_SEQ": " 99 ", "BATCH_LENGTH_RATIO_THRESHOLD": "1.5",
                            "EMBED_SUBBATCH_RATIO": "nan", "BATCH_WAIT_MS": "250", "AUTO_TRUNCATE": "False", "CACHE_MAX_ENTRIES": "0", "TOKEN_CACHE_MAX_ENTRIES": "x", "EMBED_MAX_INPUT_ARRAY": "-3", "OTHER": "1"})
    assert [m["name"] for m in got.models] == ["e5", "jina"] and got.default_model == "e5" and got.models[1]["max_len"] == 256
    assert (got.batching, got.batch_items, got.rerank_batch_items, got.batch_tokens, got.longest, got.length_ratio, got.sub_batch_ratio) == (True, 8, 32, 16_384, 99, 1.5, 2.0)
    assert (got.wait_seconds, got.truncate, got.cache_entries, got.token_cache_entries, got.most_inputs, got.unread) == (0.25, False, 0, 0, 32, ("OTHER",))
    assert got.budget(padded=False) == Budget(16_384, 8, 99, False, 1.5)


@pytest.mark.parametrize(("settings", "says"), [({"EMBED_MODELS": "e5:/m"}, "models: entry 1"), ({"RERANKER_MODELS": "nothing"}, "rerankers: entry 1"), ({"BATCH_LENGTH_RATIO_THRESHOLD": "-1"}, "length ratio")])
def test_errors(spark, settings, says):
    with pytest.raises(Exception, match=says):
        o.options(spark, settings)


def test_a_table_of_settings(spark):
    rows = [("job1", "BATCH_MAX", "4"), ("job1", "BATCH_MAX_SEQ", "64"), ("job2", "EMBED_DEFAULT_MODEL", "m"), ("job3", "SOMETHING", "1")]
    got = {r.job: r for r in o.options_table(spark.createDataFrame(rows, "job string, name string, value string"), "job").collect()}
    assert (got["job1"].batch_items, got["job1"].longest, got["job1"].rerank_batch_items) == (4, 64, 16)
    assert got["job2"].default_model == "m" and got["job3"].batch_tokens == 16_384
