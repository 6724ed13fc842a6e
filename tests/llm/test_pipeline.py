import corpus_pipeline
import pytest
from textloom.llm import _text, decontaminate, jaccard_join, quality_cnn, quality_rules
from textloom.llm._text import stored


def test_stages_on_the_smallest_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    counts, columns = [docs.count()], docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stored(stage(spark, docs, small))
        counts.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.4 * counts[0]
    assert {"doc_id", "n_tokens", "ids"} <= set(docs.columns)


def test_odd_rows_and_columns(spark, small):
    """Nulls, empty and long texts, repeated rows, columns with the names of our own, and no rows."""
    long = "every word of this long text is of some length and has its place, " * 3000
    rows = [(1, None, None, None, None, 1, 2), (1, "", "en", "s", 0, 1, 2), (2, long, "en", "s", len(long), 1, 2), (2, long, "en", "s", len(long), 1, 2), (None, "no id", "en", None, 5, 1, 2)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __rules int, __score int")
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, odd, small).collect()
        stage(spark, odd.limit(0), small).collect()


def test_each_stage_is_its_operator(spark, small):
    """The rows that each stage keeps are those of its operator's verdicts, and the lengths are those of the texts."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels, items = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("labels", "benchmark"))
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    rules, classifier, near, clean, _ = (f for _, f in corpus_pipeline.STAGES)
    assert ids(rules(spark, docs, small)) == ids(quality_rules.verdicts(docs).where("kept"))
    assert ids(classifier(spark, docs, small)) == ids(quality_cnn.scores(docs, labels).where("predicted = 1"))
    found = jaccard_join.classes(docs, width=5, percent=80)
    assert ids(near(spark, docs, small)) == ids(found.where("doc_id = component_id"))
    hits = {r["doc_id"]: r for r in decontaminate.scan(docs, items).collect()}
    out = {r["doc_id"]: r for r in clean(spark, docs, small).collect()}
    assert sorted(out) == sorted(i for i, r in hits.items() if r["n_hit"] <= 0.8 * r["n_words"])
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for i, r in out.items():
        assert r["n_chars"] == len(r["text"]) and (r["text"] == texts[i]) == (hits[i]["n_hit"] == 0)
        assert len(_text.alnum_words(r["text"])) == hits[i]["n_words"] - hits[i]["n_hit"]


def test_the_shared_folder_must_be_named_on_a_cluster(spark):
    class Conf:
        get = staticmethod(lambda name, default=None: default)

    class Context:
        master, applicationId = "spark://host:7077", "app"

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(ValueError, match="checkpoint"):
        _text.shared_dir(Session)
