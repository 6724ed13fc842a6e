"""The corpus pipeline: quality rules, quality classifier, near-duplicates, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a table that is written and read again
as the next one's docs.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.llm import _text, byte_bpe, decontaminate, jaccard_join, quality_cnn, quality_rules
from textloom.llm._text import stored
from textloom.llm.queries import BPE_FILE, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_scratch: list[str] = []


def scratch(stage: Stage) -> Stage:
    """Tables that a stage stores on its way are deleted when the next one begins, as its result is written by then."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _scratch:
            _text.drop(spark, _scratch.pop())
        before = len(_text.written)
        out = stage(spark, docs, sf_dir)
        _scratch.extend(_text.written[before:])
        return out

    return run_stage


@scratch
def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    return quality_rules.apply(docs)


@scratch
def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte-level network doesn't reject."""
    return quality_cnn.apply(docs, table(spark, sf_dir, "labels"))


@scratch
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingle sets link at a similarity of 0.8 or more."""
    return jaccard_join.keep_one(docs, width=5, percent=80)


@scratch
def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark, and their new lengths; those that are mostly such passages go."""
    out = decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))
    kind = docs.schema["n_chars"].dataType
    return out.withColumn("n_chars", F.coalesce(F.char_length("text").cast(kind), F.col("n_chars")))


@scratch
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and digests of each document's tokens."""
    import public_tokenizers

    return byte_bpe.round_trip(docs, public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("quality rules", rules),
    ("quality classifier", classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("byte-level BPE encoding and decoding", tokens),
]

#: The classifier and the outlier estimates can't be expressed in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; a stage's table is deleted when the next one's is written."""
    docs, path = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
            if path:
                _text.drop(spark, path)
            path = _text.written[-1]
    return docs
