"""Bounded samples of labelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from textloom.llm._text import held_out

#: Rows whose crc32(doc_id as text) mod FOLDS is 0 are never learned from.
FOLDS = 5


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, longest: int, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int]]:
    """Up to ``most`` (text, label) of labelled rows outside the held-out fold, in an order that depends on ids alone.

    Rows without a label or an id, and texts of over ``longest`` characters, are not
    learned from, so the sample's size is bounded by most x longest.  An id counts once: with the largest of its
    labels and the least of its texts.
    """
    fit = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label")).where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("id"), FOLDS, 0))
    ids = fit.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(most)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.char_length(F.coalesce("text", F.lit(""))) <= longest)
    # the sample has at most ``most`` rows, so it is the side to send; of an id with several texts the least is learned from
    found = texts.join(F.broadcast(ids), "id").groupBy("id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    rows = found.toArrow().to_pylist()
    return [(r["text"], r["label"]) for r in sorted(rows, key=lambda r: str(r["id"]))]
