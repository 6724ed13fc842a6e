"""Ranking of documents by calibrated scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from textloom.functions.numeric import calibrated, total_order_desc


def ranked(scored: DataFrame, request: list[str], score: str, index: str, top_n: Column | int | None = None) -> DataFrame:
    """Rows in each request's order (best first, ties by index) with ``rank`` from 1.

    top_n: null keeps all, 0 none.  The rank filter lets Spark keep only the best of each partition before the shuffle.
    """
    w = Window.partitionBy(*request).orderBy(*total_order_desc(F.col(score)), F.col(index).asc())
    out = scored.withColumn("rank", F.row_number().over(w))
    if top_n is None:
        return out
    return out.where(F.col("rank") <= (F.lit(top_n) if isinstance(top_n, int) else F.coalesce(top_n, F.lit(2**31 - 1))))


def results(scored: DataFrame, request: list[str], logit: str, index: str, top_n: Column | int | None = None, normalize: Column | None = None) -> DataFrame:
    """Ranked rows with ``relevance_score``."""
    kind = F.lit(None).cast("string") if normalize is None else normalize
    return ranked(scored.withColumn("relevance_score", calibrated(F.col(logit), kind)), request, "relevance_score", index, top_n)


def echoed(text: Column, return_documents: Column) -> Column:
    return F.when(return_documents, F.struct(text.alias("text")))
