"""Distribution of texts so that tasks have alike work and texts of like length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from textloom.operators.ordering import free

#: Places that an id's hash chooses from, where rows of one length are shared by several parts.
_SHARES = 1 << 20


def token_parts(rows: DataFrame, length: str, tie: Column, parts: int, part: str = "part") -> DataFrame:
    """``rows`` with ``part`` (int, from 0): in order of length, every part has about the same sum of lengths.

    Cut points lie at equal sums of tokens, not of rows, so the part with the longest texts has few and that with the shortest has many; a part
    has few widths, and batches in it need little padding.  Sums come from counts by length, of which there are no
    more than the longest has tokens; a length whose rows are more than a part's share is dealt on by the hash of ``tie``.  A length below 1 or
    null costs 1.
    """
    n, before, each, total = free(rows.columns, "__n", "__before", "__each", "__total")
    sized = rows.withColumn(n, F.greatest(F.coalesce(F.col(length).cast("long"), F.lit(1)), F.lit(1)))
    counts = sized.groupBy(n).agg((F.count(F.lit(1)) * F.col(n)).alias(each))
    up_to = F.sum(each).over(Window.orderBy(n).rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumn(before, up_to - F.col(each)).withColumn(total, F.sum(each).over(Window.partitionBy()))
    share = F.conv(F.substring(F.md5(tie.cast("string")), 1, 5), 16, 10).cast("long")
    at = F.col(before) + F.floor(F.col(each) * share / F.lit(_SHARES))
    number = F.least(F.floor(at * parts / F.col(total)), F.lit(parts - 1)).cast("int")
    return sized.join(placed, n).withColumn(part, number).drop(n, before, each, total)


def exchanged(rows: DataFrame, length: str, tie: Column, parts: int) -> DataFrame:
    """``rows`` dealt to ``parts`` tasks by ``token_parts``, longest first within each, for an encoder that batches what comes."""
    (part,) = free(rows.columns, "__part")
    dealt = token_parts(rows, length, tie, parts, part).repartitionById(parts, F.col(part))
    return dealt.sortWithinPartitions(F.desc(length)).drop(part)
