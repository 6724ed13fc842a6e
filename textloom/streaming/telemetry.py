"""Counters that a job fills while it runs, instead of counting its rows again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQueryListener

from textloom.operators import metrics


class Counters(StreamingQueryListener):
    """Totals by (series, counter), from batch jobs and streams.

    ``watched`` adds counters to a table: they are filled by whatever job reads it first, and no other job is run.  Streams report
    each micro-batch once this is a listener of the session's streams.  An aggregate that sums (count, sum) is added
    up over jobs and micro-batches.
    """

    def __init__(self) -> None:
        self.totals: dict[tuple[str, str], float] = {}
        self._pending: list[tuple[str, Observation]] = []

    def watched(self, df: DataFrame, series: str, **counters: Column) -> DataFrame:
        named = [c.alias(k) for k, c in counters.items()]
        if df.isStreaming:
            return df.observe(series, *named)
        seen = Observation()
        self._pending.append((series, seen))
        return df.observe(seen, *named)

    def add(self, series: str, values: dict) -> None:
        for k, v in values.items():
            self.totals[series, k] = self.totals.get((series, k), 0) + (v or 0)

    def collect(self) -> dict[tuple[str, str], float]:
        """The totals, with batch jobs that have run since; waits for one that has begun, so every watched table must have been read."""
        while self._pending:
            series, seen = self._pending.pop()
            self.add(series, seen.get)
        return dict(self.totals)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for series, row in event.progress.observedMetrics.items():
            self.add(series, row.asDict())

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def lines(self, spark: SparkSession) -> DataFrame:
        """The totals as lines of an exposition."""
        rows = [(s, k, float(v)) for (s, k), v in sorted(self.collect().items())]
        samples = spark.createDataFrame(rows, "series string, counter string, value double")
        return metrics.exposition(samples, F.col("series"), ["counter"], F.col("value"))
