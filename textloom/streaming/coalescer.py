"""Streams: coalescing items into batches, a cache kept by micro-batches, liveness by key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textloom.operators.batching import Budget
from textloom.operators.dense import updated_cache


def coalesced(items: DataFrame, key: str, item: str, length: str, arrived: str, budget: Budget, wait_seconds: float = 0.01) -> DataFrame:
    """Batches of a stream of items: (key, batch, items, first, last, max_len, total, closed_by).

    A batch opens with its first item, closes when the next one doesn't fit (which opens
    the next batch: it's carried, never dropped) or arrives ``wait_seconds`` after the first, and on the timeout of
    processing time.  State is the open batch alone.
    """
    state = "batch int, items int, first long, last long, max int, total long, opened double"
    out = f"{key} string, batch int, items int, first long, last long, max_len int, total long, closed_by string"
    b = budget

    def row(k: tuple, s: dict, why: str) -> tuple:
        return (k[0], s["batch"], s["items"], s["first"], s["last"], s["max"], s["total"], why)

    def update(k: tuple, frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        names = ["batch", "items", "first", "last", "max", "total", "opened"]
        s = dict(zip(names, group.get, strict=True)) if group.exists else None
        done: list[tuple] = []
        if group.hasTimedOut:
            if s and s["items"]:
                done.append(row(k, s, "timeout"))
                s.update(items=0)
        else:
            frame = pd.concat(list(frames)).sort_values([arrived, item])
            for i, n, t in zip(frame[item], frame[length], frame[arrived].astype("int64") / 1e9, strict=True):
                if s and s["items"]:
                    most = max(s["max"], n)
                    load = most * (s["items"] + 1) if b.padded else s["total"] + n
                    why = "wait" if t - s["opened"] >= wait_seconds else "budget" if most > b.longest or s["items"] + 1 > b.items or load >= b.tokens or (b.padded and b.length_ratio > 0 and s["max"] > 0 and n > s["max"] * b.length_ratio) else ""
                    if why:
                        done.append(row(k, s, why))
                        s.update(items=0)
                if not s or not s["items"]:
                    s = {"batch": s["batch"] + 1 if s else 1, "items": 0, "first": i, "last": i, "max": 0, "total": 0, "opened": t}
                s.update(items=s["items"] + 1, last=i, max=max(s["max"], n), total=s["total"] + n)
        if s:
            group.update(tuple(float(s[x]) if x == "opened" else int(s[x]) for x in names))
            if s["items"]:
                group.setTimeoutDuration(max(1, int(wait_seconds * 1000)))
        yield pd.DataFrame(done, columns=[c.split()[0] for c in out.split(", ")])

    return items.groupBy(key).applyInPandasWithState(update, out, state, "append", GroupStateTimeout.ProcessingTimeTimeout)


def cache_writer(path: str, capacity: int):
    """For ``writeStream.foreachBatch``: keeps a table of vectors by hash in ``path``, least lately used rows going first.

    Each micro-batch writes a new version and then points to it, so a failed attempt leaves the last one whole, and an attempt that is repeated gives the same version.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        before = f"{path}/v={epoch - 1}"
        old = spark.read.parquet(before) if epoch else spark.createDataFrame([], batch.schema)
        updated_cache(old, batch, capacity).write.mode("overwrite").parquet(f"{path}/v={epoch}")

    return write


def liveness(probes: DataFrame, key: str, at: str, result: str, window: float = 90.0, kill_after: int = 3) -> DataFrame:
    """Labels of a stream of probes, as ``operators.batching.heartbeats`` gives for a table."""
    out = f"{key} string, {at} double, label string, failures int"

    def update(k: tuple, frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        last, failures = group.get if group.exists else (None, 0)
        rows = []
        frame = pd.concat(list(frames)).sort_values(at, kind="stable")
        for now, what in zip(frame[at], frame[result], strict=True):
            if what in ("ok", "success"):
                last, failures, label = float(now), 0, what
            elif what == "none":
                failures, label = 0, what
            elif last is not None and now - last < window:
                failures, label = 0, "suppressed"
            else:
                failures, label = failures + 1, what
            shown = failures
            if failures >= kill_after:
                label, failures = "kill", 0
            rows.append((k[0], float(now), label, shown))
        group.update((last, failures))
        yield pd.DataFrame(rows, columns=[key, at, "label", "failures"])

    return probes.groupBy(key).applyInPandasWithState(update, out, "last double, failures int", "append", GroupStateTimeout.NoTimeout)
