"""Coalescing of a stream into batches, each key dealt to lanes, with deadlines kept by timers.

A key of any rate is shared by a fixed number of lanes, chosen by the item's hash, and each lane
batches by itself: so no task gets a whole key.  A lane's state is its open batch: a value with
the batch's numbers and a list of its items, both of which expire with ``ttl``.  The state store must keep lists and
timers, as RocksDB's does (``STORE``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from textloom.operators.batching import Budget

#: Setting of a session that runs these streams.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
OPEN = "batch long, first long, last long, items int, max int, total long, deadline long"
OUT = "lane int, batch long, items int, first long, last long, members array<long>, max_len int, total long, closed_by string"
#: State of a lane that nothing has come to for so long is given up, in milliseconds; its batch was closed long before.
TTL = 3_600_000


def lane(item: Column, lanes: int) -> Column:
    return F.pmod(F.xxhash64(item), F.lit(lanes)).cast("int")


class _Lanes(StatefulProcessor):
    """Batches of one lane: the greedy rules of a ``Budget``, and a deadline from the first item on."""

    def __init__(self, key: str, budget: Budget, wait_ms: int, ttl: int):
        self.key, self.budget, self.wait_ms, self.ttl = key, budget, wait_ms, ttl
        # workers have no session that could read DDL
        self.schemas = [T.StructType.fromDDL(x) for x in (OPEN, "item long")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", self.schemas[0], self.ttl)
        self.members = handle.getListState("members", self.schemas[1], self.ttl)

    def close(self) -> None:
        pass

    def _closed(self, key: tuple, s: dict, members: list[int], why: str) -> tuple:
        return (key[0], key[1], s["batch"], s["items"], s["first"], s["last"], members, s["max"], s["total"], why)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[self.key, *[c.split()[0] for c in OUT.split(", ")]])

    def _refuses(self, s: dict, n: int) -> bool:
        b, most = self.budget, max(s["max"], n)
        load = most * (s["items"] + 1) if b.padded else s["total"] + n
        return most > b.longest or s["items"] + 1 > b.items or load >= b.tokens or (b.padded and b.length_ratio > 0 and s["max"] > 0 and n > s["max"] * b.length_ratio)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in OPEN.split(", ")]
        kept = self.open.get() if self.open.exists() else None
        s = dict(zip(names, kept, strict=True)) if kept else dict.fromkeys(names, 0)
        members = [m[0] for m in self.members.get()] if s["items"] else []
        now = timerValues.getCurrentProcessingTimeInMs()
        # one Arrow batch at a time; what came in it is taken in order of arrival
        for frame in rows:
            done = []
            for item, n in frame.sort_values(["arrived", "item"])[["item", "len"]].itertuples(index=False):
                item, n = int(item), int(n)
                late = s["items"] and now >= s["deadline"]
                if s["items"] and (late or self._refuses(s, n)):
                    done.append(self._closed(key, s, members, "wait" if late else "budget"))
                    self._drop_timer(s["deadline"])
                    s["items"], members = 0, []
                if not s["items"]:
                    s.update(batch=s["batch"] + 1, first=item, max=0, total=0, deadline=now + self.wait_ms)
                    self.handle.registerTimer(s["deadline"])
                s.update(last=item, items=s["items"] + 1, max=max(s["max"], n), total=s["total"] + n)
                members.append(item)
            if done:
                yield self._frame(done)
        self.open.update(tuple(s[c] for c in names))
        self.members.put([(m,) for m in members])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in OPEN.split(", ")]
        if not self.open.exists():
            return
        s = dict(zip(names, self.open.get(), strict=True))
        # a timer of a batch that was closed since says nothing of the one that is open now
        if s["items"] and s["deadline"] <= expiredTimerInfo.getExpiryTimeInMs():
            yield self._frame([self._closed(key, s, [m[0] for m in self.members.get()], "timeout")])
            s["items"] = 0
            self.open.update(tuple(s[c] for c in names))
            self.members.clear()

    def _drop_timer(self, at: int) -> None:
        self.handle.deleteTimer(at)


def coalesced(items: DataFrame, key: str, item: str, length: str, arrived: str, budget: Budget, wait_seconds: float = 0.01, lanes: int = 16, ttl: int = TTL) -> DataFrame:
    """Batches of a stream: key, lane, batch (from 1 in each lane), items, first, last, members, max_len, total, closed_by.

    closed_by: budget (the next item doesn't fit, and opens the next batch), wait (an item came after the deadline) or timeout
    (the deadline passed without one).  key is a string, item a whole number.
    """
    rows = items.select(F.col(key).cast("string").alias("key"), lane(F.col(item), lanes).alias("lane"), F.col(item).cast("long").alias("item"), F.coalesce(F.col(length).cast("int"), F.lit(0)).alias("len"), F.col(arrived).alias("arrived"))
    out = T.StructType([T.StructField(key, T.StringType()), *T.StructType.fromDDL(OUT).fields])
    return rows.groupBy("key", "lane").transformWithStateInPandas(_Lanes(key, budget, max(1, int(wait_seconds * 1000)), ttl), out, "Append", "ProcessingTime")
