"""Batch planning: sub-batches of like length, token budgets, padding."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from textloom.operators.folds import ordered_fold


def sub_batches(lengths: Column, ratio: Column) -> Column:
    """Groups (from 0) of a request's inputs by position: longest first, a group as long as its first is at most ``ratio`` times each.

    For the bounded list of one request; the list is folded inside its row.
    """
    item = lambda n, i: F.struct((-n).alias("neg"), i.alias("pos"))
    start = F.struct(F.lit(-1).alias("group"), F.lit(0.0).alias("widest"), F.array().cast("array<struct<pos:int,group:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        n = F.greatest(-x["neg"], F.lit(1)).cast("float")
        opens = (acc["group"] < 0) | ((acc["widest"].cast("float") / n).cast("float") > ratio.cast("float"))
        group = F.when(opens, acc["group"] + 1).otherwise(acc["group"])
        return F.struct(group.alias("group"), F.when(opens, n.cast("double")).otherwise(acc["widest"]).alias("widest"), F.concat(acc["out"], F.array(F.struct(x["pos"].alias("pos"), group.alias("group")))).alias("out"))

    split = F.aggregate(F.array_sort(F.transform(lengths, item)), start, step, lambda acc: acc["out"])
    whole = F.transform(lengths, lambda n, i: F.struct(i.alias("pos"), F.lit(0).alias("group")))
    return F.when((ratio <= 1) | F.isnan(ratio), whole).otherwise(split)


@dataclass(frozen=True)
class Budget:
    """Limits of a batch."""

    tokens: int = 16_384
    items: int = 32
    longest: int = 256
    padded: bool = True
    #: Most times the batch's longest that a new item may be; 0 is off.
    length_ratio: float = 0.0


def packed(rows: DataFrame, keys: list[str], order: list[str], budget: Budget, length: str = "len", texts: str | None = None, total: str | None = None) -> DataFrame:
    """``rows`` with batch (from 1 in each key), head, carried and reason, in order of arrival.

    length: tokens of the longest text; texts and total: columns of the number and tokens of an item's texts (1 and
    ``length`` without).  carried: the row was taken from the queue for the batch before and didn't fit.  reason: of a head that is over a limit by itself.
    """
    b = budget

    def fits(s: dict, n: int, most: int, tokens: int) -> bool:
        if s["items"] + n > b.items:
            return False
        load = max(s["max"], most) * (s["items"] + n) if b.padded else s["total"] + tokens
        return load < b.tokens

    def step(s: dict, most: int | None, *rest: int) -> tuple:
        most, n = most or 0, rest[0] if texts else 1
        tokens = rest[-1] if total else most
        empty = s["batch"] == 0
        full = not empty and (s["items"] >= b.items or (s["max"] * s["items"] if b.padded else s["total"]) >= b.tokens)
        refused = not empty and (
            max(s["max"], most) > b.longest
            or (b.padded and b.length_ratio > 0 and s["max"] > 0 and most > s["max"] * b.length_ratio)
            or not fits(s, n, most, tokens)
        )
        head, reason = empty or refused, None
        if head:
            if not fits({"items": 0, "max": 0, "total": 0}, n, most, tokens):
                reason = "exceeds_batch_max_items" if n > b.items else "exceeds_max_batch_tokens"
            elif most > b.longest:
                reason = "solo_seq_overflow"
            s.update(batch=s["batch"] + 1, items=0, max=0, total=0)
        s.update(items=s["items"] + n, max=max(s["max"], most), total=s["total"] + tokens)
        return s["batch"], head, refused and not full, reason

    start = lambda: {"batch": 0, "items": 0, "max": 0, "total": 0}
    return ordered_fold(rows, keys, order, [c for c in (length, texts, total) if c], start, step, "batch int, head boolean, carried boolean, reason string")


def batches(packed_rows: DataFrame, keys: list[str], length: str = "len") -> DataFrame:
    """Items, longest and tokens of each batch."""
    return packed_rows.groupBy(*keys, "batch").agg(F.count(F.lit(1)).alias("items"), F.max(length).cast("long").alias("max_len"), F.sum(length).cast("long").alias("total"))


def split_back(results: DataFrame, keys: list[str], item: str, pos: str, value: str) -> DataFrame:
    """Values of a batch's texts, gathered again by item in order of position."""
    return results.groupBy(*keys, item).agg(F.array_sort(F.collect_list(F.struct(pos, value))).alias("p")).select(*keys, item, F.transform("p", lambda x: x[value]).alias(value))


def admitted(items: DataFrame, cancelled: Column) -> DataFrame:
    """Items whose requester is still there; the others aren't charged, packed or dispatched."""
    return items.where(~F.coalesce(cancelled, F.lit(False)))


def delivered(packed_rows: DataFrame, replies: DataFrame, keys: list[str]) -> DataFrame:
    """Items with ``error``: a batch's failure goes to all of its items, and so does a count of results that isn't its count of items.

    replies: (keys, batch, results, failure), one for each batch; a batch without one has no results.
    """
    sizes = packed_rows.groupBy(*keys, "batch").agg(F.count(F.lit(1)).alias("__n")).join(replies, [*keys, "batch"], "left")
    got = F.coalesce("results", F.lit(0))
    wrong = F.when(got != F.col("__n"), F.format_string("embed_fn returned %d vectors for %d texts", got.cast("long"), F.col("__n")))
    return packed_rows.join(sizes.select(*keys, "batch", F.coalesce("failure", wrong).alias("error")), [*keys, "batch"])


def permits(events: DataFrame, keys: list[str], order: list[str], arrival: str, most: int) -> DataFrame:
    """Events with ``in_use`` (before) and ``limited``: an arrival takes a permit or is turned away at once; another event gives one back."""

    def step(s: dict, arrives: bool | None) -> tuple:
        used = s["used"]
        limited = bool(arrives) and used >= most
        s["used"] = used + (not limited) if arrives else max(0, used - 1)
        return used, limited

    return ordered_fold(events, keys, order, [arrival], lambda: {"used": 0}, step, "in_use int, limited boolean")


def waiters(events: DataFrame, keys: list[str], order: list[str], arrival: str, most: int, cap: int) -> DataFrame:
    """Events with ``outcome``, ``running`` and ``waiting`` (after) of a worker with ``most`` permits.

    An arrival is refused where ``cap`` wait already, else runs or waits; a finished request's permit goes to
    one that waits.
    """

    def step(s: dict, arrives: bool | None) -> tuple:
        if arrives:
            if s["waiting"] >= cap:
                outcome = "refused"
            elif s["running"] < most:
                s["running"] += 1
                outcome = "runs"
            else:
                s["waiting"] += 1
                outcome = "waits"
        elif s["running"] == 0:
            outcome = "idle"
        else:
            outcome = "finished"
            if s["waiting"]:
                s["waiting"] -= 1
            else:
                s["running"] -= 1
        return outcome, s["running"], s["waiting"]

    return ordered_fold(events, keys, order, [arrival], lambda: {"running": 0, "waiting": 0}, step, "outcome string, running int, waiting int")


def backpressure(events: DataFrame, keys: list[str], order: list[str], arrival: str, capacity: int = 256) -> DataFrame:
    """Events with depth (before) and rejected: an arrival is refused from 80 % of ``capacity`` waiting; another event takes one off."""
    limit = capacity * 8 // 10

    def step(s: dict, arrives: bool | None) -> tuple:
        depth = s["depth"]
        rejected = bool(arrives) and depth >= limit
        if not arrives:
            s["depth"] = max(0, depth - 1)
        elif not rejected:
            s["depth"] += 1
        return depth, rejected

    return ordered_fold(events, keys, order, [arrival], lambda: {"depth": 0}, step, "depth int, rejected boolean")


def heartbeats(probes: DataFrame, keys: list[str], order: list[str], at: str = "at", result: str = "result", window: float = 90.0, kill_after: int = 3) -> DataFrame:
    """Probes with label and failures.

    result: ok, error, timeout, success (a served request, no probe) or none (no client).  A failed probe within
    ``window`` seconds after a success is suppressed; the ``kill_after``-th failure in a row kills.
    """

    def step(s: dict, what: str, now: float) -> tuple:
        if what in ("ok", "success"):
            s.update(last=now, failures=0)
            return what, 0
        if what == "none":
            s["failures"] = 0
            return what, 0
        if s["last"] is not None and now - s["last"] < window:
            s["failures"] = 0
            return "suppressed", 0
        s["failures"] += 1
        if s["failures"] >= kill_after:
            s["failures"] = 0
            return "kill", kill_after
        return what, s["failures"]

    return ordered_fold(probes, keys, order, [result, at], lambda: {"last": None, "failures": 0}, step, "label string, failures int")


def respawns(events: DataFrame, keys: list[str], order: list[str], event: str = "event", start: float = 2.0, most: float = 60.0) -> DataFrame:
    """Events (exit, spawn_ok, spawn_fail) with ``delay``: seconds waited before the next spawn; doubled by failures, reset by success."""

    def step(s: dict, what: str) -> tuple:
        if what == "spawn_fail":
            s["delay"] = min(2 * s["delay"], most)
        elif what == "spawn_ok":
            s["delay"] = start
        return (s["delay"],)

    return ordered_fold(events, keys, order, [event], lambda: {"delay": start}, step, "delay double")
