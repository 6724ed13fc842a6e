"""Greedy batches and sub-batches of keys of any size, without a fold over the key.

A greedy batch depends only on the row it starts with: from any row, where the next
batch would start is found by looking at most one batch ahead.  So every row of a
chunk gets a pointer to the next start, the chunks' pointers are stitched together, and only then the true
starts are known: a chunk says, for each place where a batch may enter it, where it leaves, and
these small tables are chained by key.  Sub-batches by ratio are the same over lengths: a
group's first length says which length starts the next group, and pointers are doubled.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from textloom.operators.batching import Budget
from textloom.operators.ordering import free, joined, numbered, stored

#: Rows of a chunk, if a batch has no more items.
CHUNK = 1 << 15

_REASONS = np.array([None, "solo_seq_overflow", "exceeds_max_batch_tokens", "exceeds_batch_max_items"], object)


def next_starts(most: np.ndarray, texts: np.ndarray, tokens: np.ndarray, budget: Budget, own: int) -> tuple[np.ndarray, np.ndarray]:
    """For a batch that starts at each of the first ``own`` rows: the row it refuses (the number of rows if none), and whether it was full then."""
    b, n = budget, len(most)
    starts = np.arange(own)
    items, longest, total = texts[:own].copy(), most[:own].copy(), tokens[:own].copy()
    out, full = np.full(own, n), np.zeros(own, bool)
    step = 0
    while len(starts):
        step += 1
        at = starts + step
        inside = at < n
        starts, items, longest, total, at = starts[inside], items[inside], longest[inside], total[inside], at[inside]
        wider, more = np.maximum(longest, most[at]), items + texts[at]
        load = wider * more if b.padded else total + tokens[at]
        refused = (wider > b.longest) | (more > b.items) | (load >= b.tokens)
        if b.padded and b.length_ratio > 0:
            refused |= (longest > 0) & (most[at] > longest * b.length_ratio)
        here = starts[refused]
        out[here] = at[refused]
        full[here] = (items[refused] >= b.items) | ((longest[refused] * items[refused] if b.padded else total[refused]) >= b.tokens)
        stay = ~refused
        starts, items, longest, total = starts[stay], more[stay], wider[stay], total[stay] + tokens[at[stay]]
    return out, full


def exits(out: np.ndarray, full: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a start at each of the first ``entries`` rows: the first start after the chunk, whether the batch before it was full, and how many starts the chunk has."""
    own = len(out)
    at, was, count = np.arange(min(entries, own)), np.zeros(min(entries, own), bool), np.zeros(min(entries, own), np.int64)
    # pointers are doubled until all lead out of the chunk
    jump, last, hops = out.copy(), full.copy(), np.ones(own, np.int64)
    while (jump < own).any():
        inner = np.flatnonzero(jump < own)
        to = jump[inner]
        jump[inner], last[inner], hops[inner] = jump[to], last[to], hops[inner] + hops[to]
    at, was, count = jump[at], last[at], hops[at]
    return at - own, was, count


def _columns(table: pa.Table, names: list[str]) -> list[np.ndarray]:
    return [table[c].to_numpy().astype(np.int64) for c in names]


def packed(rows: DataFrame, keys: list[str], order: list[str], budget: Budget, length: str = "len", texts: str | None = None, total: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """``rows`` with batch (from 1 in each key), head, carried and reason, as ``batching.packed`` gives, for keys of any size.

    The order must tell a key's rows apart.  A null length counts as 0, and an item has at least one text.  A key is cut
    into chunks by position, of ``chunk`` rows or one batch's items if these are more; no task has more than a chunk, one batch ahead of it, and the
    table of a key's chunks.
    """
    size, look = max(chunk, budget.items), budget.items
    pos, block, most, n, tokens = free(rows.columns, "__pos", "__chunk", "__most", "__texts", "__tokens")
    wide = F.coalesce(F.col(length).cast("long"), F.lit(0))
    placed = numbered(rows, keys, list(order), pos).withColumns({
        block: F.floor(F.col(pos) / size),
        most: wide,
        n: F.greatest(F.coalesce(F.col(texts), F.lit(1)).cast("long"), F.lit(1)) if texts else F.lit(1).cast("long"),
        tokens: F.coalesce(F.col(total).cast("long"), F.lit(0)) if total else wide,
    })
    # a chunk's first rows are also looked at by the batches of the chunk before
    ahead = (F.col(pos) % size < look) & (F.col(block) > 0)
    both = F.explode(F.when(ahead, F.array(block, F.col(block) - 1)).otherwise(F.array(block)))
    light = placed.select(*keys, both.alias(block), pos, most, n, tokens)
    of_key = T.StructType([rows.schema[k] for k in keys])
    arrow_keys, own_columns = _arrow_schema(of_key), rows.columns

    def leave(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by(pos)
        at, *rest = _columns(table, [pos, most, n, tokens])
        own = int((at // size == key[-1].as_py()).sum())
        to, was, count = exits(*next_starts(*rest, budget, own), look)
        made = {"leaves": [to.tolist()], "was_full": [was.tolist()], "starts": [count.tolist()]}
        return pa.table([*[pa.array([k.as_py()], f.type) for k, f in zip(key[:-1], arrow_keys, strict=True)], pa.array([key[-1].as_py()], pa.int64()), *made.values()], names=[*keys, block, *made])

    def enter(key: tuple, table: pa.Table) -> pa.Table:
        at, full, done, out = 0, None, 0, []
        for r in table.sort_by(block).select(["leaves", "was_full", "starts"]).to_pylist():
            out.append((at, full, done))
            if at < len(r["leaves"]):
                at, full, done = r["leaves"][at], r["was_full"][at], done + r["starts"][at]
        entry, was, before = zip(*out, strict=True)
        return table.sort_by(block).select([*keys, block]).append_column("entry", pa.array(entry, pa.int64())).append_column("entry_full", pa.array(was, pa.bool_())).append_column("before", pa.array(before, pa.int64()))

    def kind(more: str) -> T.StructType:
        return T.StructType([*of_key.fields, T.StructField(block, T.LongType()), *T.StructType.fromDDL(more).fields])

    left = light.groupBy(*keys, block).applyInArrow(leave, kind("leaves array<long>, was_full array<boolean>, starts array<long>"))
    entries = left.groupBy(*keys).applyInArrow(enter, kind("entry long, entry_full boolean, before long"))
    known = joined(placed, entries, [*keys, block])
    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL("batch long, head boolean, carried boolean, reason string").fields])

    def mark(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by(pos)
        rest = _columns(table, [most, n, tokens])
        entry, full, before = (table[c][0].as_py() for c in ("entry", "entry_full", "before"))
        size_here = table.num_rows
        out, was = next_starts(*rest, budget, size_here)
        head, carried = np.zeros(size_here, bool), np.zeros(size_here, bool)
        at = entry
        while at < size_here:
            head[at] = True
            # a key's first batch follows none
            carried[at] = full is not None and not full
            at, full = int(out[at]), bool(was[at])
        load = rest[0] * rest[1] if budget.padded else rest[2]
        why = np.where(rest[1] > budget.items, 3, np.where(load >= budget.tokens, 2, np.where(rest[0] > budget.longest, 1, 0)))
        reason = np.where(head, _REASONS[why], None)
        done = [pa.array(before + np.cumsum(head)), pa.array(head), pa.array(carried), pa.array(reason, pa.string())]
        return pa.table([*[table[c] for c in own_columns], *done], names=schema.names)

    return known.groupBy(*keys, block).applyInArrow(mark, schema)


def _arrow_schema(of: T.StructType) -> list[pa.Field]:
    from pyspark.sql.pandas.types import to_arrow_schema

    return list(to_arrow_schema(of))


def length_groups(rows: DataFrame, keys: list[str], length: str = "len", ratio: float = 2.0, group: str = "group") -> DataFrame:
    """``rows`` with ``group`` (int, from 0, longest first): a group's longest is at most ``ratio`` times each of its lengths, as 32-bit floats divide.

    A key is one request, of any size.  Only its distinct lengths, no more than the longest has tokens, are ordered by key.  A length
    points to the longest one that its group refuses; from the longest, starts of groups are reached by doubling the pointers, in as
    many rounds as the logarithm of the groups.  A length below 1 or null counts as 1, a ratio of at most 1 or NaN gives one group.
    Lengths of 2**24 and more, which 32-bit floats don't tell apart, are compared as they are.
    """
    if math.isnan(ratio) or ratio <= 1:
        return rows.withColumn(group, F.lit(0))
    (n,) = free(rows.columns, "__len")
    sized = rows.withColumn(n, F.greatest(F.coalesce(F.col(length).cast("long"), F.lit(1)), F.lit(1)))
    lengths = stored(sized.select(*keys, n).distinct())
    refuses = lambda l: (F.col(n).cast("float") / l.cast("float")).cast("float") > F.lit(ratio).cast("float")
    guess = F.floor(F.col(n) / float(np.float32(ratio)))
    # the division's rounding moves the limit by one or two at most
    limit = F.greatest(*[F.when((guess + d > 0) & refuses(guess + d), guess + d).otherwise(F.lit(0)) for d in range(-2, 3)])
    both = lengths.select(*keys, F.col(n).alias("v"), F.lit(0).alias("asks"), F.col(n).alias("is"), F.lit(None).cast("long").alias("of")).union(lengths.select(*keys, limit, F.lit(1), F.lit(None).cast("long"), n))
    last = Window.partitionBy(*keys).orderBy("v", "asks").rowsBetween(Window.unboundedPreceding, 0)
    asked = both.withColumn("to", F.last("is", ignorenulls=True).over(last)).where("asks = 1 and to is not null")
    pointers = stored(asked.select(*keys, F.col("of").alias("n"), "to"))
    starts, hop = stored(lengths.groupBy(*keys).agg(F.max(n).alias("n")).withColumn("depth", F.lit(0))), 1
    while True:
        further = stored(joined(starts, pointers, [*keys, "n"]).select(*keys, F.col("to").alias("n"), (F.col("depth") + hop).alias("depth")))
        if further.isEmpty():
            break
        starts, hop = stored(starts.union(further)), hop * 2
        pointers = stored(joined(pointers.withColumnsRenamed({"n": "from", "to": "n"}), pointers, [*keys, "n"]).select(*keys, F.col("from").alias("n"), "to"))
    marks = lengths.select(*keys, F.col(n).alias("v"), F.lit(None).cast("int").alias("depth"), F.lit(True).alias("asks")).union(starts.select(*keys, "n", "depth", F.lit(False)))
    down = Window.partitionBy(*keys).orderBy(F.desc("v"), "asks").rowsBetween(Window.unboundedPreceding, 0)
    grouped = marks.withColumn(group, F.last("depth", ignorenulls=True).over(down)).where("asks").select(*keys, F.col("v").alias(n), group)
    return joined(sized, grouped, [*keys, n]).drop(n)
