"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a table of prime size: a start and a
step from two hashes of its name, whose multiples visit each slot once.  Shards take turns;
at its turn a shard claims the first slot of its order that is free.  A row's place is its
key's hash modulo the table's size, so placement is one lookup, shards have equal parts
of the table within one slot, and adding or removing a shard moves few other rows.

The table has a fixed size (``TABLE_SIZE`` rows), so it is sent to every executor; rows are not
shuffled, and a frequent key is no larger a task than others.

Defined results: a null key counts as the empty text; equal keys go to the same
shard; an empty table gives an empty table; without shards there is an error; the
result has the key, ``slot`` and ``shard`` only, so other columns can't clash.
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

#: Prime, and some hundred times the number of shards.
TABLE_SIZE = 16_381


def names(count: int) -> list[str]:
    return [f"shard-{k:04d}" for k in range(count)]


def _hash(text: str) -> int:
    return int(md5(text.encode()).hexdigest()[:8], 16)


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> np.ndarray:
    """The shard (place in ``shards``) that claims each slot."""
    if not shards:
        raise ValueError("there are no shards")
    if len(set(shards)) < len(shards) or len(shards) > size:
        raise ValueError("shards need different names, and no more of them than slots")
    at = [_hash(f"{s}#start") % size for s in shards]
    step = [_hash(f"{s}#step") % (size - 1) + 1 for s in shards]
    table = np.full(size, -1, np.int32)
    for turn in range(size):
        k = turn % len(shards)
        while table[at[k]] >= 0:
            at[k] = (at[k] + step[k]) % size
        table[at[k]] = k
    return table


def slot(key: Column, size: int = TABLE_SIZE) -> Column:
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % size).cast("int")


def place(rows: DataFrame, key_col: str, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """Key, slot and shard of each row."""
    table = lookup_table(shards, size)
    slots = rows.sparkSession.createDataFrame([(i, shards[k]) for i, k in enumerate(table.tolist())], "slot int, shard string")
    return rows.select(F.col(key_col), slot(F.col(key_col), size).alias("slot")).join(F.broadcast(slots), "slot").select(key_col, "slot", "shard")


def oracle_sql(shards: list[str], size: int = TABLE_SIZE) -> str:
    """DuckDB SQL for the placement, by the table as a list."""
    table = ",".join(map(str, lookup_table(shards, size).tolist()))
    return f"""
        WITH t AS (SELECT [{table}] AS claimed),
             d AS (SELECT doc_id, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % {size})::INT AS slot FROM documents)
        SELECT doc_id, slot, 'shard-' || lpad(claimed[slot + 1]::VARCHAR, 4, '0') AS shard FROM d, t
    """
