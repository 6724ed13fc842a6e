"""Ordered folds: work in which each row's result depends on the rows before it.

Greedy batching, queue depth and liveness are not associative, so they can't be combined
from parts.  Rows are dealt by key, sorted inside the partition, and streamed through a
step function that holds one state at a time: a key's rows are never collected, and
memory doesn't grow with a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, types as T


def ordered_fold(rows: DataFrame, keys: list[str], order: list[str], uses: list[str], start: Callable[[], dict], step: Callable[..., tuple], out: str) -> DataFrame:
    """``rows`` with columns ``out`` (a DDL string), which ``step(state, *values of uses)`` gives for each row in turn.

    ``start()`` is the state at the first row of a key; ``step`` changes it.  Only keys and used columns leave Arrow.  A
    key's rows are one task's work, so keys should be bounded, as requests and arrival windows are.
    """
    added = T.StructType.fromDDL(out)
    schema = T.StructType([*rows.schema.fields, *added.fields])
    types = {f.name: _arrow(f.dataType) for f in added.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = object(), None
        for batch in batches:
            got = []
            columns = batch.schema.names
            of_key, used = ([batch.column(columns.index(c)).to_pylist() for c in names] for names in (keys, uses))
            for now, values in zip(zip(*of_key, strict=True), zip(*used, strict=True), strict=True):
                if now != key:
                    key, state = now, start()
                got.append(step(state, *values))
            columns = [pa.array([g[i] for g in got], types[f.name]) for i, f in enumerate(added.fields)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[f.name for f in schema.fields])

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
