import collections

import numpy as np
import pytest

from textloom.llm import sharding as s


def brute(shards, size):
    orders = []
    for name in shards:
        at, step = s._hash(f"{name}#start") % size, s._hash(f"{name}#step") % (size - 1) + 1
        orders.append([(at + step * k) % size for k in range(size)])
    table = [-1] * size
    while -1 in table:
        for k, order in enumerate(orders):
            free = next((x for x in order if table[x] < 0), None)
            if free is not None:
                table[free] = k
    return table


@pytest.mark.parametrize(("n", "size"), [(1, 7), (3, 101), (10, 499), (7, 7)])
def test_table_equals_brute_force(n, size):
    assert s.lookup_table(s.names(n), size).tolist() == brute(s.names(n), size)


def test_shards_are_even_and_few_rows_move():
    before, after = s.lookup_table(s.names(64)), s.lookup_table(s.names(65))
    sizes = collections.Counter(before.tolist()).values()
    assert max(sizes) - min(sizes) <= 1
    assert np.mean((before != after) & (after != 64)) < 0.02
    with pytest.raises(ValueError):
        s.lookup_table([])


def test_placement(spark, small):
    import duckdb

    from textloom.llm.queries import SHARDS, op2_permutation_shards

    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{small}/documents.parquet')")
    want = sorted(db.execute(s.oracle_sql(s.names(SHARDS))).fetchall())
    assert sorted(map(tuple, op2_permutation_shards(spark, small).select("doc_id", "slot", "shard").collect())) == want
    rows = spark.createDataFrame([(None, 1), ("a", 1), ("a", 2)], "k string, slot int")
    out = s.place(rows, "k", s.names(4))
    assert out.count() == 3 and out.columns == ["k", "slot", "shard"]
    assert len({r["shard"] for r in out.where("k = 'a'").collect()}) == 1
    assert s.place(rows.limit(0), "k", s.names(4)).count() == 0
