"""The operators' queries against their SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from textloom.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, small, name):
    db = duckdb.connect()
    for p in Path(small).glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    want = db.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, small)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(str, (tuple(r) for r in got.select(columns).collect()))) == sorted(map(str, want.fetchall()))
