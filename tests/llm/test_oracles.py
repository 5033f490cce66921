"""Queries of the training-data operators against their SQL twins."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from bitext.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    cursor = con.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    got = QUERIES[name](spark, SF)
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(tuple, got.select(columns).collect()), key=repr) == sorted(cursor.fetchall(), key=repr)
