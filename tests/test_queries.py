"""Every registered query of the engine against its SQL twin, and the entry points."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_module
from bitext.plans import replies
from bitext.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def rows(df: pd.DataFrame) -> list[tuple[str, ...]]:
    df = df[sorted(df.columns)]
    plain = lambda x: "null" if x is None or x is pd.NaT or x != x else f"{x:.6f}" if isinstance(x, float) else str(x)
    return sorted(tuple(plain(x) for x in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"r3_evict_stale_sessions"}))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_numbered_lines_of_odd_texts(spark, tmp_path):
    texts = ["a\r\nb\rc\n\r\nd\x85e\nf\ng\u2028h\u2029", "", "a\n", "\n\n \n\n\t\n\u3000\n", "[0] x\n[2]\n[2] \n [1] y", None, "[99999999999999999999] x"]
    docs = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    docs.to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    assert rows(QUERIES["e4_parse_numbered"](spark, str(tmp_path)).toPandas()) == rows(con.execute(ORACLES["e4_parse_numbered"]).df())


def test_numbered_lines_of_odd_replies(spark):
    lines = spark.createDataFrame([(1, 0, i, f"s{i}") for i in range(4)] + [(1, 0, 4, " ")], "doc_id long, batch long, idx long, text string")
    reply = " [0] a\rb \r\n[1]\n[2] \u3000\n[99999999999999999999] x\n[3] c\n[3]d\n[4] e"
    got = replies.parse_numbered(lines, spark.createDataFrame([(1, 0, reply)], "doc_id long, batch long, reply string"))
    assert {r.idx: r.translated for r in got.collect()} == {0: "a\rb", 1: "s1", 2: "s2", 3: "d", 4: " "}


@pytest.mark.parametrize("name", ["e8_parse_plan_reply", "e9_parse_issues_reply"])
def test_replies_hold_whole_texts(spark, monkeypatch, name):
    from bitext import queries

    seen = []
    parse = getattr(queries.replies, name[3:])
    monkeypatch.setattr(queries.replies, name[3:], lambda rows: seen.append(rows) or parse(rows))
    QUERIES[name](spark, SF)
    assert "left(" not in seen[0]._jdf.queryExecution().analyzed().toString().lower().replace("left(outer", "")
