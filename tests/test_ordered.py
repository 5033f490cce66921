"""Scans over groups of any size against windows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from bitext.operators import layout, workspace
from bitext.ranks import Ordered, with_rank
from bitext.sources import blocks
from bitext.streaming.runs import settings


@pytest.fixture(autouse=True)
def small_ranges(spark):
    """Small tables in as many ranges as large ones."""
    with settings(spark, {"spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        yield


def long_document(spark, docs=1, lines=3000, seed=1):
    r = random.Random(seed)
    rows = [(d, n, r.choice(["", "Section 2", "a line of some length, that goes on and on, over fifty", "ends here, after more than fifty characters. Yes it does.", "short"])) for d in range(docs) for n in range(lines)]
    r.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, seq int, text string")


@pytest.mark.parametrize("docs", [1, 7])
def test_long_documents_have_the_same_paragraphs(spark, docs):
    lines = long_document(spark, docs, 2000 // docs)
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(blocks.reconstruct_long_paragraphs(lines)) == key(blocks.reconstruct_paragraphs(lines)) != []


def test_one_document_uses_all_tasks(spark):
    rows = Ordered(long_document(spark), ["doc_id"], ["seq"])
    sizes = [r["count"] for r in rows.rows.groupBy("range_no").count().collect()]
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) <= 2 * 3000 / len(sizes)


def test_scans_equal_windows_on_null_and_small_groups(spark):
    r = random.Random(2)
    rows = [(r.choice([None, 1, 2, 3]), k, r.choice([None, 1, 2])) for k in range(300)] + [(k, 0, 1) for k in range(100, 130)]
    df = spark.createDataFrame(rows, "g long, k int, v int")
    got = Ordered(df, ["g"], ["k"]).previous(F.col("v"), "before").running(F.coalesce("v", F.lit(0)), "sum").number("place").result()
    want = {}
    for g, k, v in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        _, before, total, place, _ = want[g][-1] if g in want else (None, None, 0, -1, None)
        want.setdefault(g, []).append((k, v, total + (v or 0), place + 1, before))
    assert sorted(((x.g, x.k, x.before, x["sum"], x.place) for x in got.collect()), key=repr) == sorted(((g, k, b, t, p) for g, l in want.items() for k, _, t, p, b in l), key=repr)
    assert Ordered(df.limit(0), ["g"], ["k"]).previous(F.col("v"), "b").number("n").result().collect() == []


def test_long_forms_equal_the_short_ones(spark):
    lines = long_document(spark, 3, 300)
    key = lambda df, *c: sorted(tuple(r) for r in df.select(*c).collect())
    assert key(workspace.chunk(lines, 7, long=True), "doc_id", "seq", "batch") == key(workspace.chunk(lines, 7), "doc_id", "seq", "batch")
    assert key(blocks.number_blocks(lines, long=True), "doc_id", "seq", "block_id") == key(blocks.number_blocks(lines), "doc_id", "seq", "block_id")
    r = random.Random(3)
    spans = spark.createDataFrame([(k % 2, 0, k, float(r.randint(0, 400)), float(r.randint(0, 50)), float(r.randint(4, 12))) for k in range(500)], "doc_id int, page int, span_id long, y0 double, x0 double, size double")
    both = [key(layout.group_spans_by_line(spans, long=x), "span_id", "line") for x in (True, False)]
    assert both[0] == both[1]
    assert key(layout.reading_order(spans, long=True), "span_id", "place") == key(layout.reading_order(spans), "span_id", "place")


def test_ranks_over_the_whole_table(spark):
    df = spark.createDataFrame([(k * 7919 % 1000, str(k)) for k in range(1000)], "k int, t string")
    got = {r.k: r.place for r in with_rank(df, [F.col("k").desc()], "place").collect()}
    assert got == {k: 999 - k for k in range(1000)}
