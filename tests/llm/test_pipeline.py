"""The pipeline against a plain Python version of its stages."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from bitext.llm import bpe, decontam, langid  # noqa: E402

from .test_pure import naive_bayes  # noqa: E402
from .test_tables import LONG, jaccard_components, near_rows, norm  # noqa: E402

SF = "/root/testdata/sf0.001"


def digest(row):
    return hashlib.md5(f"{'' if row[0] is None else row[0]}:{row[1]}".encode()).digest()


def kept_rows(rows, items):
    """(doc_id, text) of what stays of rows (doc_id, text, lang)."""
    found = naive_bayes(rows, langid.BITS, langid.ORDERS, langid.SMOOTHING, langid.SCALE)
    rows = [(i, t) for (i, t, _), (lang, score) in zip(rows, found, strict=True) if lang != "und" and score >= 0.5]
    # The longest of equal texts stays, then the smallest id.
    best = {}
    for i, t in rows:
        rank = (-len(t), i is None, i or 0)
        if norm(t) not in best or rank < best[norm(t)][0]:
            best[norm(t)] = (rank, (i, t))
    rows = sorted((row for _, row in best.values()), key=lambda r: (r[0] is None, r[0] or 0, digest(r)))
    # One row of each component: the smallest id, none last.
    numbered = [(k, t) for k, (_, t) in enumerate(rows)]
    rows = [rows[k] for k, _, c in jaccard_components(numbered, 5, 80) if c == k]
    p = decontam.Patterns(items)
    return [(i, t) for i, t in rows if not p.search([p.ids.get(w, 0) for w in decontam.words(t)])[0]]


def results(rows):
    out = []
    for i, t in rows:
        ids = bpe.codec().encode(t)
        out.append((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = kept_rows([(r.doc_id, r.text, r.lang) for r in docs.collect()], items)
    got = [tuple(r) for r in corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert sorted(got, key=repr) == results(want) != []


def test_pipeline_on_edge_cases(spark, tmp_path):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing names, through all stages."""
    r = random.Random(12)
    word = lambda: "".join(r.choices("aeioulnrst", k=r.randint(2, 8)))
    leak = " ".join(f"bench{k} mark" for k in range(8))
    rows = [(k, " ".join(word() for _ in range(40)), "en") for k in range(30)]
    rows += [(100 + k, " ".join(word().translate({97: "ä", 101: "ö"}) for _ in range(40)), "de") for k in range(30)]
    rows += [(i, t.replace("w", "wo"), "en") for i, t in near_rows(20, 60, 4, 3, 200)]
    rows += [(None, rows[70][1] + " tail", None), (None, rows[70][1] + " tail", None), (7, rows[71][1] + " end", "en"), (None, rows[72][1] + " two ends", "en")]
    rows += [(300, None, "en"), (301, "", "en"), (302, "12 34 !", "en"), (None, None, None), (303, "word", None), (304, LONG + " and more of it " * 30000, "en")]
    rows += [(305, "some words before " + leak.upper() + " and after", "en"), (306, "same text twice", "en"), (306, "same text twice", "en"), (306, "same  text\ttwice", "en"), (310, "same text  twice", "en"), (None, "sametexttwice", None)]
    extra = [(*row, None if k % 3 else "s", None if k % 2 else k, "x", 1.5, b"k", k) for k, row in enumerate(rows)]
    names = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score double, row_key binary, other_key int"
    df = spark.createDataFrame(extra, names).withColumns({"near_key": F.lit(1), "n": F.lit("n"), "k": F.lit("k"), "hits": F.lit(2.0), "sig": F.lit(None).cast("string"), "key": F.lit("z")})
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = kept_rows(rows, [("1", leak)])
    got = [tuple(x) for x in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert sorted(got, key=repr) == results(want)
    ids = {i for i, _ in want}
    assert 304 in ids and 306 in ids and not ids & {300, 301, 302, 305, 310}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns, name
    by_id = {x.doc_id: x for x in docs.collect()}
    assert (by_id[306].row_key, by_id[306].k, by_id[306].near_key) == (bytearray(b"k"), "k", 1)


def test_stages_keep_the_columns_and_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0
