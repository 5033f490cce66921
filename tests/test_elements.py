"""The linear block scan against the pattern that it stands for."""

from __future__ import annotations

import random
import re
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bitext.operators import assemble
from bitext.sources import blocks, containers, elements

PATTERN = re.compile(rf"(?is)<({'|'.join(elements.BLOCK_TAGS)})\b([^>]*)>(.*?)</\1>")


def by_pattern(html):
    return [(m[1].lower(), m.start(), m.start(3), m.end(3), m.end()) for m in PATTERN.finditer(html)]


@pytest.mark.parametrize("seed", range(6))
def test_elements_equal_the_pattern(seed):
    r = random.Random(seed)
    pieces = ["<p>", "</p>", "<P class='a'>", "</P>", "<li>", "</li>", "<td", ">", "</td>", "<h1>", "</h1>", "</h2>", "<pé>", "<p_>", "text", " ", "<", "</p >", "<br>", "<title>", "</title>", "<blockquote\n>", "</blockquote>", "ſ", "\u212a"]
    for _ in range(400):
        html = "".join(r.choices(pieces, k=r.randint(0, 25)))
        assert list(elements.elements(html)) == by_pattern(html), html


def test_unclosed_tags_take_linear_time():
    start = time.process_time()
    assert list(elements.elements("<li>some text here</p>" * 100_000)) == []
    assert list(elements.elements("<p " * 100_000)) == [] and list(elements.elements("<p" * 100_000 + ">")) == []
    assert len(list(elements.elements("<li><p>x</p>" * 50_000))) == 50_000
    assert not elements.has_text("<<b>" * 1 + "</b> \u3000") and elements.has_text("a<")
    assert time.process_time() - start < 10


def test_blocks_of_pages(spark):
    rows = [(1, "<h1>A</h1><p> <b></b> </p><li>one<li>two</li>"), (2, None), (3, ""), (4, "<p>x")]
    df = spark.createDataFrame(rows, "page_id long, html string")
    got = blocks.scan_html_blocks(df).orderBy("doc_id", "seq").collect()
    assert [tuple(r) for r in got] == [(1, 0, "h1", "A"), (1, 1, "li", "one<li>two")]


def test_a_large_batch_of_pages_leaves_in_pieces(spark):
    page = "<p>" + "x" * 100_000 + "</p>"
    schema = spark.createDataFrame([], "doc_id long, html string").schema

    class Table:
        def __init__(self):
            self.schema, self.columns = schema, schema.names

        def mapInArrow(self, run, _):  # noqa: N802
            return list(run([pa.RecordBatch.from_pydict({"doc_id": list(range(60)), "html": [page] * 59 + [None]})]))

    out = blocks.scan_elements(Table(), "html")
    assert max(sum(len(t) for t in b.column("text").to_pylist()) for b in out) <= blocks.PIECE + 100_000 and len(out) > 4
    assert [d for b in out for d in b.column("doc_id").to_pylist()] == list(range(59))


def test_pages_are_put_together_whatever_repeats(spark):
    pages = spark.createDataFrame([(1, "<h1>A</h1>-<p> </p><p>b</p>"), (2, None), (3, "<p>x</p>")], "page_id long, html string")
    new = spark.createDataFrame([(1, 0, "Z"), (1, 0, "Y"), (1, 1, "B"), (3, 0, None), (1, 7, "no")], "doc_id long, seq int, translated string")
    got = {r.page_id: r.html for r in assemble.assemble_html(pages, new).collect()}
    assert got == {1: "<h1>Z</h1>-<p> </p><p>B</p>", 2: None, 3: "<p>x</p>"}


def test_books_keep_their_unclosed_elements(spark):
    docs = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")
    files = containers.pack_lines(docs, "epub")
    found = containers.scan_container(files, "epub")
    assert [(r.p_index, r.text) for r in found.orderBy("p_index").collect()] == [(0, "a"), (1, "b")]
    again = containers.scan_container(containers.repack(files, found.withColumn("translated", F.concat("text", F.lit("!"))), "epub"), "epub")
    assert sorted(r.text for r in again.collect()) == ["a!", "b!"]


def test_files_are_repacked_row_by_row_not_group_by_group(spark):
    files = containers.pack_lines(spark.createDataFrame([(1, "one\ntwo & three"), (2, None)], "doc_id int, text string"), "docx")
    new = spark.createDataFrame([("1.docx", "word/document.xml", 1, "zwei"), ("1.docx", "word/document.xml", 0, None)], "doc_id string, part string, p_index int, translated string")
    again = containers.repack(files, new, "docx")
    assert "CoGroup" not in again._jdf.queryExecution().optimizedPlan().toString()
    assert again.count() == 2
    assert [r.text for r in containers.scan_container(again, "docx").orderBy("p_index").collect()] == ["one", "zwei"]
