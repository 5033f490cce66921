"""Sinks that put documents together again."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitext.sources import elements
from bitext.sources.blocks import PIECE


def _ordered(order: str, text: str) -> Column:
    """Texts of a group in order, as an array."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text])


def assemble_paged(bitext: DataFrame) -> DataFrame:
    """doc_id, text from doc_id, page_index, seq, original, translated (null: the original)."""
    rows = bitext.select("doc_id", "page_index", "seq", F.coalesce("translated", "original").alias("text"))
    pages = rows.groupBy("doc_id", "page_index").agg(F.array_join(_ordered("seq", "text"), "\n\n").alias("text"))
    return pages.groupBy("doc_id").agg(F.array_join(_ordered("page_index", "text"), "\n\n---\n\n").alias("text"))


def assemble_markdown(blocks: DataFrame, bitext: DataFrame) -> DataFrame:
    """All ``blocks`` (doc_id, seq, text), blank ones kept, with translations at their ordinals."""
    rows = blocks.join(bitext.select("doc_id", "seq", "translated"), ["doc_id", "seq"], "left")
    rows = rows.select("doc_id", "seq", F.coalesce("translated", "text").alias("text"))
    return rows.groupBy("doc_id").agg(F.array_join(_ordered("seq", "text"), "\n\n").alias("text"))


def assemble_html(pages: DataFrame, bitext: DataFrame, html: str = "html", page_id: str = "page_id") -> DataFrame:
    """page_id, html with the n-th block element's inner markup replaced by the n-th translation.

    ``bitext`` has doc_id, seq, translated with the seq of ``scan_html_blocks``; blocks without
    text and blocks without a translation stay. Rows have no order, so of several translations
    of one place the greatest, by code points, counts.
    """
    one = bitext.where(F.col("translated").isNotNull()).groupBy("doc_id", F.col("seq").cast("int").alias("seq")).agg(F.max("translated").alias("translated"))
    texts = one.groupBy("doc_id").agg(F.collect_list(F.struct("seq", "translated")).alias("t"))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, first, size = [], 0, 0
            for row, (page, given) in enumerate(zip(batch.column("html"), batch.column("t"), strict=True), 1):
                page, given = page.as_py(), given.as_py()
                done.append(page if page is None or not given else elements.rewritten(page, {x["seq"]: x["translated"] for x in given}))
                size += len(page or "")
                if size >= PIECE or row == len(batch):
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id")[first:row], pa.array(done, pa.string())], names=[page_id, "html"])
                    done, first, size = [], row, 0

    rows = pages.select(F.col(page_id).alias("doc_id"), F.col(html).alias("html")).join(texts, "doc_id", "left")
    return rows.select("doc_id", "html", "t").mapInArrow(rewrite, T.StructType([T.StructField(page_id, pages.schema[page_id].dataType), T.StructField("html", T.StringType())]))
