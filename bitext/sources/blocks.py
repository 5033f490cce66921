"""Block scans: documents and pages to ordered text blocks (doc_id, seq, text)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitext.functions.compat import strip
from bitext.functions.predicates import non_blank
from bitext.ranks import Ordered

from . import elements
from .elements import BLOCK_TAGS  # noqa: F401

#: Characters that leave a task at once.
PIECE = 1 << 20
# Lines that stand alone, characters of East Asian text, marks that end a paragraph.
SPECIAL_LINE = r"^(?:[0-9]+(?:\.[0-9]+)*|\*|-|•|◆|Section|Chapter|Title|Page)(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
EAST_ASIAN_END = r"[぀-ヿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ]\z"
CLOSING_MARK = r"[.:!?。！？’”」]\z"


def scan_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One block per line."""
    return df.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(text, "\n")).alias("seq", "text"))


def scan_elements(df: DataFrame, html: str, only_text: bool = True, seq: str = "seq") -> DataFrame:
    """``df`` with a row (``seq``, tag, text: the inner markup) a block element in place of ``html``; by default of elements with text.

    Rows leave a task in batches of about ``PIECE`` characters, whatever the size of what comes in.
    """
    keep = [f for f in df.schema if f.name != html]
    schema = T.StructType([*keep, T.StructField(seq, T.IntegerType()), T.StructField("tag", T.StringType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest, pages = batch.select([f.name for f in keep]), batch.column(html)
            at, size = ([], [], [], []), 0
            for row in range(len(pages)):
                page = pages[row].as_py()
                if page is not None:
                    found = elements.blocks(page) if only_text else ((tag, page[a:b]) for tag, _, a, b, _ in elements.elements(page))
                    for n, (tag, inner) in enumerate(found):
                        for values, x in zip(at, (row, n, tag, inner), strict=True):
                            values.append(x)
                        size += len(inner)
                if at[0] and (size >= PIECE or row == len(pages) - 1):
                    new = [pa.array(x, t) for x, t in zip(at[1:], (pa.int32(), pa.string(), pa.string()), strict=True)]
                    yield pa.RecordBatch.from_arrays([*rest.take(pa.array(at[0], pa.int32())).columns, *new], names=[*rest.schema.names, seq, "tag", "text"])
                    at, size = ([], [], [], []), 0

    return df.mapInArrow(run, schema)


def scan_html_blocks(df: DataFrame, html: str = "html", doc_id: str = "page_id") -> DataFrame:
    """doc_id, seq, tag, text (inner markup) of block elements that have text."""
    return scan_elements(df.select(F.col(doc_id).alias("doc_id"), F.col(html).cast("string").alias("html")), "html")


def scan_markdown(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Blocks between blank lines; blank blocks go, but leave their ordinal unused."""
    found = df.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(text, r"\r?\n\r?\n")).alias("seq", "text"))
    return found.where(non_blank(F.col("text")))


def scan_paged_text(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, page_index, text: trimmed pages between form feeds, numbered without empty ones."""
    pages = F.filter(F.transform(F.split(text, "\f"), strip), lambda p: p != "")
    return df.select(F.col(doc_id).alias("doc_id"), F.posexplode(pages).alias("page_index", "text"))


def reconstruct_paragraphs(lines: DataFrame) -> DataFrame:
    """Paragraphs (doc_id, seq, text) from raw lines (doc_id, seq, text).

    Whether a line starts a paragraph depends on it and its predecessor only: runs between
    starts are numbered by a running sum and glued in order.
    """
    rows, order = _line_kinds(lines), Window.partitionBy("doc_id").orderBy("seq")
    starts = _starts(F.lag(F.struct("blank", "special", "closes")).over(order))
    return _glued(rows.withColumn("run", F.sum(F.when(starts, 1).otherwise(0)).over(order)))


def reconstruct_long_paragraphs(lines: DataFrame) -> DataFrame:
    """As ``reconstruct_paragraphs``, for documents larger than a task: their lines are dealt by ranges."""
    rows = Ordered(_line_kinds(lines), ["doc_id"], ["seq"]).previous(F.struct("blank", "special", "closes"), "before")
    return _glued(rows.running(F.when(_starts(F.col("before")), 1).otherwise(0), "run").result())


def _line_kinds(lines: DataFrame) -> DataFrame:
    rows = lines.select("doc_id", "seq", strip(F.col("text")).alias("line"))
    special = F.col("line").rlike(SPECIAL_LINE) | (F.length("line") < 25)
    closes = F.col("line").rlike(CLOSING_MARK) | (F.length("line") < 50)
    return rows.select("*", (F.col("line") == "").alias("blank"), special.alias("special"), closes.alias("closes"))


def _starts(before: Column) -> Column:
    """Whether a line starts a run, by the kinds of the line before."""
    return before.isNull() | before["blank"] | before["special"] | before["closes"] | F.col("blank") | F.col("special")


def _glued(rows: DataFrame) -> DataFrame:
    parts = rows.where(~F.col("blank")).groupBy("doc_id", "run").agg(F.min("seq").alias("seq"), F.array_sort(F.collect_list(F.struct("seq", "line"))).alias("lines"))
    return parts.select("doc_id", "seq", strip(F.aggregate(F.transform("lines", lambda x: x["line"]), F.lit(""), _glue)).alias("text"))


def _glue(text: Column, line: Column) -> Column:
    joined = F.when(text.endswith("-"), F.concat(F.left(text, F.length(text) - 1), line))
    return F.when(text == "", line).otherwise(joined.when(text.rlike(EAST_ASIAN_END), F.concat(text, line)).otherwise(F.concat(text, F.lit(" "), line)))


def number_blocks(df: DataFrame, order: str = "seq", long: bool = False) -> DataFrame:
    """Defaults of raw blocks: zero-based ids and paths in document order, kind paragraph, text never null.

    ``long``: for documents larger than a task.
    """
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(order)) - 1
    df = Ordered(df, ["doc_id"], [order]).number("place").result() if long else df.withColumn("place", place)
    n = F.col("place").cast("string")
    kind = F.col("node_type") if "node_type" in df.columns else F.lit(None).cast("string")
    return df.withColumns({
        "block_id": F.concat(F.lit("block-"), n), "dom_path": F.concat(F.lit("body/p["), n, F.lit("]")),
        "node_type": F.coalesce(kind, F.lit("paragraph")), "text": F.coalesce("text", F.lit("")),
    }).drop("place")
