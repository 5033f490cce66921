"""Layout operators over spans (doc_id, page, span_id, text, x0, y0, x1, y1, size)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitext.functions.predicates import skip_text
from bitext.functions.text import fit_font
from bitext.ranks import Ordered


def reading_order(spans: DataFrame, long: bool = False) -> DataFrame:
    """``spans`` plus ``place``: 1-based by (y0, x0) per page. ``long``: for pages larger than a task."""
    if long:
        return _ordered(spans).number("place").with_column("place", F.col("place") + 1).result()
    order = Window.partitionBy("doc_id", "page").orderBy("y0", "x0", "span_id")
    return spans.withColumn("place", F.row_number().over(order))


def _ordered(spans: DataFrame) -> Ordered:
    return Ordered(spans, ["doc_id", "page"], ["y0", "x0", "span_id"])


def group_spans_by_line(spans: DataFrame, spread: float = 1.2, least: float = 6.0, long: bool = False) -> DataFrame:
    """``spans`` plus ``line``: a gap in y of ``spread`` sizes or more starts a new one. ``long``: for pages larger than a task."""
    def starts(y: Column, size: Column) -> Column:
        return F.when(F.abs(F.col("y0") - y) >= spread * F.greatest(size, F.lit(least)), 1).otherwise(0)

    if long:
        rows = _ordered(spans).previous(F.struct("y0", "size"), "before")
        rows = rows.running(starts(F.col("before.y0"), F.col("before.size")), "line").result()
        return rows.drop("before")
    order = Window.partitionBy("doc_id", "page").orderBy("y0", "x0", "span_id")
    begun = starts(F.lag("y0").over(order), F.lag("size").over(order))
    return spans.withColumn("starts", begun).withColumn("line", F.sum("starts").over(order)).drop("starts")


def layout_audit(spans: DataFrame) -> DataFrame:
    """Per page: spans, spans that must shrink, smallest shrink factor."""
    base = F.greatest("size", F.lit(6.0))
    factor = F.round(fit_font(F.col("text"), F.col("size"), F.col("x1") - F.col("x0")) / base, 6)
    rows = spans.select("doc_id", "page", factor.alias("factor"))
    return rows.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("spans"), F.count_if(F.col("factor") < 1).alias("shrunk"), F.min("factor").alias("least_factor"))


def numbered_batch(lines: DataFrame, batch: int = 10) -> DataFrame:
    """One request per batch of kept spans: ``[idx] text`` lines in order and max_tokens."""
    kept = lines.where(~skip_text(F.col("text")))
    order = Window.partitionBy("doc_id").orderBy("page", "span_id")
    kept = kept.withColumn("n", F.row_number().over(order) - 1)
    kept = kept.select("doc_id", F.floor(F.col("n") / batch).alias("batch"), (F.col("n") % batch).alias("idx"), "text")
    entries = F.array_sort(F.collect_list(F.struct("idx", F.concat(F.lit("["), F.col("idx").cast("string"), F.lit("] "), F.col("text")).alias("line"))))
    return kept.groupBy("doc_id", "batch").agg(F.array_join(F.transform(entries, lambda e: e["line"]), "\n").alias("prompt"), (F.count(F.lit(1)) * 300).alias("max_tokens"))


def run_metadata(spans: DataFrame, bitext: DataFrame, fixes: DataFrame) -> DataFrame:
    """Per document: all spans, spans with a new text, glossary fixes."""
    total = spans.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total_spans"))
    overlaid = bitext.where("original <> translated").groupBy("doc_id").agg(F.count(F.lit(1)).alias("overlaid_count"))
    fixed = fixes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("glossary_fixes"))
    rows = total.join(overlaid, "doc_id", "left").join(fixed, "doc_id", "left")
    return rows.fillna(0, ["overlaid_count", "glossary_fixes"])
