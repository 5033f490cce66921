"""The query that runs the engine end to end: scan, translate, check, summarise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitext import inputs
from bitext.functions.text import preserved_tags
from bitext.operators import checks
from bitext.plans import inference
from bitext.sources.blocks import number_blocks, scan_html_blocks
from bitext.storage import table


def issues_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, severity, blocks, issues of pages translated by the offline stub; the language is the page's."""
    pages = table(spark, sf_dir, "pages")
    langs = pages.select(F.col("page_id").alias("doc_id"), F.regexp_extract("html", '<html lang="([a-z-]*)"', 1).alias("lang"))
    blocks = number_blocks(scan_html_blocks(pages)).withColumn("original", F.col("text"))
    blocks = blocks.select("doc_id", "seq", "block_id", "original", preserved_tags(F.col("original")).alias("preserved_tags"), F.lit("Concise").alias("constraint"))
    done = inference.translate_blocks(blocks, inference.stub(inputs.GLOSSARY), text="original")
    found = checks.check_all(done, inputs.glossary(spark)).join(langs, "doc_id")
    return found.groupBy("lang", "severity").agg(F.countDistinct("doc_id", "block_id").alias("blocks"), F.count(F.lit(1)).alias("issues"))
