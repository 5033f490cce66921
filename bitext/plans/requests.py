"""Requests of the batch-inference job: one row per block, batch or document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitext.operators.match import ranked, relevant_glossary
from bitext.operators.workspace import chunk, context_window

# Model name parts that mark a pure translator.
DEDICATED = ("translategemma", "translation-", "nllb", "m2m100", "seamless")
INSTRUCTIONS = {
    "Concise": "Keep the translation within 1.2 times the original length.",
    "PreserveLayout": "Keep line breaks, indentation and order exactly.",
    "ExpandAllowed": "The translation may be longer than the original.",
}
ACTIONS = {
    "fit_to_bbox": "Shorten the translation so that it fits its box.",
    "formalize": "Rewrite the translation in a formal register.",
    "naturalize": "Rewrite the translation so that it reads naturally.",
}
STYLES = {"formal": "formal and precise", "casual": "casual and friendly", "concise": "as short as possible"}


def _samples(blocks: DataFrame, n: int) -> DataFrame:
    """The first ``n`` blocks of each document, with their place from 1."""
    order = Window.partitionBy("doc_id").orderBy("seq")
    return blocks.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def _sorted(*fields: str) -> Column:
    return F.array_sort(F.collect_list(F.struct(*fields)))


def planner_requests(docs: DataFrame, blocks: DataFrame, glossary: DataFrame, samples: int = 20, terms: int = 100) -> DataFrame:
    """doc_id, total_blocks, summaries (JSON), samples (text), prompt.

    Summaries hold every block, cut to 200 characters, in order; samples are the first blocks,
    cut to 300.
    """
    per_doc = blocks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total_blocks"), _sorted("seq", "block_id", F.left("text", F.lit(200)).alias("text"), "node_type").alias("b"))
    per_doc = per_doc.withColumn("summaries", F.to_json(F.transform("b", lambda x: F.struct(x["block_id"].alias("blockId"), x["text"].alias("text"), x["node_type"].alias("nodeType"))))).drop("b")
    first = _samples(blocks, samples).select("doc_id", "seq", F.concat(F.lit("["), "block_id", F.lit("] ("), "node_type", F.lit("): "), F.left("text", F.lit(300))).alias("line"))
    first = first.groupBy("doc_id").agg(F.array_join(F.transform(_sorted("seq", "line"), lambda x: x["line"]), "\n\n").alias("samples"))
    # At most ``terms`` rows in one.
    known = glossary.orderBy("ord").limit(terms).agg(F.to_json(F.transform(_sorted("ord", "source", "target"), lambda x: F.struct(x["source"].alias("source"), x["target"].alias("target")))).alias("terms"))
    rows = docs.join(per_doc, "doc_id").join(first, "doc_id").join(F.broadcast(known))
    prompt = F.concat(
        F.lit('Document: "'), "file_name", F.lit('" ('), "file_type", F.lit(")\nSource language: "), "source_lang", F.lit("\nTarget language: "), "target_lang", F.lit("\nDomain: "), "domain",
        F.lit("\nTotal blocks: "), F.col("total_blocks").cast("string"), F.lit("\n\nBlocks:\n"), "summaries", F.lit("\n\nSamples:\n"), "samples", F.lit("\n\nKnown terms:\n"), "terms",
        F.lit("\n\nAnswer with the plan as JSON: glossary, styleGuide, blockConstraints, estimatedExpansionRatio."),
    )
    return rows.select("doc_id", "total_blocks", "summaries", "samples", prompt.alias("prompt"))


def executor_requests(bitext: DataFrame, glossary: DataFrame, model: str = "chat", source_lang: str = "English", target_lang: str = "Chinese (Simplified)") -> DataFrame:
    """doc_id, seq, block_id, n_terms, n_context, temperature, max_tokens, prompt per block.

    Blocks have original, translated (what memory knows, or null), constraint, node_type and
    style_guide. Of several targets of one source the last by ``ord`` counts.
    """
    last = glossary.groupBy("source").agg(F.max_by("target", "ord").alias("target"))
    hits = relevant_glossary(bitext, last, ("doc_id", "seq"), "original")
    hits = hits.groupBy("doc_id", "seq").agg(F.count(F.lit(1)).alias("n_terms"), F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "target"))))).alias("terms"))
    rows = context_window(bitext).join(hits, ["doc_id", "seq"], "left")
    concise = F.col("constraint") == "Concise"
    advice = F.coalesce(F.create_map(*(F.lit(x) for kv in INSTRUCTIONS.items() for x in kv))[F.col("constraint")], F.lit(INSTRUCTIONS["ExpandAllowed"]))
    lines = F.transform("context", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] Original: "), x["original"], F.lit("\n    Translated: "), F.coalesce(x["translated"], F.lit(""))))
    context = F.when(F.size("context") > 0, F.concat(F.lit("Context:\n"), F.array_join(lines, "\n\n"))).otherwise("This is the first block. No prior context available.")
    known = F.coalesce(F.concat(F.lit("Use exactly these terms:\n"), "terms"), F.lit("No glossary terms found in this block."))
    long = F.concat(
        F.lit(f"Source language: {source_lang}\nTarget language: {target_lang}\nBlock ID: "), "block_id", F.lit("\nConstraint: "), "constraint", F.lit("\n"), advice, F.lit("\nStyle guide: "), "style_guide",
        F.lit("\n\n"), known, F.lit("\n\n"), context, F.lit("\n\nText:\n"), "original", F.lit("\n\nAnswer as JSON: translatedText, preservedTags, confidence."),
    )
    short = F.concat(F.lit(f"Translate the following text from {source_lang} to {target_lang}:\n\n"), "original")
    return rows.select(
        "doc_id", "seq", "block_id", F.coalesce("n_terms", F.lit(0)).cast("long").alias("n_terms"), F.size("context").cast("long").alias("n_context"),
        F.when(concise, 0.15).otherwise(0.3).alias("temperature"), F.when(concise, F.ceil(F.length("original") * 1.5)).otherwise(4096).cast("long").alias("max_tokens"),
        (short if is_dedicated(model) else long).alias("prompt"),
    )


def is_dedicated(model: str) -> bool:
    """Whether a model only translates, and takes the short form."""
    return any(p in model.lower() for p in DEDICATED)


def review_requests(sample: DataFrame, glossary: DataFrame, terms: int = 50) -> DataFrame:
    """doc_id, blocks, prompt from the deep-check sample."""
    known = glossary.orderBy("ord").limit(terms).agg(F.to_json(F.transform(_sorted("ord", "source", "target"), lambda x: F.struct(x["source"].alias("source"), x["target"].alias("target")))).alias("terms"))
    rows = sample.groupBy("doc_id").agg(F.count(F.lit(1)).alias("blocks"), F.to_json(F.transform(_sorted("seq", "block_id", "original", "translated"), lambda x: F.struct(x["block_id"].alias("blockId"), x["original"].alias("original"), x["translated"].alias("translation")))).alias("b"))
    prompt = F.concat(F.lit("Review these translations.\nTerms:\n"), "terms", F.lit("\nBlocks:\n"), "b", F.lit("\nAnswer with a JSON array of issues: blockId, type, description, suggestion, severity."))
    return rows.join(F.broadcast(known)).select("doc_id", "blocks", prompt.alias("prompt"))


def polish_requests(bitext: DataFrame, action: str, style: str | None = None) -> DataFrame:
    """doc_id, block_id, temperature, max_tokens, prompt of one polishing action, or of a style."""
    advice = f"Rewrite the translation so that it is {STYLES[style]}." if style else ACTIONS[action]
    fit = action == "fit_to_bbox"
    prompt = F.concat(F.lit(advice + "\nOriginal: "), "original", F.lit("\nTranslation: "), "translated", F.lit("\nAnswer with the new translation only."))
    tokens = F.ceil(F.length("translated") * 1.2) if fit else F.lit(1024)
    return bitext.select("doc_id", "block_id", F.lit(0.15 if fit else 0.3).alias("temperature"), tokens.cast("long").alias("max_tokens"), prompt.alias("prompt"))


def batch_requests(blocks: DataFrame, glossary: DataFrame, size: int = 20, terms: int = 120) -> DataFrame:
    """doc_id, batch, items, payload (``{"paragraphs": [...]}``), glossary lines of the first ``terms`` terms by ``ord``."""
    known = glossary.orderBy("ord").limit(terms).agg(F.array_join(F.transform(_sorted("ord", "source", "target"), lambda x: F.concat(x["source"], F.lit(" → "), x["target"])), "\n").alias("glossary"))
    rows = chunk(blocks, size).groupBy("doc_id", "batch").agg(F.count(F.lit(1)).alias("items"), _sorted("seq", "text").alias("b"))
    rows = rows.select("doc_id", "batch", "items", F.to_json(F.struct(F.transform("b", lambda x: x["text"]).alias("paragraphs"))).alias("payload"))
    return rows.join(F.broadcast(known))


def proofread_requests(bitext: DataFrame, pairs: int = 30) -> DataFrame:
    """doc_id, pairs, prompt with the first pairs numbered."""
    line = F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] Source: "), "original", F.lit("\nTranslation: "), "translated")
    rows = _samples(bitext, pairs).select("doc_id", "place", line.alias("line")).groupBy("doc_id")
    return rows.agg(F.count(F.lit(1)).alias("pairs"), F.array_join(F.transform(_sorted("place", "line"), lambda x: x["line"]), "\n\n").alias("prompt"))


def glossary_block(terms: DataFrame, limit: int = 80) -> DataFrame:
    """One row: rule text and JSON map of the first ``limit`` terms by rank (see ``match.ranked``), empty when there is none."""
    rows = ranked(terms, limit).groupBy("source").agg(F.max_by("target", "id").alias("target"))
    entries = F.array_sort(F.collect_list(F.struct((-F.length("source")).alias("n"), "source", "target")))
    text = F.concat(F.lit("Use exactly these terms:\n"), F.to_json(F.map_from_entries(F.transform(entries, lambda e: F.struct(e["source"], e["target"])))))
    return rows.agg(F.when(F.count(F.lit(1)) > 0, text).otherwise("").alias("block"))
