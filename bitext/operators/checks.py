"""Quality checks over bitext (doc_id, seq, block_id, original, translated, preserved_tags, constraint).

Issues have doc_id, block_id, type, severity, description, suggestion; ``detail`` names the
term or tag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitext.functions.compat import INLINE_TAGS
from bitext.functions.text import layout_lines_match

from .match import relevant_glossary

ISSUE = ["doc_id", "block_id", "type", "severity", "detail", "description", "suggestion"]
SEVERITIES = ("low", "medium", "high")


def severity_rank(c: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), c)


def _ratio() -> Column:
    return F.length("translated") / F.nullif(F.length("original"), F.lit(0))


def _issue(kind: str, severity: Column, detail: Column, description: Column, suggestion: Column | str) -> Column:
    suggestion = suggestion if isinstance(suggestion, Column) else F.lit(suggestion)
    return F.struct(F.lit(kind).alias("type"), severity.alias("severity"), detail.alias("detail"), description.alias("description"), suggestion.alias("suggestion"))


# What issues say, with the places of their values, and what they advise.
SHORT = "Translation is suspiciously short (%d vs %d chars, ratio %.2f). May have lost significant content."
LONG = "Translation is suspiciously long (%d vs %d chars, ratio %.2f). May contain added content or hallucinations."
OUTSIDE = "Translation length ratio %.2f is outside expected range (0.5-1.8). Verify content accuracy."
OVERFLOW = "Concise block translation exceeds 1.2x limit (%.2fx, %d vs %d chars). May cause layout overflow."
TAG_LOST = 'Tag "%s" from original was lost in translation'
ELEMENT_LOST = 'Structural element "%s" was lost'
TERM_MARKED = 'Term "%s" was marked uncertain (wrapped in <term> tags) instead of using glossary translation "%s"'
TERM_MISSING = 'Glossary term "%s" should be "%s" but was not found in translation'
SHORT_ADVICE = "Review and ensure all key information is preserved"
LONG_ADVICE = "Review and trim any content not present in the original"
OUTSIDE_ADVICE = "Check that translation preserves original meaning"
OVERFLOW_ADVICE = "Compress translation using abbreviations and shorter phrasing"
TAG_ADVICE = 'Re-insert tag "%s" at the appropriate position'
ELEMENT_ADVICE = "Restore the missing element"
TERM_ADVICE = 'Replace translation of "%s" with "%s"'
#: Characters of a lost element that its description shows.
SHOWN = 50


def drift_severity() -> Column:
    r = _ratio()
    return F.when(r < 0.2, "high").when(r > 2.5, "medium").when((r < 0.3) | (r > 1.8), "low")


def overflow_severity() -> Column:
    r = _ratio()
    return F.when((F.col("constraint") == "Concise") & (r > 1.2), F.when(r > 1.5, "high").otherwise("medium"))


def _drift() -> Column:
    new, old, r = F.length("translated"), F.length("original"), _ratio()
    said = F.when(r < 0.2, F.format_string(SHORT, new, old, r)).when(r > 2.5, F.format_string(LONG, new, old, r)).otherwise(F.format_string(OUTSIDE, r))
    advice = F.when(r < 0.2, SHORT_ADVICE).when(r > 2.5, LONG_ADVICE).otherwise(OUTSIDE_ADVICE)
    return _issue("semantic_drift", drift_severity(), F.lit(""), said, advice)


def _overflow() -> Column:
    said = F.format_string(OVERFLOW, _ratio(), F.length("translated"), F.length("original"))
    return _issue("layout_overflow", overflow_severity(), F.lit(""), said, OVERFLOW_ADVICE)


def _lost_tags() -> Column:
    """Issues of the preserved tags that the translation lacks, as an array."""
    t = F.col("translated")

    def issue(tag: Column) -> Column:
        name = F.regexp_extract(tag, r"^<([A-Za-z0-9_]+)", 1)
        # A tag whose name is there in another form is not lost.
        opened = F.when(name != "", F.rlike(t, F.concat(F.lit("(?i)<"), name, F.lit(r"[\s>]"))))
        severity = F.when(name == "", "medium").when(~opened, "high")
        said = F.when(name == "", F.format_string(ELEMENT_LOST, F.left(tag, F.lit(SHOWN)))).otherwise(F.format_string(TAG_LOST, tag))
        return _issue("tag_lost", severity, tag, said, F.when(name == "", ELEMENT_ADVICE).otherwise(F.format_string(TAG_ADVICE, tag)))

    missing = F.filter("preserved_tags", lambda tag: ~F.contains(t, tag))
    return F.transform(missing, issue)


def _local(bitext: DataFrame, issues: Column) -> DataFrame:
    return bitext.select("doc_id", "block_id", F.inline(F.filter(issues, lambda x: x["severity"].isNotNull())))


def check_drift(bitext: DataFrame) -> DataFrame:
    return _local(bitext, F.array(_drift())).select(*ISSUE)


def check_overflow(bitext: DataFrame) -> DataFrame:
    return _local(bitext, F.array(_overflow())).select(*ISSUE)


def check_tags(bitext: DataFrame) -> DataFrame:
    return _local(bitext, _lost_tags()).select(*ISSUE)


def check_terms(bitext: DataFrame, glossary: DataFrame) -> DataFrame:
    """Glossary terms of the original whose target the translation lacks."""
    keys = ("doc_id", "seq", "block_id", "translated")
    hits = relevant_glossary(bitext, glossary.where("target <> ''"), keys, "original")
    missing = hits.where(~F.contains(F.lower("translated"), F.lower("target")))
    marker = F.concat(F.lit("<term>"), F.col("source"), F.lit("</term>"))
    marked = F.contains("translated", marker)
    advice = F.format_string(TERM_ADVICE, "source", "target")
    said = F.when(marked, F.format_string(TERM_MARKED, "source", "target")).otherwise(F.format_string(TERM_MISSING, "source", "target"))
    return missing.select(
        "doc_id", "block_id", F.lit("term_mismatch").alias("type"), F.when(marked, "medium").otherwise("high").alias("severity"), F.col("source").alias("detail"),
        said.alias("description"), F.when(marked, F.replace("translated", marker, F.col("target"))).otherwise(advice).alias("suggestion"),
    )


def check_all(bitext: DataFrame, glossary: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """All checks; the three local ones share one pass over the bitext."""
    out = _local(bitext, F.concat(_lost_tags(), F.array(_drift(), _overflow()))).select(*ISSUE).unionByName(check_terms(bitext, glossary))
    return out if more is None else out.unionByName(more, allowMissingColumns=True)


def issue_summary(issues: DataFrame) -> DataFrame:
    """Counts per document by severity, and of patches that can be suggested."""
    counts = [F.count_if(F.col("severity") == s).alias(f"{s}_count") for s in reversed(SEVERITIES)]
    return issues.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"), *counts, F.count_if(_patchable()).alias("patches"))


def badges(issues: DataFrame) -> DataFrame:
    """Issue count and worst severity per block."""
    worst = F.max(severity_rank(F.col("severity")))
    named = F.element_at(F.array(*map(F.lit, SEVERITIES)), worst.cast("int"))
    return issues.groupBy("doc_id", "block_id").agg(F.count(F.lit(1)).alias("issues"), named.alias("severity"))


def valid_issues(issues: DataFrame) -> DataFrame:
    """Rows with a block, a type and a description."""
    ok = F.lit(True)
    for c in ("block_id", "type", "description"):
        ok = ok & (F.coalesce(F.col(c), F.lit("")) != "")
    return issues.where(ok)


def _patchable() -> Column:
    return (F.col("severity") == "low") & (F.coalesce("suggestion", F.lit("")) != "")


def suggest_patches(issues: DataFrame) -> DataFrame:
    return issues.where(_patchable()).select(
        "doc_id", "block_id", F.lit("native_rewrite").alias("action"), F.col("suggestion").alias("patched_text"), F.lit(0.7).alias("confidence")
    )


def apply_patches(bitext: DataFrame, patches: DataFrame, min_confidence: float = 0.7) -> DataFrame:
    """Confirmed patches (doc_id, block_id, seq, patched_text, confidence) replace translations; the last wins."""
    last = patches.where(F.col("confidence") >= min_confidence).groupBy("doc_id", "block_id").agg(F.max_by("patched_text", "seq").alias("patch"))
    return bitext.join(last, ["doc_id", "block_id"], "left").withColumn("translated", F.coalesce("patch", "translated")).drop("patch")


def tag_balance(bitext: DataFrame) -> DataFrame:
    """``bitext`` plus opens and closes (arrays by inline tag, of the translation) and ``broken``.

    Broken: the source has paired inline tags, and a tag of the source comes in another number,
    or a tag of the translation is not balanced.
    """

    def count(c: str, pattern: str) -> Column:
        return F.regexp_count(c, F.lit(pattern))

    opens = F.array(*(count("translated", rf"(?i)<{t}\b[^>]*>") for t in INLINE_TAGS))
    closes = F.array(*(count("translated", rf"(?i)</{t}>") for t in INLINE_TAGS))
    paired = F.transform(F.regexp_extract_all("original", F.lit(rf"(?is)<({'|'.join(INLINE_TAGS)})\b([^>]*?)>(.*?)</\1>"), F.lit(1)), F.lower)
    source = F.array(*(_count_of(paired, t) for t in INLINE_TAGS))
    out = bitext.withColumns({"opens": opens, "closes": closes, "source_tags": source})
    rows = F.arrays_zip("opens", "closes", "source_tags")
    bad = F.exists(rows, lambda x: (x["opens"] != x["closes"]) | ((x["source_tags"] > 0) & (x["opens"] != x["source_tags"])))
    return out.withColumn("broken", F.exists("source_tags", lambda n: n > 0) & bad)


def _count_of(values: Column, value: str) -> Column:
    return F.size(F.filter(values, lambda x: x == value))


def layout_check(bitext: DataFrame) -> DataFrame:
    """PreserveLayout blocks and whether their lines match."""
    own = bitext.where(F.col("constraint") == "PreserveLayout")
    return own.withColumn("lines_match", layout_lines_match(F.col("original"), F.col("translated")))
