"""SQL names for the scalar functions, the Arrow functions and the table function of term candidates.

Each body is what the Column function of the same operator says; a query compares all of them
row by row. ``column`` gives a registered function back as a Column.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from bitext.plans.edits import candidates

from . import python_text
from .compat import ARABIC, BLANK, BLANKS, CYRILLIC, HAN, HANGUL, KANA, WS
from .predicates import PLAIN_SYMBOLS
from .text import ABBREVIATIONS, FULL_WIDTH, LEAKED, META, NARROW, REFUSALS, STYLE_GUIDES, TAG_PATTERNS, WIDE

_STRIP = "btrim({x}, '" + BLANKS + "')"
_SYMBOLS = r"[\-0-9\s.,%$€£¥₩₽₹₱₿+/\\*#@()\[\]{}]+"

TERMS = "ARRAY<STRUCT<source: STRING, target: STRING>>"
#: Usable terms, longest source first; equal lengths keep their order.
_LONGEST = "array_sort(filter(terms, x -> x.source <> '' AND x.target <> ''), (x, y) -> length(y.source) - length(x.source))"
_AGENTS = "replace(replace(replace({x}, '代理', '智能体'), '特工', '智能体'), '智能体智能体', '智能体')"


def _in_turn(terms: str, text: str, replaced: str) -> str:
    return f"aggregate({terms}, {text}, (acc, x) -> {replaced})"


_QUOTED = r"concat('(?iu)', regexp_replace(x.source, r'([\\^$.|?*+()\[\]{}])', r'\\$1')), replace(replace(x.target, r'\', r'\\'), '$', r'\$')"
_LETTERS = "".join(f" WHEN t RLIKE r'^[a-zA-Z{more}{BLANK}\\-]+\\z' THEN '{code}'" for code, more in (("fr", r"\u00c0-\u017f"), ("de", "ÄäÖöÜüß"), ("es", "áéíñóúü"), ("en", "")))
_SCRIPTS = "".join(f" WHEN t RLIKE '{script}' THEN '{code}'" for code, script in (("zh-CN", HAN), ("ja", KANA), ("ko", HANGUL), ("ar", ARABIC), ("ru", CYRILLIC)))
_LESS_META = _STRIP.format(x=f"regexp_replace(t, r'{META}', '')")
_TAIL = "regexp_replace(regexp_replace({x}, '[。.!！?？；;，,、].*$', ''), r'(?iu)(很重要|重要|is important|important)\\z', '')"

_STRIPPED = _STRIP.format(x="coalesce(t, '')")
_RATIO = "(length(translated) / nullif(length(original), 0))"

_FULL_RATIO = "(length(coalesce(translated, '')) / nullif(length(original), 0))"

#: name, parameters, result type, body; the optimizer inlines them.
FUNCTIONS = (
    ("normalize_term", "t STRING", "STRING", f"trim(regexp_replace(coalesce(t, ''), r'{WS}+', ' '))"),
    ("strip_html", "t STRING", "STRING", _STRIP.format(x="regexp_replace(t, '<[^>]*>', '')")),
    ("escape_xml", "t STRING", "STRING", """replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), "'", '&apos;'), '"', '&quot;')"""),
    ("skip_text", "t STRING", "BOOLEAN", f"length({_STRIP.format(x='coalesce(t, \'\')')}) < 2 OR {_STRIP.format(x='coalesce(t, \'\')')} RLIKE r'^{_SYMBOLS}\\z'"),
    ("has_han", "t STRING", "BOOLEAN", "coalesce(t, '') RLIKE '[一-鿿]'"),
    ("strip_meta_notes", "t STRING", "STRING", _STRIP.format(x=f"regexp_replace(t, r'{META}', '')")),
    (
        "text_width", "t STRING, size DOUBLE", "DOUBLE",
        f"(regexp_count(t, r'{FULL_WIDTH}') + 0.3D * regexp_count(t, r'{NARROW}') + 0.7D * regexp_count(t, r'{WIDE}')"
        f" + 0.52D * (length(t) - regexp_count(t, r'{FULL_WIDTH}') - regexp_count(t, r'{NARROW}') - regexp_count(t, r'{WIDE}'))) * size",
    ),
    ("detect_term_lang", "t STRING", "STRING", f"CASE WHEN t RLIKE '{HAN}' THEN 'zh-CN' WHEN t RLIKE '{KANA}' THEN 'ja' WHEN t RLIKE '{HANGUL}' THEN 'ko' WHEN t RLIKE '{ARABIC}' THEN 'ar' WHEN t RLIKE '{CYRILLIC}' THEN 'ru' WHEN t RLIKE '[A-Za-z]' THEN 'en' ELSE 'Auto' END"),
    (
        "normalize_lang", "t STRING", "STRING",
        f"CASE WHEN lower({_STRIPPED}) IN ('', 'auto', 'english', 'en') THEN 'en' WHEN lower({_STRIPPED}) IN ('chinese', 'chinese (simplified)', 'chinese (traditional)', 'zh') THEN 'zh'"
        f" WHEN lower({_STRIPPED}) IN ('japanese', 'ja') THEN 'ja' WHEN lower({_STRIPPED}) IN ('korean', 'ko') THEN 'ko' ELSE lower({_STRIPPED}) END",
    ),
    ("skip_numeric_short", "t STRING", "BOOLEAN", "regexp_replace(coalesce(t, ''), '[-. ~]', '') RLIKE r'^[0-9]{1,6}\\z'"),
    ("contains_cjk", "t STRING", "BOOLEAN", "coalesce(t, '') RLIKE '[㐀-鿿぀-ヿ가-힯]'"),
    ("strip_fences", "t STRING", "STRING", _STRIP.format(x=r"regexp_replace(regexp_replace(t, r'^```[a-zA-Z]*\n?', ''), r'\n?```\z', '')")),
    (
        "classify_constraint", "node_type STRING, box_width DOUBLE, hint STRING", "STRING",
        "CASE WHEN node_type IN ('code', 'table', 'list') THEN 'PreserveLayout' WHEN node_type IN ('label', 'button', 'caption', 'textbox') OR box_width < 200 THEN 'Concise'"
        " WHEN hint IN ('Concise', 'PreserveLayout', 'ExpandAllowed') THEN hint ELSE 'ExpandAllowed' END",
    ),
    (
        "drift_severity", "original STRING, translated STRING", "STRING",
        f"CASE WHEN {_RATIO} < 0.2 THEN 'high' WHEN {_RATIO} > 2.5 THEN 'medium' WHEN {_RATIO} < 0.3 OR {_RATIO} > 1.8 THEN 'low' END",
    ),
    ("overflow_severity", "original STRING, translated STRING", "STRING", f"CASE WHEN {_RATIO} > 1.5 THEN 'high' WHEN {_RATIO} > 1.2 THEN 'medium' END"),
    (
        "estimate_confidence", "original STRING, translated STRING, block_constraint STRING", "DOUBLE",
        f"CASE WHEN coalesce(original, '') = '' THEN 0.5D WHEN original = coalesce(translated, '') THEN 0.6D WHEN block_constraint = 'Concise' THEN CASE WHEN {_FULL_RATIO} <= 1.2 THEN 0.85D ELSE greatest(0.3D, 0.85D - ({_FULL_RATIO} - 1.2D) * 0.5D) END"
        f" WHEN block_constraint = 'PreserveLayout' THEN CASE WHEN size(split(original, '\\n')) = size(split(coalesce(translated, ''), '\\n')) THEN 0.85D ELSE 0.5D END WHEN {_FULL_RATIO} BETWEEN 0.2 AND 2 THEN 0.8D ELSE 0.4D END",
    ),
    ("length_ratio", "original STRING, translated STRING", "DOUBLE", "length(translated) / nullif(length(original), 0)"),
    ("detect_text_lang", "t STRING", "STRING", f"CASE WHEN coalesce(t, '') NOT RLIKE r'[^{BLANK}]' THEN 'Auto'{_SCRIPTS}{_LETTERS} ELSE 'Auto' END"),
    ("apply_terms", f"t STRING, terms {TERMS}", "STRING", _in_turn(_LONGEST, "coalesce(t, '')", f"regexp_replace(acc, {_QUOTED})")),
    (
        "fix_han_terms", f"t STRING, terms {TERMS}", "STRING",
        f"CASE WHEN t RLIKE '{HAN}' THEN " + _AGENTS.format(x=_in_turn(f"filter({_LONGEST}, x -> x.source NOT IN ({', '.join(f"'{a}'" for a in sorted(ABBREVIATIONS))}))", "t", "replace(acc, x.source, x.target)")) + " ELSE t END",
    ),
    ("fix_full_terms", f"t STRING, terms {TERMS}", "STRING", _STRIP.format(x=_AGENTS.format(x=_in_turn("filter(terms, x -> length(x.source) > 3)", "t", "replace(acc, x.source, x.target)")))),
    ("strip_meta", "t STRING", "STRING", f"coalesce(nullif({_STRIP.format(x=f"regexp_extract({_LESS_META}, r'{LEAKED}', 1)")}, ''), nullif({_LESS_META}, ''), t)"),
    (
        "refusal_fallback", "reply STRING, source STRING", "STRING",
        f"CASE WHEN {_STRIP.format(x="coalesce(reply, '')")} = ''" + "".join(f" OR contains(reply, '{phrase}')" for phrase in REFUSALS) + f" THEN source ELSE {_STRIP.format(x="coalesce(reply, '')")} END",
    ),
    ("preserved_tags", "t STRING", "ARRAY<STRING>", "array_distinct(concat(" + ", ".join(f"regexp_extract_all(coalesce(t, ''), r'{p}', 0)" for p in TAG_PATTERNS) + "))"),
    (
        "fit_font", "t STRING, size DOUBLE, width DOUBLE", "DOUBLE",
        "CASE WHEN text_width(t, greatest(size, 6D)) > width AND width > 0 THEN greatest(size, 6D) * greatest(0.6D, width / text_width(t, greatest(size, 6D))) ELSE greatest(size, 6D) END",
    ),
    ("style_guide", "domain STRING", "STRING", f"CASE WHEN domain = 'academic' THEN '{STYLE_GUIDES['academic']}' WHEN domain = 'business' THEN '{STYLE_GUIDES['business']}' ELSE '{STYLE_GUIDES['general']}' END"),
    ("find_replace", "t STRING, query STRING, replacement STRING", "STRING", "CASE WHEN query = '' THEN t ELSE replace(t, query, replacement) END"),
    (
        "merge_short", "t STRING, context ARRAY<STRING>", "STRING",
        f"CASE WHEN length({_STRIPPED}) < 10 AND size(context) > 1 AND length(array_join(filter(context, x -> {_STRIP.format(x='x')} <> ''), ' ')) > length({_STRIPPED})"
        f" THEN array_join(filter(context, x -> {_STRIP.format(x='x')} <> ''), ' ') ELSE {_STRIPPED} END",
    ),
    ("trim_tail", "t STRING", "STRING", f"coalesce(nullif({_STRIP.format(x=_TAIL.format(x=_STRIP.format(x='t')))}, ''), {_STRIP.format(x='t')})"),
    ("truncate", "t STRING, n INT", "STRING", "left(t, n)"),
    ("skip_short_number", "t STRING", "BOOLEAN", f"length({_STRIPPED}) < 3 OR (length({_STRIPPED}) < 10 AND {_STRIPPED} RLIKE r'^{PLAIN_SYMBOLS}\\z')"),
)


def _clean_extracted(texts: pa.Array) -> pa.Array:
    return pa.array([python_text.clean_text(t) for t in texts.to_pylist()], pa.string())


def _repair_inline_tags(sources: pa.Array, translated: pa.Array) -> pa.Array:
    pairs = zip(sources.to_pylist(), translated.to_pylist(), strict=True)
    return pa.array([t if s is None or t is None else python_text.reapply_tags(s, t) for s, t in pairs], pa.string())


class TermCandidates:
    """Rows of ``term_candidates(source, old, new)``, for use with LATERAL."""

    def eval(self, source: str, old: str, new: str) -> Iterator[tuple]:
        for pos, c in enumerate(candidates(source or "", old or "", new or "")):
            yield pos, *c


def register_functions(spark: SparkSession) -> None:
    """Create all functions in the session: temporary SQL functions, two Arrow functions, one table function."""
    for name, parameters, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    spark.udf.register("clean_extracted", F.arrow_udf(_clean_extracted, "string"))
    spark.udf.register("repair_inline_tags", F.arrow_udf(_repair_inline_tags, "string"))
    spark.udtf.register("term_candidates", F.udtf(TermCandidates, returnType="pos int, source string, target string, old_target string, confidence double"))


def column(name: str, *arguments: Column) -> Column:
    """A registered function as a Column."""
    return F.call_function(name, *arguments)
