"""Scalar functions over text columns; built-in expressions that stay in generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import compat
from .compat import WS, let, not_empty, strip, text_or_empty

Terms = Sequence[tuple[str, str]]

# Abbreviations that glossary passes leave alone.
ABBREVIATIONS = frozenset(
    "RAG MCP A2A AI LLM API SOP SLA SOC SIEM SASE UAT SOTA RBAC EDR XDR ADC AADL LLMOps FinOps STM LTM HITL HOTL HOOTL XPIA PII PoC".split()
)
# Style guides by domain.
STYLE_GUIDES = {
    "academic": "Use formal, objective academic tone. Prefer passive voice for methodology descriptions. Preserve all technical terminology exactly. Use SI units. Maintain precise, unambiguous language throughout.",
    "business": "Use professional business tone. Be direct and action-oriented. Use standard business terminology. Maintain a formal but accessible register. Preserve brand names and product terms in original form.",
    "general": "Use natural, clear translation tone. Prioritize readability and accuracy. Preserve the original register and style. Adapt idioms to target language equivalents where appropriate.",
}
CONSTRAINTS = ("Concise", "PreserveLayout", "ExpandAllowed")
# What leaked review notes look like.
META = r"[\(（]\s*此段落已(?:准确)?翻译[^\)）]*[\)）]|无需修改|已准确翻译"
LEAKED = rf"(?is)^\[[0-9]+\]{WS}*Source:{WS}*.*?\n{WS}*Translation:{WS}*(.*)$"
# What refusing replies say.
REFUSALS = ("Here are a few options", "Please provide")

#: Terms up to which a literal glossary becomes nested expressions.
NESTED_TERMS = 150


def normalize_term(c: Column) -> Column:
    """White space runs as one space, none at the ends; null is empty."""
    return F.trim(F.regexp_replace(text_or_empty(c), f"{WS}+", " "))


def detect_term_lang(c: Column, fallback: Column | str = "Auto") -> Column:
    """Language of the first script found, most specific first."""
    t = normalize_term(c)
    out = F.when(t.rlike(compat.HAN), "zh-CN").when(t.rlike(compat.KANA), "ja").when(t.rlike(compat.HANGUL), "ko")
    out = out.when(t.rlike(compat.ARABIC), "ar").when(t.rlike(compat.CYRILLIC), "ru").when(t.rlike("[A-Za-z]"), "en")
    return out.otherwise(fallback if isinstance(fallback, Column) else F.lit(fallback))


def detect_text_lang(c: Column) -> Column:
    """Language by script, else by the letters of the whole text.

    French comes first and its letters include those of the other Latin languages, so a text
    of ASCII letters alone is ``fr``, and any punctuation gives ``Auto``.
    """
    t = text_or_empty(c)
    out = F.when(~t.rlike(f"[^{compat.BLANK}]"), "Auto")
    for code, script in (("zh-CN", compat.HAN), ("ja", compat.KANA), ("ko", compat.HANGUL), ("ar", compat.ARABIC), ("ru", compat.CYRILLIC)):
        out = out.when(t.rlike(script), code)
    letters = (("fr", r"\u00c0-\u017f"), ("de", "ÄäÖöÜüß"), ("es", "áéíñóúü"), ("en", ""))
    for code, more in letters:
        out = out.when(t.rlike(rf"^[a-zA-Z{more}{compat.BLANK}\-]+\z"), code)
    return out.otherwise("Auto")


def normalize_lang(c: Column, lower_unknown: bool = True) -> Column:
    """Language name to code; ``auto`` is ``en``. Unknown names: lower-cased and ``en`` for none, or left as they are."""
    t = F.lower(strip(text_or_empty(c)))
    out = F.when(t.isin("english", "en"), "en").when(t.isin("chinese", "chinese (simplified)", "chinese (traditional)", "zh"), "zh")
    out = out.when(t.isin("japanese", "ja"), "ja").when(t.isin("korean", "ko"), "ko").when(t == "auto", "en")
    out = out.when(t == "", "en") if lower_unknown else out
    return out.otherwise(t if lower_unknown else c)


def longest_first(terms: Terms) -> list[tuple[str, str]]:
    """Usable terms by falling source length; equal lengths keep their order."""
    return sorted(((s, t) for s, t in terms if s and t), key=lambda x: -len(x[0]))


def apply_terms(c: Column, terms: Terms | Column) -> Column:
    """Replace each term in turn, longest source first, in any case, by its literal target.

    Later terms also meet what earlier ones wrote. ``terms``: a literal list, or an array of
    (source, target), already longest first, such as a glossary collected into one row.
    """
    out = text_or_empty(c)
    if not isinstance(terms, Column):
        ordered = longest_first(terms)
        if len(ordered) <= NESTED_TERMS:
            for source, target in ordered:
                out = F.regexp_replace(out, "(?iu)" + compat.quote_pattern(source), compat.quote_replacement(target))
            return out
        terms = F.array(*(F.struct(F.lit(s).alias("source"), F.lit(t).alias("target")) for s, t in ordered))
    return F.aggregate(terms, out, _replace_one)


def _replace_one(text: Column, term: Column) -> Column:
    pattern = F.concat(F.lit("(?iu)"), F.regexp_replace(term["source"], r"([\\^$.|?*+()\[\]{}])", r"\\$1"))
    target = F.replace(F.replace(term["target"], F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    return F.regexp_replace(text, pattern, target)


def _fix_agents(c: Column) -> Column:
    for bad in ("代理", "特工"):
        c = F.replace(c, F.lit(bad), F.lit("智能体"))
    return F.replace(c, F.lit("智能体智能体"), F.lit("智能体"))


def fix_han_terms(c: Column, terms: Terms, skip: frozenset[str] = ABBREVIATIONS) -> Column:
    """In texts with Han: case-sensitive terms, longest first, without abbreviations; then clean-up."""
    out = c
    for source, target in longest_first(terms):
        if source not in skip:
            out = F.replace(out, F.lit(source), F.lit(target))
    return F.when(c.rlike(compat.HAN), _fix_agents(out)).otherwise(c)


def fix_full_terms(c: Column, terms: Terms) -> Column:
    """In every text: terms of more than 3 characters in their given order; then clean-up."""
    out = c
    for source, target in terms:
        if len(source) > 3:
            out = F.replace(out, F.lit(source), F.lit(target))
    return strip(_fix_agents(out))


def strip_meta(c: Column) -> Column:
    """Without review notes and leaked review format; the input where nothing would be left."""
    cleaned = strip(F.regexp_replace(c, META, ""))
    inner = strip(F.regexp_extract(cleaned, LEAKED, 1))
    return F.coalesce(not_empty(inner), not_empty(cleaned), c)


def strip_fences(c: Column, quotes: bool = False) -> Column:
    """Without a code fence around the text, and without quotes around that."""
    out = strip(F.regexp_replace(F.regexp_replace(c, r"^```[a-zA-Z]*\n?", ""), r"\n?```\z", ""))
    return F.regexp_replace(out, r"""^["']|["']\z""", "") if quotes else out


def refusal_fallback(reply: Column, source: Column) -> Column:
    """The reply, or the source where the reply is empty or refuses."""
    r = strip(text_or_empty(reply))
    bad = r == ""
    for phrase in REFUSALS:
        bad = bad | r.contains(phrase)
    return F.when(bad, source).otherwise(r)


# What counts as a tag to preserve.
TAG_PATTERNS = (
    r"</?[a-zA-Z][a-zA-Z0-9]*(?:\s+[^>]*)?/?>",
    r'<span\s+data-jo-id="[^"]*"[^>]*>.*?</span>',
    r"\*\*[^*]+\*\*|\*[^*]+\*|`[^`]+`|\[[^\]]+\]\([^)]+\)",
    r"\{\$[^$]+\$?\}|\{\{[^}]+\}\}",
)


def preserved_tags(c: Column) -> Column:
    """Distinct structural elements, in the order of the kinds and then of their places."""
    found = (F.regexp_extract_all(text_or_empty(c), F.lit(p), F.lit(0)) for p in TAG_PATTERNS)
    return F.array_distinct(F.concat(*found))


def strip_html(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"<[^>]*>", ""))


def escape_xml(c: Column) -> Column:
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&apos;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(escaped))
    return c


def unescape_xml(c: Column) -> Column:
    for raw, escaped in (("<", "&lt;"), (">", "&gt;"), ("'", "&apos;"), ('"', "&quot;"), ("&", "&amp;")):
        c = F.replace(c, F.lit(escaped), F.lit(raw))
    return c


FULL_WIDTH = r"[一-鿿\u3000-\u303f\uff00-\uffef]"
NARROW, WIDE = r"[ilI.,;:|!]", "[mwMW@]"


def text_width(c: Column, size: Column) -> Column:
    """Estimated width: characters of four width classes, times the font size."""
    full, narrow, wide = (F.regexp_count(c, F.lit(p)) for p in (FULL_WIDTH, NARROW, WIDE))
    rest = F.length(c) - full - narrow - wide
    return (full * 1.0 + narrow * 0.3 + wide * 0.7 + rest * 0.52) * size


def fit_font(c: Column, size: Column, width: Column, clamp: bool = True) -> Column:
    """Font size that makes the text fit, 60 % of the size at least."""
    size = F.greatest(size, F.lit(6.0)) if clamp else size
    needed = text_width(c, size)
    return F.when((needed > width) & (width > 0), size * F.greatest(F.lit(0.6), width / needed)).otherwise(size)


def estimate_confidence(original: Column, translated: Column, constraint: Column) -> Column:
    o, t = text_or_empty(original), text_or_empty(translated)
    ratio = F.length(t) / F.nullif(F.length(o), F.lit(0))
    concise = F.when(ratio <= 1.2, 0.85).otherwise(F.greatest(F.lit(0.3), 0.85 - (ratio - 1.2) * 0.5))
    layout = F.when(layout_lines_match(o, t), 0.85).otherwise(0.5)
    free = F.when((ratio >= 0.2) & (ratio <= 2), 0.8).otherwise(0.4)
    return (
        F.when(o == "", 0.5).when(o == t, 0.6).when(constraint == "Concise", concise).when(constraint == "PreserveLayout", layout).otherwise(free)
    )


def layout_lines_match(original: Column, translated: Column) -> Column:
    return F.size(F.split(original, "\n")) == F.size(F.split(translated, "\n"))


def classify_constraint(node_type: Column, box_width: Column, hint: Column) -> Column:
    """Constraint of a block: by its kind, by a narrow box, by a valid hint, or none."""
    out = F.when(node_type.isin("code", "table", "list"), "PreserveLayout")
    out = out.when(node_type.isin("label", "button", "caption", "textbox") | (box_width < 200), "Concise")
    return out.when(hint.isin(*CONSTRAINTS), hint).otherwise("ExpandAllowed")


def style_guide(domain: Column) -> Column:
    out = F.when(domain == "academic", STYLE_GUIDES["academic"]).when(domain == "business", STYLE_GUIDES["business"])
    return out.otherwise(STYLE_GUIDES["general"])


def find_replace(c: Column, query: str, replacement: str) -> tuple[Column, Column]:
    """Text with every occurrence replaced, in this case, and whether there was any."""
    if not query:
        return c, F.lit(False)
    return F.replace(c, F.lit(query), F.lit(replacement)), F.coalesce(c.contains(query), F.lit(False))


def join_context(context: Column) -> Column:
    """The non-blank context texts in one."""
    return F.array_join(F.filter(context, lambda x: strip(x) != ""), " ")


def merge_short(c: Column, context: Column) -> Column:
    """A text of under 10 characters becomes the joined non-blank context texts, if those are longer."""
    return merge_joined(c, join_context(context), F.size(context))


def merge_joined(c: Column, joined: Column, size: Column) -> Column:
    """``merge_short`` with a context of ``size`` texts that is joined already, once for all of its texts."""

    def choose(own: Column) -> Column:
        longer = let(joined, lambda j: F.when(F.length(j) > F.length(own), j).otherwise(own))
        return F.when((F.length(own) < 10) & (size > 1), longer).otherwise(own)

    return let(strip(text_or_empty(c)), choose)


def trim_tail(c: Column) -> Column:
    """Up to the first sentence mark, without a closing remark on importance."""
    t = strip(c)
    cut = F.regexp_replace(F.regexp_replace(t, r"[。.!！?？；;，,、].*$", ""), r"(?iu)(很重要|重要|is important|important)\z", "")
    return F.coalesce(not_empty(strip(cut)), t)


def truncate(c: Column, n: int) -> Column:
    return F.left(c, F.lit(n))
