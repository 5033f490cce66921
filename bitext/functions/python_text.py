"""The text functions that no built-in expresses: Arrow-batched, used as table jobs."""

from __future__ import annotations

import math
import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .compat import INLINE_TAGS

# How extracted text is cleaned.
_HAN_LINE = re.compile(r"[一-鿿]")
_SPLIT_WORDS = re.compile(r"(?<=[A-Za-z0-9])\n(?=[A-Za-z0-9])")
_BLANK_LINES = re.compile(r"\n{3,}")
_GLOSS = re.compile(r"\s*\([^)]*[a-zA-Z].*\)$")

_INLINE = re.compile(rf"<(/?)({'|'.join(INLINE_TAGS)})\b([^>]*)>", re.I)


def clean_text(text: str | None) -> str:
    """NFKC, unified line ends, split Han and Latin lines joined, no trailing Latin gloss."""
    lines = re.sub(r"\r\n?", "\n", unicodedata.normalize("NFKC", text or "")).split("\n")
    out: list[str] = []
    alone = False  # the last line is a single Han character that may take the next line
    for line in lines:
        if alone and line and _HAN_LINE.match(line.strip()):
            out[-1] = out[-1].strip() + line.lstrip()
            alone = False
            continue
        out.append(line)
        alone = len(line.strip()) == 1 and bool(_HAN_LINE.match(line.strip()))
    joined = _BLANK_LINES.sub("\n\n", _SPLIT_WORDS.sub(" ", "\n".join(out)))
    return _GLOSS.sub("", joined).strip()


def clean_extracted(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with its extracted text cleaned."""

    @F.pandas_udf("string")
    def clean(s: pd.Series) -> pd.Series:
        return s.map(clean_text)

    return df.withColumn(text, clean(F.col(text)))


def tag_skeleton(html: str) -> tuple[str, list[tuple[int, str]]]:
    """Text without inline tags, and its opening and closing tags with their places in it.

    Tags come in the order of their opening, each with its close after it; a tag that nothing
    closes is closed at the end.
    """
    plain, places, open_at, at = [], [], {}, 0
    length = 0
    for m in _INLINE.finditer(html):
        plain.append(html[at : m.start()])
        length += m.start() - at
        at = m.end()
        tag = m[2].lower()
        if not m[1]:
            open_at.setdefault(tag, []).append(len(places))
            places.append([length, m[0], None, f"</{tag}>"])
        elif not m[3].strip() and open_at.get(tag):
            places[open_at[tag].pop()][2] = length
    plain.append(html[at:])
    text = "".join(plain)
    return text, [x for a, start, b, end in places for x in ((len(text) if b is None else b, end), (a, start))]


def reapply_tags(source: str, translated: str) -> str:
    """The translation's text with the source's inline tags at proportional places."""
    text, tags = tag_skeleton(source)
    clean = _INLINE.sub("", translated)
    at: dict[int, list[str]] = {}
    for place, tag in tags:
        ratio = place / len(text) if text else (1.0 if tag[1] == "/" and place else 0.0)
        at.setdefault(math.floor(ratio * len(clean) + 0.5), []).append(tag)
    # What was recorded last stands first: a pair that opens and closes in one place stays a pair.
    parts, last = [], 0
    for place in sorted(at):
        parts += [clean[last:place], *reversed(at[place])]
        last = place
    return "".join([*parts, clean[last:]])


def repair_tags(bitext: DataFrame, broken: str = "broken") -> DataFrame:
    """``translated`` repaired where the boolean column ``broken`` says so (see tag_balance)."""

    @F.pandas_udf("string")
    def repair(source: pd.Series, translated: pd.Series) -> pd.Series:
        return pd.Series([reapply_tags(s, t) for s, t in zip(source, translated, strict=True)])

    return bitext.withColumn("translated", F.when(F.col(broken), repair("original", "translated")).otherwise(F.col("translated")))
