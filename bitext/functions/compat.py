"""Text rules that every function shares, and their engine-neutral spelling.

Lengths are in code points. Blank means any Unicode white space; patterns spell it out, so
that they do not depend on an engine's ``\\s``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space for Java patterns, without brackets.
BLANK = r"\s\x0B\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
WS = f"[{BLANK}]"
#: The same characters one by one, for trimming.
BLANKS = " \t\n\x0b\x0c\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
#: End and start of an ASCII word.
WORD_END = r"(?![A-Za-z0-9_])"
HAN = r"[一-鿿]"
KANA = r"[぀-ゟ゠-ヿ]"
HANGUL = r"[가-힯]"
ARABIC = r"[؀-ۿ]"
CYRILLIC = r"[Ѐ-ӿ]"
INLINE_TAGS = ("b", "i", "em", "strong", "a", "span")


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    """Without white space at either end; only the ends are looked at."""
    return F.btrim(c, F.lit(BLANKS))


def not_empty(c: Column) -> Column:
    return F.when(c != "", c)


def quote_pattern(text: str) -> str:
    """``text`` as a literal Java pattern."""
    return "".join("\\" + c if c in r"\^$.|?*+()[]{}" else c for c in text)


def quote_replacement(text: str) -> str:
    """``text`` as a literal replacement: group references have no meaning."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def let(c: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``c``, with ``c`` computed once for all its uses."""
    return F.element_at(F.transform(F.array(c), body), 1)
