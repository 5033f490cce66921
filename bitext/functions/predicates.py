"""Tests on texts that need no translation, or that hold a script."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import compat
from .compat import strip, text_or_empty

SYMBOLS = r"[\-0-9\s.,%$€£¥₩₽₹₱₿+/\\*#@()\[\]{}]+"

PLAIN_SYMBOLS = r"[\-0-9\s.,%$€£¥₩₽₹₱₿]+"


def skip_text(c: Column) -> Column:
    """Under two characters, or numbers and symbols alone."""
    t = strip(text_or_empty(c))
    return (F.length(t) < 2) | t.rlike(rf"^{SYMBOLS}\z")


def skip_numeric_short(c: Column) -> Column:
    """Up to six digits, whatever ``- . ~`` and spaces stand between them."""
    return F.regexp_replace(text_or_empty(c), r"[-. ~]", "").rlike(r"^[0-9]{1,6}\z")


def skip_short_number(c: Column) -> Column:
    """Under three characters, or under ten of numbers and symbols alone."""
    t = strip(text_or_empty(c))
    return (F.length(t) < 3) | ((F.length(t) < 10) & t.rlike(rf"^{PLAIN_SYMBOLS}\z"))


def has_han(c: Column) -> Column:
    return text_or_empty(c).rlike(compat.HAN)


def contains_cjk(c: Column) -> Column:
    return text_or_empty(c).rlike(r"[㐀-鿿぀-ヿ가-힯]")


def non_blank(c: Column) -> Column:
    return strip(text_or_empty(c)) != ""
