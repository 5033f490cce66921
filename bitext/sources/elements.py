"""Block elements of HTML in one pass: Python helpers, free of Spark.

An element goes from the leftmost opening tag that is closed at all to the next closing tag of
the same name; elements neither nest nor overlap. All closing tags and all ends of tags are found
once, and the next one after a place by bisection, so unclosed tags cost no second look.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

# The elements that hold text blocks.
BLOCK_TAGS = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "title", "td", "blockquote")
#: Letters of both cases spelt out: other characters fold to ASCII letters too.
_NAMES = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in t) for t in BLOCK_TAGS)
_TAG = re.compile(rf"<(/?)({_NAMES})(?!\w)")
_MARKUP = re.compile(r"<[^>]*>")
#: White space as ``functions.compat.BLANK`` has it.
BLANKS = "".join(map(chr, [*range(9, 14), 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))


def elements(html: str) -> Iterator[tuple[str, int, int, int, int]]:
    """(tag, start, start of the inner markup, its end, end) of the block elements, in order."""
    opened: list[tuple[int, int, str]] = []
    closed: defaultdict[str, list[int]] = defaultdict(list)
    for m in _TAG.finditer(html):
        tag = m[2].lower()
        if not m[1]:
            opened.append((m.start(), m.end(), tag))
        elif html.startswith(">", m.end()):
            closed[tag].append(m.start())
    ends = [m.start() for m in re.finditer(">", html)]
    at = 0
    for start, name_end, tag in opened:
        if start < at:
            continue
        k = bisect_left(ends, name_end)
        if k == len(ends):
            return
        inner = ends[k] + 1
        close = closed[tag]
        c = bisect_left(close, inner)
        if c < len(close):
            at = close[c] + len(tag) + 3
            yield tag, start, inner, close[c], at


def has_text(markup: str) -> bool:
    """Whether anything but tags and white space is in it."""
    at = 0
    while at < len(markup):
        if markup[at] == "<":
            end = markup.find(">", at)
            if end < 0:
                return True
            at = end + 1
        elif markup[at] in BLANKS:
            at += 1
        else:
            return True
    return False


def blocks(html: str) -> list[tuple[str, str]]:
    """(tag, inner markup) of the elements that have text."""
    return [(tag, html[a:b]) for tag, _, a, b, _ in elements(html) if has_text(html[a:b])]


def rewritten(html: str, texts: dict[int, str], all_elements: bool = False) -> str:
    """``html`` with the inner markup of the n-th element that has text, or of the n-th of all, replaced."""
    out, at, n = [], 0, 0
    for _, _, a, b, _ in elements(html):
        if all_elements or has_text(html[a:b]):
            if n in texts:
                out += [html[at:a], texts[n]]
                at = b
            n += 1
    return "".join([*out, html[at:]])
