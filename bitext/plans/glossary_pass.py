"""Large glossaries applied to texts: each term in turn, but only those that occur.

Terms are applied longest first, and a later term also meets what earlier ones wrote. A text is
cut at characters that no source has. A piece is scanned for all terms at once; those that occur
are applied in turn, and the places where one was put in are scanned for those after it. So the
work grows with the terms that occur, not with the glossary.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heappop, heappush

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitext.functions.text import longest_first
from bitext.operators.match import AUTOMATON_BYTES

#: Characters of pieces whose results are kept, and how many of them.
SHORT, HELD = 64, 300_000


class _Fold(dict):
    """Per character what patterns without regard to case compare: its capital's small letter."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        up = c.upper()
        self[code] = out = (up if len(up) == 1 else c).lower()[0]  # of U+0130 the letter without its dot
        return out


_FOLD = _Fold()


def fold(text: str) -> str:
    """The same number of characters, equal where two differ in case alone (U+1E9E is the capital of U+00DF)."""
    return text.lower() if text.isascii() else text.translate(_FOLD)


class Glossary:
    """Terms in the order of their application, and one automaton over their sources."""

    def __init__(self, terms: list[tuple[str, str]]):
        self.terms = [(fold(s), t) for s, t in longest_first(terms)]
        self.machine = ahocorasick.Automaton()
        for n, (s, _) in reversed(list(enumerate(self.terms))):  # of equal sources the first is applied
            self.machine.add_word(s, n)
        if self.terms:
            self.machine.make_automaton()
            self.pieces = re.compile("[" + "".join(map(re.escape, sorted(set("".join(s for s, _ in self.terms))))) + "]+")
        self.known: dict[str, str] = {}  # short pieces come again
        self.longest = max((len(s) for s, _ in self.terms), default=0)
        # A later term of the same source can only meet what the first one wrote.
        self.same: dict[str, list[int]] = {}
        for n, (s, _) in enumerate(self.terms):
            self.same.setdefault(s, []).append(n)

    def _found(self, folded: str, start: int, end: int, after: int) -> set[int]:
        """Terms behind ``after`` that occur in a part of the text."""
        return {n for _, first in self.machine.iter(folded, start, end) for n in self.same[self.terms[first][0]] if n > after}

    def apply(self, text: str) -> str:
        """Piece by piece: no term goes over a character that no source has, and none takes it away."""
        if not self.terms:
            return text
        out, at = [], 0
        for m in self.pieces.finditer(fold(text)):
            start, end = m.span()
            piece = text[start:end]
            done = self.known.get(piece)
            if done is None:
                done = self._apply(piece)
                if end - start <= SHORT:
                    if len(self.known) >= HELD:
                        self.known.clear()
                    self.known[piece] = done
            out += [text[at:start], done]
            at = end
        return "".join([*out, text[at:]])

    def _apply(self, text: str) -> str:
        folded = fold(text)
        known = self._found(folded, 0, len(folded), -1)
        waiting = sorted(known)
        while waiting:
            done = heappop(waiting)
            source, target = self.terms[done]
            parts = folded.split(source)
            if len(parts) == 1:  # an earlier term took all of it
                continue
            given, put, start = fold(target), [], 0
            for part in parts:
                put.append(text[start : start + len(part)])
                start += len(part) + len(source)
            text, folded = target.join(put), given.join(parts)
            # What is new meets a target: only there later terms are looked for.
            place, seen, around = 0, 0, self.longest - 1
            for part in parts[:-1]:
                place += len(part)
                start, place = max(place - around, seen, 0), place + len(given)
                seen = max(start, place)
                for n in self._found(folded, start, min(place + around, len(folded)), done) - known:
                    known.add(n)
                    heappush(waiting, n)
        return text


def apply_glossary(df: DataFrame, glossary: DataFrame, text: str = "text", out: str = "translated") -> DataFrame:
    """``df`` plus ``out``: ``text`` with all terms (ord, source, target) applied; null is empty.

    The glossary goes to every worker; one of more than ``AUTOMATON_BYTES`` is an error. Of equal
    sources the first by ``ord`` is applied first.
    """
    usable = glossary.where("source <> '' AND target <> ''").select("ord", "source", "target")
    size = usable.agg(F.coalesce(F.sum(F.octet_length("source") + F.octet_length("target")), F.lit(0))).first()[0]
    if size > AUTOMATON_BYTES:
        raise ValueError(f"the glossary has {size} bytes, more than {AUTOMATON_BYTES}: split it, or apply only the terms of each text (relevant_glossary)")
    terms = [(r.source, r.target) for r in usable.orderBy("ord").collect()]

    @F.arrow_udf("string")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Glossary(terms)
        for some in texts:
            yield pa.array([known.apply(t or "") for t in some.to_pylist()], pa.string())

    return df.withColumn(out, run(F.col(text)))
