"""Term candidates from the difference of two translations."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAIL = re.compile(r"[。.!！?？；;，,、].*$")
REMARK = re.compile(r"(很重要|重要|is important|important)$", re.I)
WHOLE_SOURCE_WORDS, WINDOW_WORDS = 5, 6


def _squeeze(text: str) -> str:
    return " ".join(text.split())


def _short(text: str) -> str:
    text = text.strip()
    return REMARK.sub("", TAIL.sub("", text, count=1)).strip() or text


def source_fragment(source: str, old: str, new: str) -> str:
    """The part of the source that a changed piece stands for, or nothing.

    The old piece itself if it was left untranslated; a short source as a whole; else the
    shortest, leftmost window that shares most words with the new piece.
    """
    if old in source:
        return old
    words = re.split(r"\s+", source)
    if len(words) <= WHOLE_SOURCE_WORDS:
        return source
    wanted = set(re.split(r"\s+", new.lower()))
    low = [w.lower() for w in words]
    windows = ((len(wanted & set(low[i : i + n])), -n, -i) for n in range(1, min(WINDOW_WORDS, len(words)) + 1) for i in range(len(words) - n + 1))
    overlap, n, i = max(windows, default=(0, 0, 0))
    return " ".join(words[-i : -i - n]) if overlap else ""


def candidates(source: str, old: str, new: str) -> list[tuple[str, str, str, float]]:
    """(source, target, old target, confidence) of an edit, best guess only."""
    if old == new:
        return []
    a, b = re.split(r"(\s+)", old), re.split(r"(\s+)", new)
    size = max(len(a), len(b))
    a, b = a + [None] * (size - len(a)), b + [None] * (size - len(b))
    changed = [i for i in range(size) if a[i] != b[i]]
    guess = None
    if changed:
        span = slice(changed[0], changed[-1] + 1)
        before, after = ("".join(x for x in side[span] if x is not None).strip() for side in (a, b))
        if before and after and before != after:
            part = source_fragment(source, before, after)
            if changed[0] == changed[-1]:
                guess = (part, after, before, 0.85 if part else 0.5)
            else:
                guess = (part or source[:50], after, before, 0.6 if part else 0.3)
    if guess is None and old.strip() != new.strip():
        longest = max(len(old), len(new))
        if abs(len(old) - len(new)) / longest < 0.5:
            guess = (source[:80], new, old, 0.2)
    if guess is None:
        return []
    s, t, o = _squeeze(guess[0]), _short(_squeeze(guess[1])), _short(_squeeze(guess[2]))
    return [(s, t, o, guess[3])] if s and t and o != t else []


def term_candidates(edits: DataFrame) -> DataFrame:
    """doc_id, block_id, pos, source, target, old_target, confidence of edits (source_text, before_text, after_text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                (row, pos, *c)
                for row, (s, old, new) in enumerate(zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True))
                for pos, c in enumerate(candidates(s or "", old or "", new or ""))
            ]
            row, *columns = zip(*found, strict=True) if found else [()] * 6
            ids = [batch.column(k).take(pa.array(row, pa.int64())) for k in (0, 1)]
            kinds = (pa.int32(), pa.string(), pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([*ids, *map(pa.array, columns, kinds)], names=["doc_id", "block_id", "pos", "source", "target", "old_target", "confidence"])

    # Unchanged texts never reach Python.
    changed = edits.where(~F.col("before_text").eqNullSafe(F.col("after_text"))).select("doc_id", "block_id", "source_text", "before_text", "after_text")
    kind = changed.schema["doc_id"].dataType.simpleString()
    return changed.mapInArrow(run, f"doc_id {kind}, block_id string, pos int, source string, target string, old_target string, confidence double")
