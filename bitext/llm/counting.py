"""Word counts of whole texts on bytes, in parts, summed inside a task before they travel."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

#: Bytes of a text that are cut into words at once.
PART = 1 << 20
#: Sums that a task holds before it hands them on.
HELD = 200_000


def byte_table(keep: bytes) -> bytes:
    """For ``bytes.translate``: bytes of ``keep`` stay, A to Z become a to z, all others a blank."""
    kept = set(keep)
    return bytes(b + 32 if 65 <= b <= 90 else b if b in kept else 32 for b in range(256))


def words_of(data: bytes, table: bytes, part: int = PART) -> Iterator[list[bytes]]:
    """The words of ``data``, a bounded part at a time, cut at blanks."""
    data, at = data.translate(table), 0
    while at < len(data):
        end = data.find(b" ", at + part)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def word_counts(data: bytes, table: bytes, part: int = PART) -> Counter[bytes]:
    """How often each word is in ``data``."""
    out: Counter[bytes] = Counter()
    for words in words_of(data, table, part):
        out.update(words)
    return out
