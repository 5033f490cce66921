"""Word sequences of texts, in Arrow batches, and a filter of those that can be frequent.

The filter knows sequences by 44-bit hashes. Equal ones have equal hashes, so one whose hash comes
less than so many times comes less than so many times itself: what the filter drops is not
frequent, what it passes has to be counted by its words.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitext.storage import materialize, new_path, open_fs

#: Letters of scripts that are written without blanks: each is a word by itself.
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
#: What texts begin with, so that words do not go on from one to the next.
BREAK = "\x00"
#: Bytes of text looked at together; hashes counted together; rows counted together, and those that leave Python at once.
CHUNK, HELD, MERGED, ROWS = 1 << 21, 1 << 20, 1 << 20, 1 << 16
#: Bits of a slice of the filter, as a power of two, bits for each hash, and slices at most (64 MB): with more hashes, more passes.
SLICE, EACH, MOST_SLICES = 20, 16, 1 << 9
#: Hashes have this many bits and 32 more. Those with the same first ones are counted in one go: 1/4096 of all, some 25 MB for 100 GB of text.
PARTS = 12

#: Of ASCII bytes: 0 letter, 1 blank, 2 neither. Bytes of other characters count as letters at first.
_KIND = np.full(256, 2, np.uint8)
_KIND[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(128, 256)]] = 0
_KIND[list(b" \t\n\f\r")] = 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def has_unspaced(c: Column) -> Column:
    """Whether there may be such letters: all of them lie beyond U+0E00."""
    return (F.octet_length(c) > F.length(c)) & c.rlike(r"[^\x00-\x{dff}]")


def segmented(c: Column) -> Column:
    """``BREAK`` and the text in lower case, with blanks around each of the ``UNSPACED`` letters with its marks."""
    low = F.lower(c)
    return F.concat(F.lit(BREAK), F.when(has_unspaced(low), F.regexp_replace(low, rf"([[{UNSPACED}]&&[\p{{L}}\p{{M}}]]\p{{M}}*)", " $1 ")).otherwise(low))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Of each code point, whether it is a letter or a mark."""
    return np.fromiter((unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)), bool, 0x110000)


def _kinds(data: np.ndarray) -> np.ndarray:
    """Of each byte of UTF-8, whether its character is part of a word (0), a blank (1) or neither (2)."""
    kind = _KIND[data]
    at = np.flatnonzero(data >= 0xC0)
    if len(at):
        byte = [np.append(data, np.zeros(3, np.uint8))[at + k].astype(np.int32) for k in range(4)]
        size = 2 + (byte[0] >= 0xE0) + (byte[0] >= 0xF0)
        code = (byte[0] & 0x1F) << 6 | byte[1] & 0x3F
        for n, mask in ((3, 0x0F), (4, 0x07)):
            more = byte[0] & mask
            for k in range(1, n):
                more = more << 6 | byte[k] & 0x3F
            code = np.where(size == n, more, code)
        other = ~_letters()[np.minimum(code, 0x10FFFF)]
        for k in range(4):
            kind[at[other & (size > k)] + k] = 2
    return kind


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Array]:
    """The texts of the first column, about ``CHUNK`` bytes at a time."""
    held, size = [], 0
    for batch in batches:
        texts = batch.column(0).cast(pa.large_string())
        ends = np.cumsum(pc.binary_length(texts).to_numpy())
        at = 0
        while at < len(texts):
            before = ends[at - 1] if at else 0
            to = max(int(np.searchsorted(ends, before + CHUNK - size, "right")), at + 1)
            held.append(texts.slice(at, to - at))
            size += ends[to - 1] - before
            at = to
            if at < len(texts) or size >= CHUNK:
                yield pa.concat_arrays(held)
                held, size = [], 0
    if held:
        yield pa.concat_arrays(held)


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Different words, the number of each word among them, and whether the next word is in the same segment."""
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]
    kind = _kinds(data)
    letter = kind == 0
    edges = np.flatnonzero(np.diff(letter, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    segment = np.cumsum(kind == 2, dtype=np.int32)[starts]
    follows = np.zeros(len(starts), bool)
    follows[:-1] = segment[1:] == segment[:-1]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[letter])).dictionary_encode()
    return words.dictionary, words.indices.to_numpy(), follows


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _hash_words(words: pa.Array) -> np.ndarray:
    """A hash of each word: sums over all bytes, taken apart by words."""
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(data, np.uint8)[: ends[-1]].astype(np.uint64) + np.uint64(1)
    powers = np.cumprod(np.full(len(data), _BASE, np.uint64))
    back = np.cumprod(np.full(len(data) + 1, _INVERSE, np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data * powers, dtype=np.uint64)])
    return _mix((sums[ends[1:]] - sums[ends[:-1]]) * back[ends[:-1]] + np.diff(ends).astype(np.uint64))


def _later(x: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros_like(x)
    out[: len(x) - n] = x[n:]
    return out


def _two_and_three(words: pa.Array, at: np.ndarray, follows: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
    """For two words, and for three, from each word on: their hash of 44 bits, and whether there are so many in the segment."""
    if not len(at):
        return ((np.zeros(0, np.uint64), follows),) * 2
    one = _hash_words(words)[at]
    two = _mix(one * np.uint64(_BASE) + _later(one, 1))
    three = _mix(two * np.uint64(_BASE) + _later(one, min(2, len(one))))
    short = np.uint64(32 - PARTS)
    return (two >> short, follows), (three >> short, follows & _later(follows, 1))


def _frequent(texts: DataFrame, least: int, sizes: int) -> DataFrame:
    """part, n, h: the hashes of two words, or of two and of three, that come ``least`` times or more, by their first bits, the others packed."""

    def told(held: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        h = np.repeat(h, np.minimum(n, least))
        edges = np.append(np.searchsorted(h, np.arange(1 << PARTS, dtype=np.uint64) << np.uint64(32)), len(h))
        parts = np.flatnonzero(np.diff(edges))
        offsets = np.append(edges[parts], len(h)).astype(np.int32) * np.int32(4)
        packed = pa.Array.from_buffers(pa.binary(), len(parts), [None, pa.py_buffer(offsets), pa.py_buffer(h.astype(np.uint32))])
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), packed], names=["part", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for chunk in _texts(batches):
            held += [h[there] for h, there in _two_and_three(*_words(chunk))[:sizes]]
            if sum(map(len, held)) >= HELD:
                yield told(held)
                held = []
        if held:
            yield told(held)

    def count(group: pa.Table) -> pa.Table:
        h, n = np.unique(np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in group.column("h")]), return_counts=True)
        h = h[n >= least]
        return pa.table({"part": group.column("part").slice(0, 1), "n": pa.array([len(h)], pa.int64()), "h": pa.array([h.tobytes()], pa.binary())})

    return texts.mapInArrow(run, "part int, h binary").groupBy("part").applyInArrow(count, "part int, n long, h binary")


def _bits(h: np.ndarray, log: int) -> Iterator[np.ndarray]:
    """The places of each hash in the filter of 2 ** ``log`` slices, one after the other."""
    own, mask = np.uint64(SLICE), np.uint64((1 << SLICE) - 1)
    base = h >> np.uint64(32 + PARTS - log) << own
    for x in (h, h >> own, (h * np.uint64(_BASE)) >> np.uint64(64 - SLICE)):
        yield base + (x & mask)


def write_filter(texts: DataFrame, least: int, sizes: int) -> tuple[str, int]:
    """Folder of a filter of the sequences of two words, or of two and three, that come ``least`` times or more, and its slices as a power of two."""
    frequent = materialize(_frequent(texts, least, sizes), "hashes")
    found = frequent.agg(F.sum("n")).first()[0] or 0
    log = min(max(EACH * found >> SLICE, 1), MOST_SLICES).bit_length() - 1

    def run(group: pa.Table) -> pa.Table:
        out = np.zeros(1 << SLICE, bool)
        for part, x in zip(group.column("part").to_numpy(), group.column("h"), strict=True):
            for at in _bits(np.frombuffer(x.as_buffer(), np.uint32) | np.uint64(part) << np.uint64(32), log):
                out[at & np.uint64((1 << SLICE) - 1)] = True
        return pa.table({"slice": group.column("slice").slice(0, 1), "bits": pa.array([np.packbits(out).tobytes()], pa.binary())})

    path = new_path(texts.sparkSession, "filter")
    dealt = frequent.where("n > 0").select(F.shiftright("part", PARTS - log).alias("slice"), "part", "h")
    dealt.groupBy("slice").applyInArrow(run, "slice int, bits binary").write.parquet(path)
    return path, log


@lru_cache(maxsize=1)
def _read_filter(path: str, log: int) -> np.ndarray:
    fs, base = open_fs(path)
    slices = pq.read_table(base, filesystem=fs)
    size = (1 << SLICE) // 8
    out = np.zeros(size << log, np.uint8)
    for k, bits in zip(slices.column("slice").to_pylist(), slices.column("bits"), strict=True):
        out[k * size : (k + 1) * size] = np.frombuffer(bits.as_buffer(), np.uint8)
    return out


def _passing(path: str, log: int, h: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Where the filter has the hash, of the places that are ``there``."""
    known, left = _read_filter(path, log), np.flatnonzero(there)
    for n in range(3):
        bit = next(x for k, x in enumerate(_bits(h[left], log)) if k == n)
        left = left[(known[bit >> np.uint64(3)] >> (np.uint8(7) - (bit & np.uint64(7)).astype(np.uint8))) & np.uint8(1) > 0]
    out = np.zeros(len(h), bool)
    out[left] = True
    return out


def _numbered(known: pa.Array, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The known words and the new ones after them, and the number of each of ``words`` there."""
    at = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy().astype(np.int64)
    new = at < 0
    at[new] = len(known) + np.arange(new.sum())
    return pa.concat_arrays([known, words.filter(pa.array(new))]), at


def _twos(at: np.ndarray, good: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Different sequences of two words that start where it is ``good``, and how often they come."""
    here = np.flatnonzero(good)
    both, n = np.unique(at[here] << 32 | at[here + 1], return_counts=True)
    return [both >> 32, both & 0xFFFFFFFF], n


def _longer(at: np.ndarray, good: np.ndarray, most: int) -> tuple[list[np.ndarray], np.ndarray]:
    """From every ``good`` place on three words and those after them, up to ``most``, while every three in a row are good."""
    edges = np.flatnonzero(np.diff(good, prepend=False, append=False))
    here = np.flatnonzero(good)
    size = np.repeat(edges[1::2], edges[1::2] - edges[::2]) + 2 - here
    return [np.where(k < size, at[np.where(k < size, here + k, here)], -1) for k in range(most)], np.ones(len(here), np.int64)


def _joined(words: list[pa.Array]) -> pa.Array:
    # Words that are not there leave blanks at the end.
    return pc.ascii_rtrim(pc.binary_join_element_wise(*words, " ", null_handling="replace", null_replacement=""), " ")


def sequences(texts: DataFrame, known: tuple[str, int] | None, most: int) -> DataFrame:
    """head, tail, words, n: what may be frequent of ``segmented`` texts, and how often it comes; equal ones have several rows.

    Single words and two that pass the filter stand in ``head``. A longer sequence of which every
    three words in a row pass is one row for all from three words to ``most`` that start there: its
    first three words in ``head``, the others in ``tail``.
    """
    names = [f"w{k}" for k in range(most)]

    def rows(nth: list[np.ndarray], n: np.ndarray) -> pa.Table:
        nth = nth + [np.full(len(n), -1)] * (most - len(nth))
        return pa.table([pa.array(x, pa.int32()) for x in nth] + [pa.array(n, pa.int64())], names=[*names, "n"])

    def added(held: list[pa.Table]) -> pa.Table:
        sums = pa.concat_tables(held).group_by(names, use_threads=False).aggregate([("n", "sum")])
        return sums.select([*names, "n_sum"]).rename_columns([*names, "n"])

    def told(words: pa.Array, sums: pa.Table) -> Iterator[pa.RecordBatch]:
        nth = [sums.column(x).to_numpy() for x in names]
        order = np.argsort(nth[0] if most == 1 else nth[0].astype(np.int64) << 32 | nth[1])  # like ones together: the shuffle's blocks are smaller by it
        for at in range(0, len(order), ROWS):
            here = order[at : at + ROWS]
            each = [words.take(pa.array(x[here], mask=x[here] < 0)) for x in nth]
            tail = _joined(each[3:]) if most > 3 else pa.repeat("", len(here))
            size = pa.array(sum((x[here] >= 0).astype(np.int32) for x in nth))
            yield pa.RecordBatch.from_arrays([_joined(each[:3]), tail, size, sums.column("n").take(pa.array(here)).combine_chunks()], names=["head", "tail", "words", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held = pa.array([], pa.string()), []
        for chunk in _texts(batches):
            own, at, follows = _words(chunk)
            words, numbers = _numbered(words, own)
            held.append(rows([numbers], np.bincount(at, minlength=len(own))))
            if known is not None:
                two, (three, there) = _two_and_three(own, at, follows)
                good = _passing(*known, *two)
                held.append(rows(*_twos(numbers[at], good)))
                if most > 2:
                    held.append(rows(*_longer(numbers[at], _passing(*known, three, there & good & _later(good, 1)), most)))
            if sum(map(len, held[1:])) >= max(len(held[0]), MERGED // 4):
                held = [added(held)]
                if len(held[0]) >= MERGED:
                    yield from told(words, held[0])
                    words, held = words.slice(0, 0), []
        if held:
            yield from told(words, added(held))

    return texts.mapInArrow(run, "head string, tail string, words int, n long")
