"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Pre-tokens are linked lists of byte positions. Each position holds the rank of the pair that
starts there; a bucket per rank holds positions, and a bitmap of two levels finds the lowest
rank that has any. A popped position whose pair has changed since is stale and is skipped.

The queue comes in two forms. ``merge`` takes one pre-token, however long: every merge costs
two inserts, so n bytes cost O(n log n). ``merge_all`` takes many short pre-tokens at once:
their lists lie in one array with a gap between them, a bucket holds positions of all of them,
and each pop merges a whole bucket with numpy. Pre-tokens do not touch each other, so one
queue gives each of them its own order; the rare one in which a merge makes a pair of a lower
rank than the one at hand is done again by ``merge``.

Texts are encoded in runs of about ``RUN_CHARS`` characters: distinct pre-tokens of a run that
a bounded cache does not know go through the queue together. A longer text is split piece by
piece, so memory does not grow with it.

Defined results: null or empty texts have no ids, and decode to no bytes; texts are encoded
whole; special tokens do not exist, their strings are ordinary text; repeated rows give a row
each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import shared

#: Pre-tokens of one Python worker's cache, and the longest that goes into it, in characters.
CACHE_ROWS = 200_000
CACHE_CHARS = 64
#: Characters that are split and encoded together.
RUN_CHARS = 1 << 20
#: Ids that are decoded together.
DECODE_IDS = 1 << 17
NONE = 1 << 24
BIT = [1 << k for k in range(256)]
#: The id of the gap between two lists, above all others, and the bits that it takes.
GAP, ID_BITS = 1 << 24, 25
#: The longest look ahead of the pattern beyond a match, in characters.
AHEAD = 4


class Codec:
    """Encoder and decoder over a rank file (base64 token and rank per line)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.pairs = [ranks.get(bytes((a, b)), NONE) for a in range(256) for b in range(256)]
        self.byte_ids = np.array([ranks[bytes((b,))] for b in range(256)], np.int32)
        # Every pair of tokens that is a token, sorted: the left id in the high bits.
        pairs = [(ranks[t[:k]] << ID_BITS | ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        known = np.array([*sorted(pairs), (1 << 62, NONE)], np.int64)
        self.pair_keys, self.pair_ranks = known[:, 0].copy(), known[:, 1].astype(np.int32)
        # All tokens behind each other, by id.
        tokens = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            tokens[r] = t
        self.sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: lowest rank first, leftmost first."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        get, n = self.ranks.get, len(piece)
        after = list(range(1, n + 1))
        before = list(range(-1, n))
        pairs = self.pairs
        rank = [pairs[a << 8 | b] for a, b in zip(piece, piece[1:], strict=False)] + [NONE]
        # The queue: positions per rank, and which ranks have any, in two levels of bits.
        buckets: dict[int, list[int]] = {}
        low: dict[int, int] = {}
        high = 0
        for i, r in enumerate(rank):
            if r != NONE:
                if r in buckets:
                    buckets[r].append(i)
                else:
                    buckets[r] = [i]
                    low[r >> 8] = low.get(r >> 8, 0) | BIT[r & 255]
                    high |= 1 << (r >> 8)
        while high:
            h = (high & -high).bit_length() - 1
            bits = low[h]
            r = h << 8 | (bits & -bits).bit_length() - 1
            bucket = buckets[r]
            if len(bucket) > 1:
                i = heapq.heappop(bucket)
            else:
                i = bucket[0]
                del buckets[r]
                low[h] = bits = bits & (bits - 1)
                if not bits:
                    high &= high - 1
            if rank[i] != r:
                continue  # stale
            j = after[i]  # joins i, and leaves the list
            k = after[i] = after[j]
            before[k] = i
            rank[j] = NONE
            changed = [(i, get(piece[i : after[k]], NONE) if k < n else NONE)]
            g = before[i]
            if g >= 0:
                changed.append((g, get(piece[g:k], NONE)))
            for at, r in changed:
                rank[at] = r
                if r != NONE:
                    if r in buckets:
                        heapq.heappush(buckets[r], at)
                    else:
                        buckets[r] = [at]
                        low[r >> 8] = low.get(r >> 8, 0) | BIT[r & 255]
                        high |= 1 << (r >> 8)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << ID_BITS | right
        at = self.pair_keys.searchsorted(key)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of many pre-tokens, none of them empty, by one queue."""
        if not pieces:
            return []
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        gaps = np.concatenate([[0], np.cumsum(sizes + 1)])
        total = int(gaps[-1]) + 1
        ids = np.full(total, GAP, np.int32)
        filled = np.ones(total, bool)
        filled[gaps] = False
        ids[filled] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.arange(1, total + 1, dtype=np.int32)
        before = np.arange(-1, total - 1, dtype=np.int32)
        rank = np.full(total, NONE, np.int32)
        rank[:-1] = self._pair_ranks(ids[:-1], ids[1:])
        buckets: dict[int, list[np.ndarray]] = {}
        low: dict[int, int] = {}
        high = 0

        def push(at: np.ndarray, ranks: np.ndarray) -> None:
            nonlocal high
            order = ranks.argsort(kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(at)]
            for r, a, b in zip(ranks[cuts[:-1]].tolist(), cuts, cuts[1:], strict=False):
                if r in buckets:
                    buckets[r].append(at[a:b])
                else:
                    buckets[r] = [at[a:b]]
                    low[r >> 8] = low.get(r >> 8, 0) | BIT[r & 255]
                    high |= 1 << (r >> 8)

        again: list[np.ndarray] = []
        paired = np.flatnonzero(rank != NONE).astype(np.int32)
        if len(paired):
            push(paired, rank[paired])
        while high:
            h = (high & -high).bit_length() - 1
            bits = low[h]
            r = h << 8 | (bits & -bits).bit_length() - 1
            low[h] = bits = bits & (bits - 1)
            if not bits:
                high &= high - 1
            own = buckets.pop(r)
            i = own[0] if len(own) == 1 else np.concatenate(own)
            i = i[rank[i] == r]  # the others are stale
            chained = rank[before[i]] == r
            if chained.any():  # of overlapping pairs, the leftmost goes first
                push(i[chained], rank[i[chained]])
                i = i[~chained]
            if not len(i):
                continue
            j = after[i]
            k = after[j]
            touching = k[rank[k] == r]  # merged at once with what precedes them
            if len(touching):
                between = self._pair_ranks(np.full(len(touching), r), ids[touching])
                again.append(touching[between < r])
            after[i] = k
            before[k] = i
            rank[j] = NONE
            ids[i] = r
            ids[j] = -1
            changed = np.concatenate([i, before[i]])
            now = self._pair_ranks(ids[changed], ids[np.concatenate([k, i])])
            rank[changed] = now
            changed, now = changed[now != NONE], now[now != NONE]
            if len(now):
                if now.min() < r:
                    again.append(changed[now < r])
                push(changed, now)
        left = ids[ids >= 0]
        ends = (np.flatnonzero(left == GAP) * 4).tolist()
        packed = left.astype("<u4").tobytes()
        out = [packed[a + 4 : b] for a, b in zip(ends, ends[1:], strict=False)]
        for k, whole in enumerate(map(self.ranks.get, pieces)):
            if whole is not None:
                out[k] = _pack([whole])
        if again:
            for k in set((gaps.searchsorted(np.concatenate(again)) - 1).tolist()):
                out[k] = _pack(self.merge(pieces[k]))
        return out

    def _learn(self, pieces: set[str]) -> list[str]:
        """Put the ids of ``pieces`` into the cache; returns those that are too long to stay."""
        cache, older = self.cache, self.older
        short, long = [], []
        for p in pieces.difference(cache):
            if p in older:
                cache[p] = older[p]
            elif len(p) <= CACHE_CHARS:
                short.append(p)
            else:
                long.append(p)
        cache.update(zip(short, self.merge_all([p.encode() for p in short]), strict=True))
        cache.update((p, _pack(self.merge(p.encode()))) for p in long)
        return long

    def _runs(self, texts: Iterable[str | None]) -> Iterator[list[tuple[list[str], bool]]]:
        """(pre-tokens, whether they end a text) of about RUN_CHARS characters at a time."""
        run: list[tuple[list[str], bool]] = []
        held = 0
        for text in texts:
            at, end = 0, len(text or "")
            while end - at > RUN_CHARS:
                # What the cut may have changed is matched again: the last match, and what it may have looked ahead to.
                size, kept = RUN_CHARS, []
                while not kept and at + size < end:
                    found = self.split(text, at, at + size)
                    left = size
                    while found and left > size - AHEAD:
                        left -= len(found.pop())
                    kept, size = found, 2 * size
                if not kept:
                    break
                at += sum(map(len, kept))
                yield [*run, (kept, False)]
                run, held = [], 0
            run.append((self.split(text, at) if text else [], True))
            held += end - at
            if held >= RUN_CHARS:
                yield run
                run, held = [], 0
        if run:
            yield run

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of every text, in order, as little-endian unsigned 32-bit integers."""
        begun: list[bytes] = []
        for run in self._runs(texts):
            long = self._learn(set().union(*(pieces for pieces, _ in run)))
            ids = self.cache.__getitem__
            for pieces, ends in run:
                begun.append(b"".join(map(ids, pieces)))
                if ends:
                    yield b"".join(begun)
                    begun = []
            for p in long:
                del self.cache[p]
            if len(self.cache) >= CACHE_ROWS // 2:  # what is not met again in the next half goes
                self.older, self.cache = self.cache, {}

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_all([text]))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(self.decode_parts(ids))

    def decode_parts(self, ids: bytes) -> Iterator[bytes]:
        """The bytes of packed ids, a bounded part at a time."""
        every = np.frombuffer(ids, "<u4")
        for at in range(0, len(every), DECODE_IDS):
            own = every[at : at + DECODE_IDS]
            sizes = self.sizes[own]
            ends = np.cumsum(sizes)
            yield self.bytes[np.arange(ends[-1]) + np.repeat(self.starts[own] - ends + sizes, sizes)].tobytes()


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


_codecs: dict[str, Codec] = {}


def codec(path: str | None = None) -> Codec:
    """One codec per process and vocabulary; the default one is read from the installed files."""
    import public_tokenizers

    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    if path not in _codecs:
        _codecs[path] = Codec(load_ranks(path), public_tokenizers.PATTERN)
    return _codecs[path]


def encode_documents(docs: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` plus the packed ids (binary), under a name that is free."""
    ids = shared.free_name(docs, ids)
    schema = T.StructType([T.StructField(ids, T.BinaryType())])

    def make() -> Callable:
        c = codec(path)
        return lambda texts: ((x,) for x in c.encode_all(texts))

    return shared.append_columns(docs, text, make, schema)


def round_trip(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document, in one pass."""
    schema = T.StructType([
        T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
    ])

    def make() -> Callable:
        c = codec(path)

        def digests(texts: Iterable[str | None]) -> Iterator[tuple]:
            for ids in c.encode_all(texts):
                decoded = hashlib.sha256()
                for part in c.decode_parts(ids):
                    decoded.update(part)
                yield len(ids) // 4, hashlib.sha256(ids).hexdigest(), decoded.hexdigest()

        return digests

    rows = shared.as_text_rows(docs, doc_id, text)
    return shared.append_columns(rows, "text", make, schema).drop("text")
