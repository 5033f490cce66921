"""Benchmark decontamination: Wu-Manber search of word windows in every document.

Words are maximal runs outside ASCII non-alphanumerics after lower-casing A-Z. Each run of
``WINDOW`` item words is a pattern; an item with fewer words is one pattern. The search moves
a window over the document's word ids: a shift table over blocks of two words skips places
where no pattern can end, buckets by the hash of the last and the first block select patterns,
and a direct comparison confirms them. Pattern lengths are searched one by one, longest first.

Tables are sorted arrays: the items' words once, a shift per distinct block and a bucket entry
per pattern, about 30 bytes a word, and a dictionary of the distinct words.

Defined results: null or wordless texts have no words and no hits; an item without words has
no window; items without an id mark words but are not listed; repeated item rows count once;
repeated documents give a row each; empty tables give no rows, or no hits; further columns
are ignored by ``find_leaks`` and kept by ``drop_leaks``.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

WINDOW = 10
#: UTF-8 bytes of item text that one pass holds in memory; more items take more passes.
BLOCK_BYTES = 8 << 20
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode().lower()) if text else []


class Table:
    """Shifts and buckets of the patterns of ``size`` words, which end at ``ends`` in ``seq``."""

    def __init__(self, seq: np.ndarray, spans: list[tuple[int, int]], size: int, base: int):
        self.size, self.base, self.width = size, base, min(2, size)
        first, last = (np.array(x, np.int64) for x in zip(*spans, strict=True))
        n = last - first - self.width + 1
        # Every block of the items, by its last word, and the smallest shift that an own pattern gives it.
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + self.width - 1
        ends = np.repeat(first, n) + at
        blocks, shifts = self._blocks(seq, ends), np.maximum(0, size - 1 - at).astype(np.uint8)
        order = np.lexsort((shifts, blocks))
        blocks, ordered = blocks[order], shifts[order]
        keep = np.concatenate([[True], blocks[1:] != blocks[:-1]])
        self.blocks, self.shifts = np.append(blocks[keep], np.iinfo(np.int64).max), np.append(ordered[keep], np.uint8(0))
        ends = ends[shifts == 0]
        hashes = self._hash(self._blocks(seq, ends), self._blocks(seq, ends - size + self.width))
        order = np.argsort(hashes)
        self.hashes, self.ends = hashes[order], ends[order].astype(np.int32)

    def _blocks(self, seq: np.ndarray, ends: np.ndarray) -> np.ndarray:
        own = seq[ends].astype(np.int64)
        return own if self.width == 1 else seq[ends - 1].astype(np.int64) * self.base + own

    @staticmethod
    def _hash(last: np.ndarray, first: np.ndarray) -> np.ndarray:
        return (last.astype(np.uint64) * _MIX) ^ ((first.astype(np.uint64) + np.uint64(1)) * _MIX >> np.uint64(7))

    def search(self, seq: np.ndarray, text: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """End of each match in ``text``, and the ends of the equal patterns in ``seq``."""
        size, n = self.size, len(text)
        if n < size:
            return
        blocks = self._blocks(text, np.arange(self.width - 1, n))
        at = self.blocks.searchsorted(blocks)
        steps = np.where(self.blocks[at] == blocks, self.shifts[at], size - self.width + 1).tolist()
        stops, off, at = [], self.width - 1, size - 1
        while at < n:
            step = steps[at - off]
            if step:
                at += step
            else:
                stops.append(at)
                at += 1
        if not stops:
            return
        stops = np.array(stops)
        hashes = self._hash(blocks[stops - off], blocks[stops - size + 1])
        low, high = self.hashes.searchsorted(hashes), self.hashes.searchsorted(hashes, "right")
        back = np.arange(1 - size, 1)
        for stop, a, b in zip(stops[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist(), strict=True):
            ends = self.ends[a:b]
            equal = (seq[ends[:, None] + back] == text[stop + back]).all(axis=1)
            if equal.any():
                yield stop, ends[equal]


class Patterns:
    """The windows of some items: their words as one sequence, and a table per pattern length."""

    def __init__(self, items: Iterable[tuple[str | None, str | None]], window: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        self.owners: list[str | None] = []
        flat, starts = [], [0]
        by_size = defaultdict(list)
        for item_id, text in dict.fromkeys(items):
            own = [self.ids.setdefault(w, len(self.ids) + 1) for w in words(text)]
            if own:
                flat.append(np.array(own, np.int32))
                by_size[min(window, len(own))].append((starts[-1], starts[-1] + len(own)))
                starts.append(starts[-1] + len(own))
                self.owners.append(item_id)
        self.seq, self.starts = np.concatenate([np.zeros(0, np.int32), *flat]), np.array(starts)
        self.tables = [Table(self.seq, spans, size, len(self.ids) + 1) for size, spans in sorted(by_size.items(), reverse=True)]

    def search(self, seq: list[int]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged hit intervals (start, end) in words and the ids of items that occur."""
        hits, found, text = [], set(), np.array(seq, np.int32)
        for table in self.tables:
            for stop, ends in table.search(self.seq, text):
                hits.append((stop - table.size + 1, stop + 1))
                found.update(self.owners[k] for k in np.unique(self.starts.searchsorted(ends, "right") - 1).tolist())
        found.discard(None)
        return merged(hits), found


def merged(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(hits):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


FOUND = "n_words long, hits array<struct<start:int,end:int>>, items array<string>"


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """doc_id, n_words, hits (word intervals), items (sorted ids), n_hit, one row per document.

    The items are the stated query set. They are dealt by a hash into as many blocks as their
    measured size needs; every document meets one block per pass, in the scan, without a
    shuffle. With one block, the usual case, there is one pass. With more, each further pass
    writes what it found, without texts, and the findings of a row are put together by the
    digest of its id and text.
    """
    rows = shared.as_text_rows(docs, doc_id, text)
    items, blocks = _dealt(benchmark, item_id, item_text, block_bytes)
    if blocks == 1:
        out = _pass(rows, "doc_id long", _patterns(items, blocks, 0, window))
    else:
        rows = rows.withColumn("row", shared.row_key("doc_id", "text"))
        out = shared.materialize(_pass(rows, "doc_id long, row binary", _patterns(items, blocks, 0, window)), "leaks")
        more = _leaks_of(rows, items, blocks, range(1, blocks), window).groupBy("row")
        more = more.agg(F.flatten(F.collect_list("hits")).alias("more_hits"), F.flatten(F.collect_list("items")).alias("more_items"))
        out = out.join(more, "row", "left").mapInArrow(_put_together, f"doc_id long, row binary, {FOUND}").drop("row")
    size = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x.end - x.start)
    return out.withColumn("n_hit", size)


def _dealt(benchmark: DataFrame, item_id: str, item_text: str, block_bytes: int) -> tuple[DataFrame, int]:
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).cast("string").alias("t")).where("t is not null").distinct()
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    return items, 1 + size // block_bytes


def _patterns(items: DataFrame, blocks: int, block: int, window: int):
    """The patterns of one block of items, bounded by ``block_bytes``, broadcast."""
    part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block)
    return items.sparkSession.sparkContext.broadcast(Patterns([(r.i, r.t) for r in part.toLocalIterator()], window))


def _leaks_of(rows: DataFrame, items: DataFrame, blocks: int, wanted: range, window: int) -> DataFrame:
    """row, hits, items of the rows in which some of the wanted blocks of items occur, one per block."""
    parts = []
    for b in wanted:
        found = _pass(rows, "doc_id long, row binary", _patterns(items, blocks, b, window)).where("size(hits) > 0").select("row", "hits", "items").dropDuplicates(["row"])
        parts.append(shared.materialize(found, "leaks"))
    return reduce(DataFrame.unionByName, parts)


def _pass(rows: DataFrame, kept: str, patterns) -> DataFrame:
    """The columns ``kept`` of ``rows`` (with a column ``text``) plus n_words, hits, items."""
    names = [c.split()[0] for c in kept.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Patterns = patterns.value
        get = p.ids.get
        for batch in batches:
            n_words, hits, items = [], [], []
            for t in batch.column(batch.schema.get_field_index("text")):
                seq = [get(w, 0) for w in words(t.as_py())]
                spans, found = p.search(seq)
                n_words.append(len(seq))
                hits.append([{"start": a, "end": b} for a, b in spans])
                items.append(sorted(found))
            yield _found([batch.column(batch.schema.get_field_index(c)) for c in names], names, n_words, hits, items)

    return rows.select(*names, "text").mapInArrow(run, f"{kept}, {FOUND}")


def _found(kept: list[pa.Array], names: list[str], n_words: list, hits: list, items: list) -> pa.RecordBatch:
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    return pa.RecordBatch.from_arrays([*kept, pa.array(n_words, pa.int64()), pa.array(hits, spans), pa.array(items, pa.list_(pa.string()))], names=[*names, "n_words", "hits", "items"])


def _put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Intervals and items of all blocks, merged."""
    for batch in batches:
        at = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
        own, more = ([[(x["start"], x["end"]) for x in row or ()] for row in at[c].to_pylist()] for c in ("hits", "more_hits"))
        hits = [[{"start": a, "end": b} for a, b in merged(x + y)] for x, y in zip(own, more, strict=True)]
        items = [sorted({*x, *(y or ())}) for x, y in zip(at["items"].to_pylist(), at["more_items"].to_pylist(), strict=True)]
        yield _found([at["doc_id"], at["row"]], ["doc_id", "row"], at["n_words"].to_pylist(), hits, items)


def leak_report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The digest columns per document."""
    return find_leaks(docs, benchmark, **options).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def drop_leaks(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The documents without any benchmark window, all columns.

    One block of items is a filter in the scan. More take a pass each, one after another; what
    they find goes by the digest of id and text.
    """
    items, blocks = _dealt(benchmark, "item_id", "text", block_bytes)
    if blocks == 1:
        return _without(docs, text, _patterns(items, blocks, 0, window))
    rows = shared.as_text_rows(docs, doc_id, text).withColumn("row", shared.row_key("doc_id", "text"))
    found = _leaks_of(rows, items, blocks, range(blocks), window)
    return shared.keep_rows(docs, found.select(F.col("row").alias("key"), F.lit(False).alias("kept")), shared.row_key(doc_id, text), text)


def _without(docs: DataFrame, text: str, patterns) -> DataFrame:
    place = docs.columns.index(text)
    kind = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Patterns = patterns.value
        get = p.ids.get
        for batch in batches:
            clean = [not p.search([get(w, 0) for w in words(t.as_py())])[0] for t in batch.column(place)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, kind)


def items_digest(items: Iterable[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
