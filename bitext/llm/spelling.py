"""Spelling variants: words one edit apart, by a bit-sliced position index.

Words are maximal runs of ASCII and Latin-1 letters (U+00C0 to U+00FF), only A-Z lower-cased.
Two words are near if one inserted, deleted or replaced code point turns one into the other; a
word's form is its near word of largest count, if that is ``FORM`` times its own.

Two near words, of which the shorter has ``a`` letters, share their first ``a // 2`` letters or
their last ``a - a // 2``. Each word is therefore put under both halves, for the pairs in which
it is the shorter or as long (``a`` its length) and those in which it is the longer (one less).
Inside a block of words, bit x of the set (position, letter) tells whether word x has the letter
there. All queries of a block step through their letters together: ``exact`` holds the words
without an error so far, ``replaced`` those with one replaced letter, ``inserted`` those with
one letter more, which are looked up one position further. A pair that shares both halves
counts in the block of its first half only.

Defined results: a null text has no words; a null doc_id is the empty string in ``<doc_id>:<run>``;
repeated rows count each; an empty table gives no rows; words of any length take part; further
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .counting import HELD, byte_table, word_counts

MIN_LETTERS, MIN_COUNT, FORM, MISSPELT = 7, 2, 10, 31
LETTERS = bytes([*range(97, 123), *range(0xC0, 0x100)])
TABLE = byte_table(LETTERS)
#: Words of a bucket that meet in one block; a larger bucket goes by pairs of blocks.
BLOCK = 4096
#: Rows of small buckets that travel to one task together, and words of them in one index.
PACK_ROWS, PACK_WORDS = 20_000, 512
#: Queries that step together, and letters that a block may hold.
SLICE, BLOCK_LETTERS = 1024, 1 << 22


def document_words(doc_id: int | None, text: str) -> Counter[bytes]:
    """Counts of the words of one document, in Latin-1, after the deletions that its id fixes."""
    out: Counter[bytes] = Counter()
    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in word_counts(text.encode("latin-1", "replace"), TABLE).items():
        if len(run) < MIN_LETTERS:
            continue
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
        if h % MISSPELT == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
            if len(run) < MIN_LETTERS:
                continue
        out[run] += n
    return out


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: words of at least ``MIN_LETTERS`` letters and ``MIN_COUNT`` occurrences, written once."""
    def rows(held: Counter[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        for batch in batches:
            for doc_id, text in zip(*batch.columns, strict=True):
                if text.is_valid:
                    held.update(document_words(doc_id.as_py(), text.as_py()))
                if len(held) >= HELD:
                    yield rows(held)
                    held = Counter()
        if held:
            yield rows(held)

    counts = shared.as_text_rows(docs).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return shared.materialize(counts.where(F.col("n") >= MIN_COUNT), "spelling-words")


def bits(flags: np.ndarray) -> np.ndarray:
    """Rows of flags as rows of 64-bit words."""
    packed = np.packbits(flags, axis=1, bitorder="little")
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


def near_pairs(words: list[bytes], a: int, first_half: bool, bucket: np.ndarray, side: np.ndarray, cross: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Arrays (q, x): word q has ``a`` letters, x as many or one more, and they are near.

    Only words of one bucket meet, with ``cross`` only those of different sides.
    """
    n = len(words)
    letters = np.frombuffer(b"".join(w.ljust(a + 1, b"\0") for w in words), np.uint8).reshape(n, a + 1)
    alphabet = np.flatnonzero(np.bincount(letters.ravel(), minlength=256))
    code_of = np.zeros(256, np.uint8)
    code_of[alphabet] = np.arange(len(alphabet))
    codes = code_of[letters]
    longer = letters[:, a] != 0
    buckets = bucket[:, None] * 2 + (side[:, None] if cross else 0)
    kinds, kind = np.unique(buckets, return_inverse=True)
    kind = kind.ravel()
    members = bits(kinds[:, None] == buckets.T)
    partner = np.searchsorted(kinds, kinds ^ 1) if cross else np.arange(len(kinds))
    if cross:  # a bucket may have one side only
        members = np.vstack([members, np.zeros((1, members.shape[1]), np.uint64)])
        partner = np.where((partner < len(kinds)) & (kinds[np.minimum(partner, len(kinds) - 1)] == kinds ^ 1), partner, len(kinds))
    is_longer = bits(longer[None, :])

    def index(at: int) -> np.ndarray:
        return bits(codes[:, at] == np.arange(len(alphabet))[:, None])

    shorter = np.flatnonzero(~longer)
    for at in range(0, len(shorter), SLICE):
        query = shorter[at : at + SLICE]
        exact = members[partner[kind[query]]]
        replaced, inserted = np.zeros_like(exact), np.zeros_like(exact)
        shared_half = None
        here = index(0)
        for i in range(a):
            if i == a // 2:
                shared_half = exact.copy()
            further, letter = index(i + 1), codes[query, i]
            same = here[letter]
            inserted = (inserted | exact) & further[letter]
            replaced = (replaced & same) | (exact & ~same)
            exact &= same
            here = further
        found = ((inserted | exact) & is_longer) | (replaced & ~is_longer)
        if not first_half:
            found &= ~shared_half
        q, x = np.nonzero(np.unpackbits(found.view(np.uint8), axis=1, count=n, bitorder="little"))
        yield query[q], x


def _near_rows(table: pa.Table) -> pa.Table:
    """word, n_near, best (count and word) of the pairs of one group of buckets."""
    words = [w.encode("latin-1") for w in table.column("word").to_pylist()]
    order = sorted(range(len(words)), key=words.__getitem__)
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    n, length = table.column("n").to_numpy(), np.array([len(w) for w in words], np.int64)
    rank = np.empty(len(words), np.int64)  # largest count first, then code points
    by_rank = np.lexsort((place, -n))
    rank[by_rank] = np.arange(len(words))
    a, half = table.column("a").to_numpy(), table.column("half").to_pylist()
    first, side = table.column("first").to_numpy(zero_copy_only=False), table.column("side").to_numpy()
    cross = table.column("cross")[0].as_py()
    near, best = np.zeros(len(words), np.int64), np.full(len(words), len(words), np.int64)

    def credit(word: np.ndarray, other: np.ndarray) -> None:
        np.add.at(near, word, 1)
        np.minimum.at(best, word, rank[other])

    for rows, bucket in _blocks(a, first, half):
        for q, x in near_pairs([words[r] for r in rows], int(a[rows[0]]), bool(first[rows[0]]), bucket, side[rows], cross):
            q, x = rows[q], rows[x]
            credit(q, x)
            longer = length[x] > a[x]
            credit(x[longer], q[longer])
    hit = np.flatnonzero(near)
    other = by_rank[best[hit]]
    return pa.table({
        "word": pa.array([words[r].decode("latin-1") for r in hit], pa.string()), "n_near": pa.array(near[hit]),
        "form_n": pa.array(n[other]), "form": pa.array([words[r].decode("latin-1") for r in other], pa.string()),
    })


def _blocks(a: np.ndarray, first: np.ndarray, half: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows that share an index, with the number of each one's bucket: whole buckets of one length and half."""
    key = list(zip(a.tolist(), first.tolist(), half, strict=True))
    order = sorted(range(len(key)), key=key.__getitem__)
    rows: list[int] = []
    number: list[int] = []
    at = 0
    while at < len(order):
        end = at
        while end < len(order) and key[order[end]] == key[order[at]]:
            end += 1
        other = bool(rows) and key[rows[0]][:2] != key[order[at]][:2]
        if rows and (other or len(rows) + end - at > PACK_WORDS or (len(rows) + end - at) * key[rows[0]][0] > BLOCK_LETTERS):
            yield np.array(rows), np.array(number)
            rows, number = [], []
        if end - at > 1:
            rows += order[at:end]
            number += [at] * (end - at)
        at = end
    if rows:
        yield np.array(rows), np.array(number)


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, n_near, form_n, form: of every word that has near words, how many, and the best of them."""
    length = F.length("word")
    a = F.explode(F.when(length > MIN_LETTERS, F.array(length, length - 1)).otherwise(F.array(length))).alias("a")
    halves = words.select("word", "n", a).select(
        "*", F.explode(F.array(
            F.struct(F.lit(True).alias("first"), F.substring("word", F.lit(1), F.floor(F.col("a") / 2).cast("int")).alias("half")),
            F.struct(F.lit(False).alias("first"), F.right("word", F.ceil(F.col("a") / 2).cast("int")).alias("half")),
        )).alias("k")
    ).select("word", "n", "a", "k.*")
    key = ["a", "first", "half"]
    packs = words.count() * 4 // PACK_ROWS + 1
    dealt = halves.select("*", F.lit(0).alias("side"), F.lit(False).alias("cross"), F.concat(F.lit("p"), F.pmod(F.xxhash64(*key), F.lit(packs)).cast("string")).alias("pack"))
    large = shared.materialize(halves.groupBy(*key).agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > block), "spelling-large")
    if not large.isEmpty():
        light = dealt.join(large.select(*key), key, "left_anti").select(dealt.columns)
        blocks = F.ceil(F.col("members") / block).cast("long")
        own = halves.join(large, key).withColumn("own", F.pmod(F.xxhash64("word"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        pack = F.concat_ws(":", "a", "first", "half", F.least("own", "other"), F.greatest("own", "other"))
        heavy = own.withColumn("side", F.when(F.col("own") > F.col("other"), 1).otherwise(0)).withColumn("cross", F.col("own") != F.col("other")).withColumn("pack", pack)
        dealt = light.unionByName(heavy.select(dealt.columns))
    found = dealt.groupBy("pack").applyInArrow(_near_rows, "word string, n_near long, form_n long, form string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("order"), "form")).alias("best")).select(
        "word", "n_near", (-F.col("best.order")).alias("form_n"), F.col("best.form").alias("form")
    )


def _roots(forms: DataFrame) -> DataFrame:
    """word, root of rows (word, form): counts grow ``FORM`` times a step, so a few doublings reach every end."""
    at = shared.materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        jump = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = shared.materialize(at.join(jump, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        at = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return at


def spelling_forms(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row a word."""
    words = vocabulary(docs)
    good = F.col("form_n") >= F.col("n") * FORM
    told = shared.materialize(words.join(near_words(words, block), "word", "left").select(
        "word", F.when(good, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("form_n")).alias("form_n"),
    ), "spelling-forms")
    roots = _roots(told.where("form IS NOT NULL"))
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
