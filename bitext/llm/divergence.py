"""Source divergence: how far each source's word shares lie from its language's and from each other's.

Terms are the runs of ASCII letters and characters beyond ASCII, only A-Z lower-cased; a
language keeps those in at least ``MIN_DOCS`` of its rows. A group (lang, source), and a lang as
a whole, gives a kept term the share ``1 + SCALE * (count + 5) // (N + 5 * V)``.

The shares of a group are run-length columns. The kept terms of a language are ordered by their
total and by a digest of their counts in all sources, which puts equal counts next to each
other, and cut into segments of ``SEGMENT`` terms. In a segment the column of a source is a list
of runs (end, share); terms that it lacks are part of a run too. For each pair of sources the
run boundaries are intersected, and each difference is multiplied by the length of its piece.
Sources meet by blocks of ``SOURCES``, so that a task holds one segment of two blocks at most,
however many terms or sources a language has.

Defined results: null text, lang and source are ''; a row without kept terms counts for its
group's existence; a language without kept terms has value 0 for every pair; repeated rows and
rows without an id count each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitext.ranks import with_rank

from . import shared
from .counting import HELD, byte_table, words_of

MIN_DOCS, TOP, SCALE, SMOOTHING = 30, 50, 1_000_000_000, 5
TABLE = byte_table(bytes([*range(97, 123), *range(128, 256)]))
SEGMENT, SOURCES = 4096, 32


def counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs, written once; every group has a row with a null term."""
    def rows(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, in_docs) in held.items():
            terms = pa.array([None, *n], pa.binary()).cast(pa.string())
            sums = [pa.array([0, *x], pa.int64()) for x in (n.values(), (in_docs[t] for t in n))]
            group = [pa.array([x] * len(terms), pa.string()) for x in (lang, source)]
            yield pa.RecordBatch.from_arrays([*group, terms, *sums], names=["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns[:2]), batch.column(2), strict=True):
                n, in_docs = held.setdefault((lang, source), (Counter(), Counter()))
                size -= len(n)
                own: set[bytes] = set()
                for words in words_of((text.as_py() or "").encode(), TABLE):
                    n.update(words)
                    own.update(words)
                in_docs.update(own)
                size += len(n) + 1
                if size >= HELD:
                    yield from rows(held)
                    held, size = {}, 0
        yield from rows(held)

    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), F.col("text").cast("string").alias("text"))
    found = texts.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return shared.materialize(found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "divergence-counts")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 5) / (total + 5 * terms)), exact."""
    exact = lambda c: c.cast("decimal(20,0)")
    top = exact(count + SMOOTHING) * F.lit(SCALE).cast("decimal(11,0)")
    return F.lit(1) + F.call_function("div", top, exact(total + terms * SMOOTHING))


def kept_terms(found: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """(lang, term, place, q, terms) of kept terms, and (lang, total, terms) of every language."""
    mixed = F.bit_xor(F.xxhash64("source", "n")).alias("mixed")
    per_term = found.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs"), mixed).where(F.col("docs") >= min_docs)
    ranked = shared.materialize(with_rank(per_term, [F.col("lang"), F.col("all_n").desc(), F.col("mixed"), F.col("term")], "place"), "divergence-terms")
    langs = shared.materialize(ranked.groupBy("lang").agg(F.sum("all_n").alias("total"), F.count(F.lit(1)).alias("terms"), F.min("place").alias("first")), "divergence-langs")
    kept = ranked.join(langs, "lang").select(
        "lang", "term", (F.col("place") - F.col("first")).alias("place"), share(F.col("all_n"), F.col("total"), F.col("terms")).alias("q"), "terms"
    )
    return shared.materialize(kept, "divergence-kept"), langs


def run_lengths(places: np.ndarray, values: np.ndarray, rest: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends and values of the runs of a column that has ``values`` at ``places`` and ``rest`` elsewhere."""
    column = np.full(length, rest, np.int64)
    column[places] = values
    ends = np.append(np.flatnonzero(column[1:] != column[:-1]) + 1, length)
    return ends, column[ends - 1]


def distance(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> int:
    """Sum of the absolute differences of two run-length columns of one length."""
    ends = np.union1d(one[0], two[0])
    f = np.abs(one[1][np.searchsorted(one[0], ends)] - two[1][np.searchsorted(two[0], ends)])
    return int((f * np.diff(ends, prepend=0)).sum())


def columns(shares: DataFrame, groups: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """lang, source, segment, ends, values: one run-length column a group and segment."""
    size = F.lit(segment).cast("long")
    some = shares.select("lang", "source", F.floor(F.col("place") / size).cast("long").alias("segment"), F.struct((F.col("place") % size).cast("int").alias("at"), "p").alias("cell"))
    cells = some.groupBy("lang", "source", "segment").agg(F.collect_list("cell").alias("cells"))
    all_segments = groups.where("terms > 0").withColumn("segment", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("terms") - 1) / size).cast("long"))))
    whole = all_segments.join(cells, ["lang", "source", "segment"], "left").select(
        "lang", "source", "number", "segment", "cells.at", "cells.p", "rest", F.least(size, F.col("terms") - F.col("segment") * size).cast("int").alias("length")
    )
    schema = "lang string, source string, number long, segment long, ends array<int>, values array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, values = [], []
            for at, p, rest, length in zip(*(batch.column(c).to_pylist() for c in ("at", "p", "rest", "length")), strict=True):
                e, v = run_lengths(np.array(at or [], np.int64), np.array(p or [], np.int64), rest, length)
                ends.append(e)
                values.append(v)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("lang", "source", "number", "segment")), pa.array(ends, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.int64()))], names=["lang", "source", "number", "segment", "ends", "values"])

    return whole.mapInArrow(run, schema)


def _pair_rows(table: pa.Table) -> pa.Table:
    """source, item, value of the pairs of one segment and two blocks of sources."""
    lang, source = table.column("lang")[0].as_py(), table.column("source").to_pylist()
    one, two = table.column("one")[0].as_py(), table.column("two")[0].as_py()
    own = table.column("own").to_pylist()
    runs = [(np.array(e.values), np.array(v.values)) for e, v in zip(table.column("ends"), table.column("values"), strict=True)]
    first = [k for k, b in enumerate(own) if b == one]
    # By name inside a block: rows of a group come in any order, and a pair's segments are summed by (a, b).
    pairs = [(i, j) for i in first for j, b in enumerate(own) if b == two and (one != two or source[i] < source[j])]
    value = [distance(runs[i], runs[j]) for i, j in pairs]
    left, right = [source[i] for i, _ in pairs], [source[j] for _, j in pairs]
    return pa.table({"lang": pa.array([lang] * len(pairs), pa.string()), "a": pa.array(left, pa.string()), "b": pa.array(right, pa.string()), "value": pa.array(value, pa.int64())})


def pair_values(runs: DataFrame, groups: DataFrame, block: int = SOURCES) -> DataFrame:
    """lang, source, item, value for each two different sources of a language."""
    of = lambda c: F.floor(F.col(c) / block).cast("long")
    blocks = groups.groupBy("lang").agg(F.max(of("number")).alias("last"))
    dealt = runs.join(blocks, "lang").withColumn("own", of("number")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    dealt = dealt.select("lang", "source", "segment", "ends", "values", "own", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"))
    sums = dealt.groupBy("lang", "segment", "one", "two").applyInArrow(_pair_rows, "lang string, a string, b string, value long")
    # Languages without a kept term have no columns, their pairs are 0.
    none = groups.where("terms = 0").select("lang", "source")
    zero = none.select("lang", F.col("source").alias("a")).join(none.select("lang", F.col("source").alias("b")), "lang").where("a < b").withColumn("value", F.lit(0).cast("long"))
    total = sums.unionByName(zero).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x")
    return total.select("lang", both, "value").select("lang", "x.*", "value")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, segment: int = SEGMENT, block: int = SOURCES) -> DataFrame:
    """lang, source, part, item, value, rank."""
    found = counts(docs)
    kept, langs = kept_terms(found, min_docs)
    in_group = shared.materialize(found.where("term IS NOT NULL").join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "place", "q", "terms"), "divergence-kept-counts")
    totals = in_group.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    numbered = with_rank(found.where("term IS NULL").select("lang", "source"), [F.col("lang"), F.col("source")], "place")
    first = numbered.groupBy("lang").agg(F.min("place").alias("first"))
    groups = numbered.join(first, "lang").join(totals, ["lang", "source"], "left").join(langs.select("lang", "terms"), "lang", "left").select(
        "lang", "source", (F.col("place") - F.col("first")).alias("number"), F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms"),
    )
    groups = shared.materialize(groups.withColumn("rest", F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.col("terms")))), "divergence-groups")
    shares = in_group.join(groups.select("lang", "source", "total"), ["lang", "source"]).select(
        "lang", "source", "term", "place", "q", share(F.col("n"), F.col("total"), F.col("terms")).alias("p")
    )
    pairs = pair_values(columns(shares, groups, segment), groups, block)
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    terms = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    ranked = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return ranked(pairs, "pair").unionByName(ranked(terms, "term").where(F.col("rank") <= top))
