"""MinHash near-dedup with bottom-k sketches from one hash function.

1. Every document becomes the set of hashes of its word shingles; equal sets form one class,
   and everything below works on classes. The sketch of a class is its K smallest hashes.
2. Inverted lists of retained hashes. Classes that are similar enough share at least
   ``SHARED`` of K retained hashes, save with a probability of about 1e-8 for a pair exactly
   at the threshold; so by the prefix principle they share one of their K - SHARED + 1 rarest
   ones, and only these enter the lists. Passages that many documents share are frequent, so
   their hashes stay out unless a document consists mostly of them.
3. The union-sketch estimate filters the pairs of each list; equal lists count once.
   Components of what passes are candidate groups.
4. Exact Jaccard on full sets inside the groups.
5. Components of the exact links, joined back to classes and documents.

Steps 3 and 4 look for links between the members of a group, which may be a hot one, in the
same way (``_linked``): members are dealt into blocks, every pair inside a block is tested, and
about ``HUBS`` members of a group go to all of its blocks. In a group of near copies that
connects nearly all, at a cost linear in the group. What is not connected to the same hubs as
most of a group is then tested against everything else in it, block by block: a pair is left
out only where it is connected already. Nothing is capped, and tasks return spanning forests.

Defined results: null texts and texts without words have an empty set, are linked with
nothing and stay; fewer words than a shingle are one shingle; texts are read whole; repeated
rows give a row each, with the same component; a null doc_id never names a component that
has another id; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .components import connected_components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
K = 32
SHARED = 14
#: Similarity for which these two are chosen, in percent.
MIN_PERCENT = 80
#: Members of a list that is estimated in one task, together with others.
LIST = 48
#: Bounds of a block of a group: set elements and sets.
BLOCK_SHINGLES = 400_000
BLOCK_SETS = 128
#: About so many members of a group of several blocks are tested against all others.
HUBS = 8
#: Pairs of sketches that are estimated at once.
PAIRS = 1 << 14
CACHE_WORDS = 100_000


class _Words(dict):
    """64-bit hash of a word; forgets all when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    found = WORD.findall(text.encode().lower()) if text else []
    w = np.fromiter(map(_words.__getitem__, found), np.uint64, len(found))
    n = min(size, len(w))
    if not n:
        return w
    h = np.full(len(w) - n + 1, n, np.uint64)
    for j in range(n):
        h = (h ^ w[j : len(w) - n + 1 + j]) * _MIX[0]
        h ^= h >> np.uint64(29)
        h *= _MIX[1]
        h ^= h >> np.uint64(32)
    return np.unique(h * _MIX[2])


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, key, n (set size), sig (128-bit digest of the set), sketch (K smallest, ascending) of rows doc_id, text, key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sig, sketch = [], [], []
            for t in batch.column(1):
                s = shingle_set(t.as_py(), size)
                n.append(len(s))
                sig.append(xxhash.xxh128_digest(s.tobytes()) if len(s) else None)
                sketch.append((s[:K] >> np.uint64(1)).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(sketch, pa.list_(pa.int64()))],
                names=["doc_id", "key", "n", "sig", "sketch"],
            )
        _words.clear()  # workers live on, and their memory is shared by all stages

    return docs.mapInArrow(run, "doc_id long, key binary, n long, sig binary, sketch array<long>")


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of the graph with edges a[i]-b[i] over n nodes, as (root, node)."""
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return [(r, x) for x in range(n) if (r := find(x)) != x]


def _overlaps(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Intersection sizes of all pairs, by products of 0/1 matrices over the shared elements."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    first = np.concatenate([[True], values[1:] != values[:-1]])
    start = np.flatnonzero(first)
    shared_by = np.diff(np.append(start, len(values)))
    column = np.cumsum(first) - 1
    keep = shared_by[column] > 1
    rank = np.cumsum(shared_by > 1) - 1
    column, owner = rank[column[keep]], owner[keep]
    out = np.zeros((len(sets), len(sets)), np.int64)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        m = np.zeros((len(sets), width), np.float32)
        m[owner[lo:hi], column[lo:hi] - at] = 1
        out += np.rint(m @ m.T).astype(np.int64)
    return out


def _estimated(sketches: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (larger index first) that the union sketch takes for similar enough.

    Of the k smallest hashes of the union (k up to K), ``SHARED`` of K have to be in both.
    """
    n = len(sketches)
    sizes = np.array([len(x) for x in sketches])
    pad = np.iinfo(np.int64).max
    grid = np.full((n, K), pad, np.int64)
    for row, x in zip(grid, sketches, strict=True):
        row[: len(x)] = x
    # Hashes in both bound those among the k smallest: only such pairs need the estimate.
    both = _overlaps(sketches)
    k = np.minimum(K, sizes[:, None] + sizes[None, :] - both)
    a, b = np.nonzero(np.tril(both * K >= SHARED * k, -1))
    keep = np.zeros(len(a), bool)
    for at in range(0, len(a), PAIRS):
        i, j = a[at : at + PAIRS], b[at : at + PAIRS]
        union = np.sort(np.concatenate([grid[i], grid[j]], axis=1), axis=1)
        twice = (union[:, 1:] == union[:, :-1]) & (union[:, 1:] != pad)
        place = np.cumsum(~twice, axis=1)  # of each value among the distinct ones, less one
        hits = (twice & (place < k[i, j][:, None])).sum(axis=1)
        keep[at : at + PAIRS] = hits * K >= SHARED * k[i, j]
    return a[keep], b[keep]


def _sketches_of(column: pa.Array) -> list[np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, ends = column.flatten().to_numpy(), column.offsets.to_numpy()
    return [flat[a - ends[0] : b - ends[0]] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _candidate_forests(lists: DataFrame) -> DataFrame:
    """u, v: spanning forests of the pairs of each short list that pass the union-sketch estimate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = [], []
            for row in batch.column(0):
                sig = row.values.field("sig").to_pylist()
                for r, x in _forest(len(sig), *_estimated(_sketches_of(row.values.field("sketch")))):
                    u.append(sig[x])
                    v.append(sig[r])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], names=["u", "v"])

    return lists.select("members").mapInArrow(run, "u binary, v binary")


Pairs = Callable[[pa.ChunkedArray], tuple[np.ndarray, np.ndarray]]


def _similar_sketches(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    return _estimated(_sketches_of(column))


def _similar_texts(size: int, percent: int) -> Pairs:
    """The pairs of texts whose full sets are similar enough."""

    def run(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        sets = [shingle_set(t.as_py(), size) for t in column]
        n = np.array([len(s) for s in sets])
        inter = _overlaps(sets)
        return np.nonzero(np.tril(100 * inter >= percent * (n[:, None] + n[None, :] - inter), -1))

    return run


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node of the component of each of n nodes."""
    root = np.arange(n)
    for r, x in _forest(n, a, b):
        root[x] = r
    return root


def _tested(members: DataFrame, keys: list[str], similar: Pairs) -> DataFrame:
    """group, u, v, label: a spanning forest of the similar pairs of sig, load of each group.

    With side, comp: pairs of one component are left out, and pairs of one side too where the
    group has two. With hub, blocks, place, groups of several blocks also give a row with
    ``label`` per member: v names what u is connected to here, the same name in every block for
    what is connected to a hub. Names are finer than components, never coarser.
    """

    def run(table: pa.Table) -> pa.Table:
        sig, n = table["sig"].to_pylist(), len(table)
        a, b = similar(table["load"]) if n > 1 else (np.zeros(0, int), np.zeros(0, int))
        if "comp" in table.column_names and n > 1:
            comp = np.unique(np.array(table["comp"].to_pylist(), object), return_inverse=True)[1]
            side = table["side"].to_numpy()
            other = (comp[a] != comp[b]) & ((side[a] != side[b]) | (side.min() == side.max()))
            a, b = a[other], b[other]
        rows = [(sig[x], sig[r], False) for r, x in _forest(n, a, b)]
        if "hub" in table.column_names and table["blocks"][0].as_py() > 1:
            hub, root = table["hub"].to_numpy(), _roots(n, a, b)
            own = _roots(n, a[hub[a] & hub[b]], b[hub[a] & hub[b]])  # as in every block
            name: dict[int, bytes] = {}
            for x in np.flatnonzero(hub).tolist():
                name[own[x]] = min(sig[x], name.get(own[x], sig[x]))
            near: dict[int, bytes] = {}
            for x in np.flatnonzero(hub).tolist():
                near[root[x]] = min(name[own[x]], near.get(root[x], name[own[x]]))
            first = table["place"][0].as_py() == 0
            rows += [(sig[x], name[own[x]] if hub[x] else near.get(root[x], sig[root[x]]), True) for x in range(n) if first or not hub[x]]
        u, v, label = zip(*rows, strict=True) if rows else ((), (), ())
        group = table["group"].combine_chunks().slice(0, 1).take(pa.array([0] * len(rows), pa.int64())) if rows else pa.array([], table.schema.field("group").type)
        return pa.table({"group": group, "u": pa.array(u, pa.binary()), "v": pa.array(v, pa.binary()), "label": pa.array(label, pa.bool_())})

    kind = members.schema["group"].dataType.simpleString()
    return members.groupBy(*keys).applyInArrow(run, f"group {kind}, u binary, v binary, label boolean")


def _linked(members: DataFrame, load: Callable[[DataFrame], DataFrame], similar: Pairs) -> DataFrame:
    """u, v: links that connect all similar pairs inside each group of ``members`` (group, sig, n).

    ``load`` joins the column ``load``, which ``similar`` compares, to rows with ``sig``.
    """

    def blocks(n: Column, weight: Column) -> Column:
        return F.greatest(F.ceil(weight / BLOCK_SHINGLES), F.ceil(n / BLOCK_SETS)).cast("int")

    # Written first, so that the joins have a plain side and a hot group can be split.
    groups = shared.materialize(
        members.groupBy("group").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight")).where("size > 1").select("group", "size", blocks(F.col("size"), F.col("weight")).alias("blocks")),
        "groups",
    )
    block = F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int")
    hub = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("sig", F.lit(1)), F.col("size")) < HUBS)
    dealt = members.join(groups, "group").withColumn("hub", hub)
    dealt = dealt.select("group", "sig", "n", "blocks", "hub", F.when(F.col("hub"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(block)).alias("places"))
    near = load(dealt).select("group", "sig", "load", "blocks", "hub", F.explode("places").alias("place"))
    tested = shared.materialize(_tested(near, ["group", "place"], similar), "links")
    links = tested.where("NOT label").select("u", "v")
    own = tested.where("label").select("group", F.col("u").alias("sig"), F.col("v").alias("comp"))

    # Per large group, all that its largest component leaves out.
    own = own.join(members, ["group", "sig"])
    comps = own.groupBy("group", "comp").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight"))
    sums = comps.groupBy("group").agg(F.max(F.struct("size", "weight", "comp")).alias("main"), F.sum("size").alias("size"), F.sum("weight").alias("weight"))
    sums = sums.where("size > main.size").select(
        "group", F.col("main.comp").alias("main"), blocks(F.col("main.size"), F.col("main.weight")).alias("main_blocks"),
        blocks(F.col("size") - F.col("main.size"), F.col("weight") - F.col("main.weight")).alias("rest_blocks"),
    )
    sums = shared.materialize(sums, "rests")
    if sums.isEmpty():
        return links
    rest = F.col("comp") != F.col("main")
    block = F.pmod(F.xxhash64("sig"), F.when(rest, F.col("rest_blocks")).otherwise(F.col("main_blocks"))).cast("int")

    def cells(count: str, cell: Callable[[Column], Column]) -> Column:
        return F.transform(F.sequence(F.lit(0), F.col(count) - 1), cell)

    def cell(a: Column, b: Column, with_main: bool, side: Column) -> Column:
        return F.struct(a.alias("a"), b.alias("b"), F.lit(with_main).alias("with_main"), side.cast("int").alias("side"))

    among = cells("rest_blocks", lambda o: cell(F.least(o, F.col("block")), F.greatest(o, F.col("block")), False, F.col("block") > o))
    across = cells("main_blocks", lambda o: cell(F.col("block"), o, True, F.lit(0)))
    back = cells("rest_blocks", lambda o: cell(o, F.col("block"), True, F.lit(1)))
    dealt = own.join(sums, "group").withColumns({"rest": rest, "block": block})
    dealt = dealt.select("group", "sig", "comp", F.when(F.col("rest"), F.concat(among, across)).otherwise(back).alias("cells"))
    far = load(dealt).select("group", "sig", "comp", "load", F.inline("cells"))
    return links.unionByName(shared.materialize(_tested(far, ["group", "a", "b", "with_main"], similar), "links").select("u", "v"))


def near_groups(docs: DataFrame, shingle: int = 3, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row.

    ``percent``: links have 100 * intersection >= percent * union. The sketch constants are
    chosen for ``MIN_PERCENT`` (80) and more; less is an error.
    """
    if not MIN_PERCENT <= percent <= 100:
        raise ValueError(f"percent must be from {MIN_PERCENT} to 100: below, sketches lose links")
    out = _grouped(docs, shingle, percent, doc_id, text)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _grouped(docs: DataFrame, shingle: int, percent: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, key, n, component_id, keep (key of the row that stands for the component; null without words)."""
    rows = shared.as_text_rows(docs, doc_id, text)
    rows = rows.withColumn("key", shared.row_key("doc_id", "text"))
    sk = shared.materialize(sketches(rows, shingle), "sketches")
    classes = shared.materialize(
        sk.where("n > 0").groupBy("sig").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "classes"
    )
    links = _links(rows, sk, classes, shingle, percent)
    roots = connected_components(links).withColumnRenamed("node", "sig")
    rooted = classes.select("sig", "rep").join(roots, "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    names = shared.materialize(rooted.groupBy("root").agg(F.min("rep").alias("rep")).select("root", F.col("rep.doc_id").alias("component_id"), F.col("rep.key").alias("keep")), "names")
    named = rooted.drop("rep").join(names, "root").select("sig", "component_id", "keep")
    return sk.select("doc_id", "key", "n", "sig").join(named, "sig", "left").withColumn("component_id", F.coalesce("component_id", "doc_id")).drop("sig")


def _links(rows: DataFrame, sk: DataFrame, classes: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Edges u, v between class digests: exact links that connect what is connected."""
    values = classes.select("sig", F.size("sketch").alias("k"), F.explode("sketch").alias("value"))
    # Counts are written before they are joined: a plain side lets the join split a hot hash.
    counts = shared.materialize(values.groupBy("value").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1"), "counts")
    own = Window.partitionBy("sig")
    # A class's rarest hashes come first, and those that no other class retains before all.
    ranked = values.join(counts, "value").withColumn("alone", F.col("k") - F.count(F.lit(1)).over(own))
    ranked = ranked.withColumn("place", F.col("alone") + F.row_number().over(own.orderBy("classes", "value")))
    prefix = shared.materialize(
        ranked.where(F.col("place") <= F.col("k") - F.greatest(F.lit(1), F.floor(F.col("k") * SHARED / K)) + 1).select("value", "sig"), "prefix"
    )
    sizes = shared.materialize(prefix.groupBy("value").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1"), "list-sizes")
    short = prefix.join(sizes.where(F.col("classes") <= LIST).select("value"), "value")
    # Many lists have the same members: one of each is enough.
    lists = short.groupBy("value").agg(F.array_sort(F.collect_list("sig")).alias("sigs")).select("sigs").distinct()
    members = lists.select(F.xxhash64("sigs").alias("list"), F.explode("sigs").alias("sig")).join(classes.select("sig", "sketch"), "sig")
    lists = members.groupBy("list").agg(F.collect_list(F.struct("sig", "sketch")).alias("members"))
    links = _candidate_forests(lists)
    long = sizes.where(F.col("classes") > LIST).select("value")
    if not long.isEmpty():
        # Sketches are short: a list's blocks are bounded by their members.
        own = shared.materialize(prefix.join(long, "value").select(F.col("value").alias("group"), "sig", F.lit(K).cast("long").alias("n")), "long-lists")
        links = links.unionByName(_linked(own, lambda df: df.join(classes.select("sig", F.col("sketch").alias("load")), "sig"), _similar_sketches))
    candidates = connected_components(links)
    groups = candidates.select(F.col("root").alias("group"), F.col("node").alias("sig")).join(classes.select("sig", F.col("rep.key").alias("key"), "n"), "sig")
    groups = shared.materialize(groups, "candidates")
    # Texts of candidates, written once. Both sides grow with the corpus: no broadcast at any size.
    # Repeated rows become one before they travel, so a class has one text, and a group as many as classes.
    texts = rows.select("key", F.col("text").alias("load")).dropDuplicates(["key"])
    texts = shared.materialize(texts.hint("merge").join(groups.select("sig", "key"), "key").select("sig", "load"), "candidate-texts")
    return _linked(groups.select("group", "sig", "n"), lambda df: texts.hint("merge").join(df, "sig"), _similar_texts(shingle, percent))


def near_dedup(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, all columns, and all rows without words; repeated rows are one."""
    if not MIN_PERCENT <= percent <= 100:
        raise ValueError(f"percent must be from {MIN_PERCENT} to 100: below, sketches lose links")
    groups = shared.materialize(_grouped(docs, shingle, percent).where("n > 0").select("key", "keep"), "near-keys")
    return shared.keep_rows(docs, groups.select("key", (F.col("key") == F.col("keep")).alias("kept")), shared.row_key("doc_id", "text"))
