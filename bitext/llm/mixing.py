"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree over exact block quotas.

Sizes are words. Sources, by code point and null last, weigh 5, 2, 1, 5, ... and share all words
by weight; a target stops at ``COPIES`` times its source's size and the excess goes to the rest.

1. Documents of a source lie end to end on one axis of words, in a keyed random order. The axis
   is cut into blocks. The quota of a source is the exact number of blocks that hold its target:
   whole copies of all blocks, then as many as the rest needs, the last one cut.
2. The splitting tree deals the quotas to the output shards: at each node the blocks of its
   branches are drawn from the node's without putting back, one hypergeometric number a branch
   and source. So each shard gets its exact number of blocks and a fair mix of sources.
3. A shard draws the next blocks of each source's permuted sequence. The permutation is
   swap-or-not (Hoang, Morris and Rogaway) with a key per source and copy, computed per block, so
   that draws are disjoint and nobody shuffles a list. Inside a shard, blocks are ordered by a hash.

DataFrame functions only; every random number is a hash of a seed, so reruns agree. Texts leave
the scan only in ``mixed_texts``.

Defined results: a null text has size 0 and is not taken; a null source is a source of its own; a
null doc_id is kept; equal rows each have their own place on the axis; an empty table gives no
rows; further columns are ignored; a source without words has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitext.ranks import with_rank

from . import shared

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, COPIES, SEED = (5, 2, 1), 3, 11
#: Output shards, and branches of a node of the tree.
SHARDS, FAN = 64, 8
#: Words of a block at most; smaller sources have about ``BLOCKS`` blocks.
BLOCK, BLOCKS = 1024, 1024
#: Axis parts of a source that are summed by themselves, rounds of the permutation.
PARTS, ROUNDS = 1024, 24
#: Sources whose quotas one row of the tree holds.
CHUNK = 256
#: Equal rows that one row is unfolded to at once.
UNFOLD = 4096


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def row_key(doc_id: str = "doc_id", text: str = "text", source: str = "source") -> Column:
    """128-bit digest of id, source and text: equal for equal rows alone."""
    name, body = F.col(source).cast("string"), F.col(text).cast("string")
    known = F.concat_ws(",", F.col(doc_id).isNull().cast("string"), name.isNull().cast("string"), body.isNull().cast("string"))
    parts = F.concat_ws(":", known, F.col(doc_id).cast("string"), F.md5(F.coalesce(name, F.lit(""))), body)
    return F.unhex(F.md5(parts))


def narrow_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """row, doc_id, source, size, n, part: one row for n equal rows of ``docs``, written once."""
    size = F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(row_key(doc_id, text, source).alias("row"), F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), size.alias("size"))
    same = rows.groupBy("row", "doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n"))
    return shared.materialize(same.withColumn("part", F.pmod(F.xxhash64(_long(SEED), "row"), _long(PARTS)).cast("int")), "mix-rows")


def sources(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, copies: int = COPIES) -> DataFrame:
    """source, rank, source_size, target: water-filling, in exact numbers until the last division.

    A round finds the sources whose share is above their bound; they keep the bound, and what
    they leave is shared anew. The share per weight only grows, so rounds end.
    """
    sizes = with_rank(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), [F.col("source").asc_nulls_last()])
    weight = F.element_at(F.array(*map(_long, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    exact = lambda c: c.cast("decimal(19,0)")
    all_of = shared.materialize(sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * copies), "mix-sources")
    words, weigh = all_of.agg(F.coalesce(F.sum("source_size"), _long(0)), F.coalesce(F.sum("weight"), _long(0))).first()
    left, over = words, weigh
    while True:
        above = exact(F.col("most")) * exact(_long(over)) < exact(F.col("weight")) * exact(_long(left))
        at_most, their = all_of.where(above).agg(F.coalesce(F.sum("most"), _long(0)), F.coalesce(F.sum("weight"), _long(0))).first()
        if (words - at_most, weigh - their) == (left, over):
            break
        left, over = words - at_most, weigh - their
    share = exact(F.col("weight")) * exact(_long(left))
    target = F.when(above, F.col("most").cast("double")).otherwise(share.cast("double") / F.lit(float(max(over, 1))))
    taken = F.when(above, F.col("most")).otherwise(F.call_function("div", share * 2 + _long(over), exact(_long(max(over, 1))) * 2))
    return all_of.select("source", "rank", "source_size", target.alias("target"), F.least(taken, "most").alias("words"))


def quotas(told: DataFrame, block: int = BLOCK, blocks: int = BLOCKS) -> DataFrame:
    """Adds block, full (blocks of that length), copies (whole), rest (words of the last copy), quota."""
    size, words = F.col("source_size"), F.col("words")
    length = F.greatest(F.least(_long(block), F.floor(size / blocks)), _long(1))
    div = lambda a, b: F.call_function("div", a, b)
    out = told.withColumn("block", length).withColumn("full", div(size, F.col("block")))
    out = out.withColumn("all_blocks", F.col("full") + (size % F.col("block") > 0).cast("long"))
    out = out.withColumn("copies", F.when(size > 0, div(words, F.greatest(size, _long(1)))).otherwise(_long(0)))
    out = out.withColumn("rest", words - F.col("copies") * size).withColumn("more", div(F.col("rest") + F.col("block") - 1, F.col("block")))
    return out.withColumn("quota", F.col("copies") * F.col("all_blocks") + F.col("more"))


def _let(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def hypergeometric(good: str, bad: str, drawn: str, uniform: str) -> str:
    """SQL: how many of ``drawn`` from good and bad ones are good, by inversion of the distribution.

    The weight of a number follows from that of the one before; the range is 12 deviations and
    40 around the mean, beyond which lies less than a double's last bit.
    """
    mean = "double(h.drawn) * h.good / greatest(h.good + h.bad, 1L)"
    spread = "12 * sqrt(v.mean * h.bad / greatest(h.good + h.bad, 1L) * (h.good + h.bad - h.drawn) / greatest(h.good + h.bad - 1, 1L)) + 40"
    low, high = "greatest(0L, h.drawn - h.bad, bigint(floor(v.mean - d)))", "least(h.drawn, h.good, bigint(ceil(v.mean + d)))"
    up = "s.w * (double(h.good - k) * (h.drawn - k) / (double(k + 1) * (h.bad - h.drawn + k + 1)))"
    mass = f"aggregate(sequence(r.low, r.high), named_struct('w', 1D, 'sum', 0D), (s, k) -> named_struct('w', {up}, 'sum', s.sum + s.w)).sum"
    start = f"named_struct('w', 1D, 'left', {mass} * h.uniform, 'k', r.high)"
    pick = f"aggregate(sequence(r.low, r.high), {start}, (s, k) -> named_struct('w', {up}, 'left', s.left - s.w, 'k', if(s.left >= 0 AND s.left < s.w, k, s.k))).k"
    number = _let("r", f"named_struct('low', {low}, 'high', {high})", f"if(r.low >= r.high, r.low, {pick})")
    inner = _let("v", f"named_struct('mean', {mean})", _let("d", spread, number))
    return _let("h", f"named_struct('good', {good}, 'bad', {bad}, 'drawn', {drawn}, 'uniform', {uniform})", inner)


def draws(kinds: str, drawn: str, key: str) -> str:
    """SQL: how many of each kind of an array are among ``drawn`` ones, the kinds one after another."""
    uniform = f"shiftrightunsigned(xxhash64({SEED}L, {key}, size(t.out)), 11) * {2.0**-53!r}D"
    took = _let("took", hypergeometric("n", "t.left - n", "t.drawn", uniform), "named_struct('drawn', t.drawn - took, 'left', t.left - n, 'out', concat(t.out, array(took)))")
    start = f"named_struct('drawn', {drawn}, 'left', aggregate({kinds}, 0L, (x, y) -> x + y), 'out', cast(array() AS array<bigint>))"
    return f"aggregate({kinds}, {start}, (t, n) -> {took}).out"


def split(kinds: str, parts: str, key: str) -> str:
    """SQL: for each of the sizes ``parts``, which exhaust the kinds, how many of each kind it gets; one part after another."""
    part = _let("one", draws("p.rest", "m", f"{key}, size(p.out)"), "named_struct('rest', zip_with(p.rest, one, (x, y) -> x - y), 'out', concat(p.out, array(one)))")
    start = f"named_struct('rest', {kinds}, 'out', cast(array() AS array<array<bigint>>))"
    return f"aggregate({parts}, {start}, (p, m) -> {part}).out"


def split_tree(told: DataFrame, shards: int = SHARDS, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """rank, ends: after which place of its sequence each shard's blocks of a source end.

    A row of the tree is a node and the quotas of ``chunk`` sources; a node has ``fan`` branches,
    a range of shards each. One level first tells how many blocks of each chunk go to each
    branch, then inside each chunk how many of each source.
    """
    cell = F.array_sort(F.collect_list(F.struct("rank", "quota")))
    rows = told.groupBy(F.floor(F.col("rank") / chunk).cast("long").alias("chunk")).agg(cell.alias("cells"))
    rows = shared.materialize(rows.select("chunk", F.col("cells.rank").alias("ranks"), F.col("cells.quota").alias("own"), _long(0).alias("node")), "mix-tree")
    all_blocks = told.agg(F.coalesce(F.sum("quota"), _long(0))).first()[0]
    up_to = lambda shard: f"(least({shard}, {shards}L)::decimal(10,0) * {all_blocks}L) div {shards}L"
    width = 1
    while width < shards:
        width *= fan
    while width > 1:
        width //= fan
        parts = f"transform(sequence(0L, {fan - 1}L), b -> {up_to(f'(node + (b + 1) * {width})')} - {up_to(f'(node + b * {width})')})"
        totals = rows.select("node", "chunk", F.expr("aggregate(own, 0L, (x, y) -> x + y)").alias("n"))
        per_node = totals.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("chunk", "n"))).alias("c")).select("node", F.expr("c.chunk").alias("chunks"), F.expr("c.n").alias("n"), F.expr(parts).alias("parts"))
        to_chunks = per_node.select("node", "chunks", F.expr(split("n", "parts", f"{width}L, node, -1L")).alias("to"))
        each = to_chunks.select("node", F.posexplode("chunks").alias("i", "chunk"), "to").select("node", "chunk", F.expr("transform(to, x -> element_at(x, i + 1))").alias("parts"))
        cut = rows.join(each, ["node", "chunk"]).select("node", "chunk", "ranks", F.expr(split("own", "parts", f"{width}L, node, chunk")).alias("to"))
        branches = cut.select("node", "chunk", "ranks", F.posexplode("to").alias("b", "own")).select("chunk", "ranks", "own", (F.col("node") + F.col("b") * width).alias("node"))
        rows = shared.materialize(branches.where(F.col("node") < shards), "mix-tree")
    cells = rows.select("node", F.explode(F.arrays_zip("ranks", "own")).alias("x")).groupBy("x.ranks").agg(F.array_sort(F.collect_list(F.struct("node", "x.own"))).alias("n"))
    running = F.expr("aggregate(n, array(0L), (x, y) -> concat(x, array(element_at(x, -1) + y.own)))")
    return cells.select(F.col("ranks").alias("rank"), F.slice(running, 2, shards).alias("ends"))


def place_of(block: Column, blocks: Column, *key: Column) -> Column:
    """Place of a block in the permuted order of ``blocks`` ones."""
    def swap(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(_long(SEED), *key, r), blocks) - x, blocks)
        moves = F.xxhash64(_long(SEED), *key, r, F.greatest(x, other)) % 2 != 0
        return F.when(moves, other).otherwise(x)

    return F.aggregate(F.sequence(_long(1), _long(ROUNDS)), block, swap)


def _unfolded(rows: DataFrame) -> DataFrame:
    """Each of n equal rows by itself, with its own start; very many are dealt out in between."""
    shift = lambda df: df.withColumn("start", F.col("start") + F.col("k") * F.col("size")).drop("k", "n")
    few = rows.where(F.col("n") <= UNFOLD).withColumn("k", F.explode(F.sequence(_long(0), F.col("n") - 1)))
    some = rows.where(F.col("n") > UNFOLD).withColumn("lot", F.explode(F.sequence(_long(0), F.call_function("div", F.col("n") - 1, _long(UNFOLD))))).repartition("row", "lot")
    last = F.least(F.col("n") - 1, (F.col("lot") + 1) * UNFOLD - 1)
    return shift(few).unionByName(shift(some.withColumn("k", F.explode(F.sequence(F.col("lot") * UNFOLD, last))).drop("lot")))


def mix(docs: DataFrame, shards: int = SHARDS, weights: tuple[int, ...] = WEIGHTS, copies: int = COPIES, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """row, doc_id, source, size, source_size, target, pieces: one row per row of ``docs``.

    A piece is (shard, place, copy, first, words): its shard takes so many words of the document
    from word ``first`` on; inside a shard pieces are in the order of ``place``.
    """
    rows = narrow_rows(docs)
    told = shared.materialize(quotas(sources(rows, weights, copies), block), "mix-quotas")
    told = shared.materialize(told.join(split_tree(told, shards, chunk), "rank"), "mix-plan")
    mine = rows.join(told.withColumnRenamed("source", "named"), F.col("source").eqNullSafe(F.col("named"))).drop("named")
    # At most PARTS rows a source; a source's rows are summed up part by part.
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("source", "part").agg(F.sum(F.col("size") * F.col("n")).alias("words")).select(
        F.col("source").alias("named"), F.col("part").alias("of_part"), F.coalesce(F.sum("words").over(before), _long(0)).alias("part_start")
    )
    inside = Window.partitionBy("rank", "part").orderBy(F.xxhash64(_long(SEED + 1), "row"), "row").rowsBetween(Window.unboundedPreceding, -1)
    laid = mine.withColumn("start", F.coalesce(F.sum(F.col("size") * F.col("n")).over(inside), _long(0)))
    laid = laid.join(starts, F.col("source").eqNullSafe(F.col("named")) & (F.col("part") == F.col("of_part"))).withColumn("start", F.col("start") + F.col("part_start"))
    div = lambda a, b: F.call_function("div", a, b)
    step = F.col("block")

    def placed(c: Column, b: Column) -> Column:
        place = F.when(b >= F.col("full"), F.col("full")).otherwise(place_of(b, F.greatest(F.col("full"), _long(1)), F.col("rank"), c))
        return F.struct(c.alias("c"), b.alias("b"), place.alias("place"))

    def piece(x: Column) -> Column:
        b, c, place = x["b"], x["c"], x["place"]
        whole = (c < F.col("copies")) | (place < F.col("more") - 1)
        length = F.when(whole, step).when(place == F.col("more") - 1, F.col("rest") - place * step).otherwise(_long(0))
        first = F.greatest(F.col("start"), b * step)
        words = F.least(F.col("start") + F.col("size"), b * step + length) - first
        at = c * F.col("all_blocks") + place
        widths = [_long(1 << k) for k in reversed(range(shards.bit_length()))]
        shard = F.aggregate(F.array(*widths), _long(0), lambda low, w: F.when((low + w <= shards) & (F.try_element_at("ends", (low + w).cast("int")) <= at), low + w).otherwise(low))
        return F.struct(
            shard.cast("int").alias("shard"), F.xxhash64(_long(SEED + 2), F.col("rank"), c, b).alias("place"), c.cast("int").alias("copy"), (first - F.col("start")).alias("first"), words.alias("words")
        )

    blocks = F.sequence(div(F.col("start"), step), div(F.col("start") + F.greatest("size", _long(1)) - 1, step))
    cells = F.flatten(F.transform(F.sequence(_long(0), F.col("copies")), lambda c: F.transform(blocks, lambda b: placed(c, b))))
    taken = F.filter(cells, lambda x: (F.col("size") > 0) & ((x["c"] < F.col("copies")) | (x["place"] < F.col("more"))))
    pieces = F.filter(F.transform(taken, piece), lambda p: p["words"] > 0)
    return _unfolded(laid).select("row", "doc_id", "source", "size", "source_size", "target", pieces.alias("pieces"))


def mixed_texts(docs: DataFrame, **options) -> DataFrame:
    """shard, place, doc_id, source, text: the mixed words themselves, blanks as one space, to be sorted inside each shard."""
    one = F.explode("pieces").alias("p")
    pieces = mix(docs, **options).select("row", "doc_id", "source", one).select("row", "doc_id", "source", "p.*")
    texts = docs.select(row_key().alias("row"), "text").groupBy("row").agg(F.first("text").alias("text"))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), (F.col("first") + 1).cast("int"), F.col("words").cast("int")), " ")
    return pieces.join(texts, "row").select("shard", "place", "doc_id", "source", cut.alias("text"))


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken: the words that the mix takes of each row, repeats counted."""
    taken = F.aggregate("pieces", _long(0), lambda s, p: s + p["words"])
    return mix(docs).select("doc_id", "size", "source_size", "target", taken.alias("taken"))
