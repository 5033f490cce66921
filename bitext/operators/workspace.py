"""Workspace operators: context, memory, overlays, batches, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitext.functions.compat import BLANKS, strip, text_or_empty
from bitext.ranks import Ordered
from bitext.storage import materialize

ALLOWED = ("docx", "pptx", "epub", "md", "pdf")
MIB = 1 << 20


def intake(files: DataFrame, max_files: int = 10, max_bytes: int = 200 * MIB, max_total: int = 500 * MIB) -> DataFrame:
    """``files`` (batch_id, pos, path, length) plus ``reason``: accepted, or why not.

    Order of the tests: the first ``max_files`` by position, the extension, the size, and then
    the batch as a whole. No batch is sorted: a group limit leaves its first files before the
    shuffle; these few are written and tell where a batch's room ends and what its files sum up
    to, and one join brings that to all files. A null batch is a batch.
    """
    place = F.struct("pos", "path", "length")
    order = Window.partitionBy("batch_id").orderBy("pos", "path", "length")
    name = F.lower(F.regexp_extract("path", r"\.([^./]*)\z", 1))
    own_reason = F.when(~name.isin(*ALLOWED), "bad_type").when(F.col("length") > max_bytes, "too_large")
    first = files.select("batch_id", "pos", "path", "length", F.row_number().over(order).alias("n")).where(F.col("n") <= max_files).drop("n")
    places = materialize(first.groupBy("batch_id").agg(F.collect_list(place).alias("first"), F.sum(F.when(own_reason.isNull(), F.col("length"))).alias("total")), "intake")
    told = places.select(F.col("batch_id").alias("b"), F.array_max("first").alias("last"), "total", "first")
    told = told.select("b", "last", "total", F.size(F.filter("first", lambda x: x == F.col("last"))).alias("ties"))
    rows = files.join(told, F.col("batch_id").eqNullSafe(F.col("b")))
    # Rows that are alike in all of this: as many stay as had room.
    same = rows.where(place == F.col("last")).withColumn("late", F.row_number().over(order) > F.col("ties"))
    rows = rows.where(place != F.col("last")).withColumn("late", place > F.col("last")).unionByName(same)
    over = F.when(F.col("total") > max_total, "batch_too_large")
    reason = F.coalesce(F.when(F.col("late"), "too_many"), own_reason, over, F.lit("accepted"))
    return rows.withColumn("reason", reason).drop("b", "last", "total", "ties", "late")


def memory_lookup(blocks: DataFrame, memory: DataFrame) -> DataFrame:
    """``blocks`` plus ``translated``: the last translation of the same trimmed text, else the text.

    Memory rows have seq, original, translated. Texts meet by the SHA-256 of what trimming leaves,
    worked out once a row: a join by a trimmed text would trim it again at each comparison of its
    sort. What the memory knows is written, so that both sides of the join come straight from a
    shuffle; only then does Spark deal the blocks of a very common text to several tasks.
    """

    def key(c: Column) -> Column:
        return F.unhex(F.sha2(strip(c), 256))

    last = memory.select(key(F.col("original")).alias("memory_key"), "seq", F.col("translated").alias("known")).groupBy("memory_key").agg(F.max_by("known", "seq").alias("known"))
    known = materialize(last.where("known <> ''"), "memory")
    # Blank is what has nothing left from its start on, whatever its end.
    blank = F.ltrim(text_or_empty(F.col("text")), F.lit(BLANKS)) == ""
    filled = blocks.where(~blank).withColumn("memory_key", key(F.col("text"))).join(known, "memory_key", "left").drop("memory_key")
    # Blank texts are one key and may be many: their single memory row, if any, goes to them.
    empty = known.where(F.col("memory_key") == key(F.lit(""))).drop("memory_key")
    rows = filled.unionByName(blocks.where(blank).join(F.broadcast(empty), F.lit(True), "left"))
    return rows.withColumn("translated", F.coalesce("known", "text")).drop("known")


def positional_overlay(blocks: DataFrame, edits: DataFrame) -> DataFrame:
    """``blocks`` plus ``translated`` by position; a blank edit gives the source."""
    rows = blocks.join(edits.select("doc_id", "seq", F.col("translated").alias("edit")), ["doc_id", "seq"], "left")
    blank = strip(text_or_empty(F.col("edit"))) == ""
    return rows.withColumn("translated", F.when(blank, F.col("text")).otherwise(F.col("edit"))).drop("edit")


def pending_after(blocks: DataFrame, done: DataFrame) -> DataFrame:
    return blocks.join(done.select("doc_id", "block_id"), ["doc_id", "block_id"], "left_anti")


def pending_blocks(rows: DataFrame) -> DataFrame:
    """Blocks (status, translated) that a bulk run takes: without translation, and not under way."""
    status, text = F.coalesce("status", F.lit("pending")), F.coalesce("translated", F.lit(""))
    return rows.where(((status == "pending") | (text == "")) & ~status.isin("translating", "done", "edited"))


def incomplete_tasks(tasks: DataFrame) -> DataFrame:
    return tasks.where(~F.col("phase").isin("completed", "failed"))


def drop_noop(bitext: DataFrame) -> DataFrame:
    return bitext.where(F.col("original") != F.col("translated"))


def attach_constraints(blocks: DataFrame, plan: DataFrame) -> DataFrame:
    """The plan's constraint, else the block's own, else ExpandAllowed."""
    planned = plan.select("doc_id", "block_id", F.col("constraint").alias("planned"))
    rows = blocks.join(planned, ["doc_id", "block_id"], "left")
    return rows.withColumn("constraint", F.coalesce("planned", "constraint", F.lit("ExpandAllowed"))).drop("planned")


def merge_plan_glossary(extracted: DataFrame, existing: DataFrame) -> DataFrame:
    """source, target, confirmed by lower-case source: existing terms override extracted ones.

    Both have ord, source, target; of equal keys on a side the last wins.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        rows = df.where("coalesce(source, '') <> '' AND coalesce(target, '') <> ''").select(F.lower("source").alias("key"), "ord", F.struct("source", "target").alias("t"))
        return rows.groupBy("key").agg(F.max_by("t", "ord").alias(name))

    both = side(extracted, "e").join(side(existing, "x"), "key", "full_outer")
    chosen = F.coalesce("x", "e")
    return both.select(chosen["source"].alias("source"), chosen["target"].alias("target"), F.col("x").isNotNull().alias("confirmed"))


def retry_set(bitext: DataFrame, issues: DataFrame, max_retries: int = 2) -> DataFrame:
    """Blocks with a high issue that may be tried again."""
    high = issues.where("severity = 'high'").select("doc_id", "block_id")
    return bitext.where(F.coalesce("retry_count", F.lit(0)) < max_retries).join(high, ["doc_id", "block_id"], "left_semi")


def overlay_retry(bitext: DataFrame, retried: DataFrame) -> DataFrame:
    """Retried rows replace theirs and count one more try."""
    new = retried.select("doc_id", "block_id", F.col("translated").alias("again"))
    rows = bitext.join(new, ["doc_id", "block_id"], "left")
    tries = F.coalesce("retry_count", F.lit(0)) + F.when(F.col("again").isNotNull(), 1).otherwise(0)
    return rows.withColumns({"translated": F.coalesce("again", "translated"), "retry_count": tries}).drop("again")


def merge_issues(issues: DataFrame, retried: DataFrame, recheck: DataFrame) -> DataFrame:
    """Old issues of blocks that were not retried, and the new ones."""
    return issues.join(retried.select("doc_id", "block_id"), ["doc_id", "block_id"], "left_anti").unionByName(recheck)


def extend_glossary(user: DataFrame, extracted: DataFrame) -> DataFrame:
    """Bag union, the user's terms first: source, target, part, ord."""
    own, mined = (df.select("source", "target", F.lit(k).alias("part"), "ord") for k, df in enumerate((user, extracted)))
    return own.unionByName(mined)


def context_window(bitext: DataFrame, k: int = 3, chars: int = 150) -> DataFrame:
    """``bitext`` plus the previous up to ``k`` blocks (original, translated), each cut."""
    before = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(-k, -1)
    return bitext.withColumn("context", F.collect_list(F.struct(F.left("original", F.lit(chars)).alias("original"), F.left("translated", F.lit(chars)).alias("translated"))).over(before))


def chunk(df: DataFrame, size: int, order: str = "seq", key: str = "doc_id", long: bool = False) -> DataFrame:
    """``df`` plus ``batch``: fixed-size batches per document in order. ``long``: for documents larger than a task."""
    if long:
        return Ordered(df, [key], [order]).number("batch").with_column("batch", F.floor(F.col("batch") / size)).result()
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("batch", F.floor((n - 1) / size))


def allocate(counts: DataFrame, batch: int = 20, max_executors: int = 6) -> DataFrame:
    """Ranges [start_index, end_index) of each document's ``n`` items over its workers; none for n <= 0."""
    n = F.col("n")
    workers = F.least(F.lit(max_executors), F.greatest(F.lit(1), F.ceil(n / batch)))
    span = F.ceil(n / workers)
    rows = counts.where((n > 0) & ~F.isnan(n.cast("double"))).select("*", workers.alias("workers"), span.alias("span"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("workers") - 1)).alias("worker_index"))
    start = F.col("worker_index") * F.col("span")
    return rows.select("doc_id", "worker_index", start.alias("start_index"), F.least(start + F.col("span"), n.cast("long")).alias("end_index")).where("start_index < end_index").withColumn(
        "item_count", F.col("end_index") - F.col("start_index")
    )


def deep_check_sample(bitext: DataFrame, issues: DataFrame, max_blocks: int = 50, sample: int = 30, chars: int = 200) -> DataFrame:
    """First blocks, cut, of documents that are short or have a high issue."""
    high = issues.where("severity = 'high'").select("doc_id").distinct().withColumn("high", F.lit(True))
    order = Window.partitionBy("doc_id").orderBy("seq")
    rows = bitext.select("doc_id", "seq", "block_id", F.left("original", F.lit(chars)).alias("original"), F.left("translated", F.lit(chars)).alias("translated"))
    rows = rows.withColumns({"place": F.row_number().over(order), "blocks": F.count(F.lit(1)).over(Window.partitionBy("doc_id"))})
    # Only the first rows are needed, whatever the document's length.
    rows = rows.where(F.col("place") <= sample).join(high, "doc_id", "left")
    return rows.where(F.col("high").isNotNull() | (F.col("blocks") <= max_blocks)).drop("place", "blocks", "high")


def completion(statuses: DataFrame) -> DataFrame:
    """total, done and percent per document."""
    done = F.count_if(F.col("status").isin("done", "edited"))
    return _percent(statuses.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"), done.alias("done")), "done", "total")


def task_progress(tasks: DataFrame) -> DataFrame:
    """total, completed and percent per document from (doc_id, total_blocks, completed_blocks)."""
    rows = tasks.groupBy("doc_id").agg(F.max("total_blocks").alias("total"), F.max("completed_blocks").alias("completed"))
    return _percent(rows, "completed", "total")


def _percent(rows: DataFrame, done: str, total: str) -> DataFrame:
    return rows.withColumn("percent", F.round(100.0 * F.col(done) / F.greatest(F.col(total), F.lit(1))).cast("long"))


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()


def mark_edited(rows: DataFrame, new: Column, changed: Column, text: str = "translated") -> DataFrame:
    """Replace a text and set the status of changed rows."""
    return rows.withColumns({text: new, "status": F.when(changed, "edited").otherwise(F.col("status"))})
