"""Exact dedup: 128-bit content hash, stable keeper, byte comparison inside groups.

DataFrame functions only. Defined results: a null text counts as empty; all empty texts are
one group; a null doc_id takes part and sorts after every other id, so it stays only where
its group has no other id; repeated rows each give a row; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

BLANKS = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """The text without the six ASCII blanks; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for c in BLANKS:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_groups(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    hash128: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Grouping by (hash, normalised text) compares the bytes of every group member, and its
    map-side half merges copies before the shuffle, so that a group that holds a third of all
    rows sends one row per task. Its result is one narrow row per distinct text. Rows then
    find their group by the hash alone, without their text; only hashes that stand for several
    texts (true collisions, counted first) are joined by text as well.
    """
    rows = shared.as_text_rows(docs, doc_id, text).select(
        "doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n"), normalised(F.col("text")).alias("norm")
    ).withColumn("h", hash128(F.col("norm")))
    best = F.min(F.struct((-F.col("n")).alias("order"), F.col("doc_id").isNull().alias("no_id"), "doc_id"))
    groups = (
        rows.groupBy("h", "norm")
        .agg(F.count(F.lit(1)).alias("group_size"), best.alias("best"))
        .select("h", F.sha2("norm", 256).alias("text_sha256"), "group_size", F.col("best.doc_id").alias("keep_id"))
    )
    per_hash = shared.materialize(
        groups.groupBy("h").agg(F.count(F.lit(1)).alias("texts"), F.min(F.struct("text_sha256", "group_size", "keep_id")).alias("g")), "exact-groups"
    )
    # A hash that stands for several texts: its rows go by text.
    mixed = per_hash.where("texts > 1").select("h")
    slim = rows.select("doc_id", "h")
    found = slim.join(per_hash.where("texts = 1").select("h", "g.*"), "h")
    if mixed.limit(1).count():
        by_text = rows.join(mixed, "h", "left_semi").select("doc_id", "h", "norm", F.sha2("norm", 256).alias("text_sha256"))
        found = found.unionByName(by_text.join(groups, ["h", "text_sha256"]).drop("norm"))
    return found.select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256",
    )


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns; of rows with one id and equal texts the longest stays."""
    def key(row_id: Column, sha: Column) -> Column:
        return F.unhex(F.md5(F.concat(F.coalesce(row_id.cast("string"), F.lit("")), F.lit(":"), sha)))

    groups = exact_groups(docs, doc_id, text).select(key(F.col("doc_id"), F.col("text_sha256")).alias("key"), "kept")
    return shared.keep_rows(docs, groups, key(F.col(doc_id).cast("long"), F.sha2(normalised(F.col(text)), 256)), text)
