"""Sharding by jump consistent hashing (Lamping and Veach): no ring table, minimal moves.

Law ``key``: the doc_id and the number of shards alone decide; one more shard takes rows only
into itself. Defined results: a null doc_id is key 0; a null text has size 1 and checksum 0;
repeated rows get the same shard and different slots; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

SHARDS = 8
#: Slots are numbered in this many parts of each shard, so no task sorts a whole shard.
PARTS = 1024


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of every 64-bit key; about ln(shards) vector steps."""
    key = keys.astype(np.uint64, copy=True)
    at = np.full(len(key), -1, np.int64)
    jump = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        at[live] = jump[live]
        k = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        key[live] = k
        jump[live] = ((at[live] + 1) * (2.0**31 / ((k >> np.uint64(33)).astype(np.float64) + 1))).astype(np.int64)
        live = live[jump[live] < shards]
    return at


def shard_of(key: Column, shards: int) -> Column:
    @F.pandas_udf("int")
    def jump(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(np.int64), shards), dtype="int32")

    return jump(F.coalesce(key.cast("long"), F.lit(0).cast("long")))


def assign_shards(docs: DataFrame, shards: int = SHARDS, parts: int = PARTS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; texts never leave the scan.

    A slot is the number of rows before it in its shard, in the order of (part, doc_id), where
    the part is a hash: rows are ranked inside (shard, part) and the ``shards * parts`` counts
    are summed up once. Rows that are wholly equal travel as one with their number.
    """
    rows = shared.as_text_rows(docs, doc_id, text).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
    )
    rows = rows.select(
        "*",
        shard_of(F.col("doc_id"), shards).alias("shard"),
        shard_of(F.col("doc_id"), shards + 1).alias("grown_shard"),
        F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(parts)).cast("int").alias("part"),
    )
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n")).select(
        "shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")
    )
    same = rows.groupBy("doc_id", "size", "text_crc32", "shard", "grown_shard", "part").agg(F.count(F.lit(1)).alias("n"))
    inside = Window.partitionBy("shard", "part").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, 0)
    ranked = same.withColumn("upto", F.sum("n").over(inside)).withColumn("rank", F.explode(F.sequence(F.col("upto") - F.col("n"), F.col("upto") - 1)))
    # shards * parts rows at most, a fixed bound
    return ranked.join(F.broadcast(starts), ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("start") + F.col("rank")).cast("long").alias("slot"), "grown_shard",
    )
