"""Shared-storage and Arrow helpers of the training-data operators.

Everything an operator writes between jobs goes below ``spark.checkpoint.dir``: driver and
executors share that folder and nothing else, so a lost executor loses no intermediate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from bitext.storage import materialize, new_path, shared_dir, table

__all__ = ["append_columns", "as_text_rows", "free_name", "keep_rows", "materialize", "new_path", "open_fs", "row_key", "shared_dir", "table"]


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or plain path, on the driver or in a task."""
    if "://" in uri:
        return pafs.FileSystem.from_uri(uri)
    if uri.startswith("file:"):
        uri = uri[len("file:"):]
    return pafs.LocalFileSystem(), uri


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it (any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def append_columns(
    df: DataFrame,
    text: str,
    make: Callable[[], Callable[[Iterable[str | None]], Iterable[tuple]]],
    schema: T.StructType,
) -> DataFrame:
    """All columns of ``df`` plus ``schema``, computed per text inside Arrow batches.

    ``make`` runs once per task and returns the function from texts to a tuple of values each.
    Names in ``schema`` must be free in ``df`` (see ``free_name``).
    """
    out = T.StructType(df.schema.fields + schema.fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            texts = (x.as_py() for x in batch.column(batch.schema.get_field_index(text)))
            columns = list(zip(*fn(texts), strict=True)) or [()] * len(arrow)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True))],
                names=[*batch.schema.names, *arrow.names],
            )

    return df.mapInArrow(run, out)


def row_key(doc_id: Column | str, text: Column | str) -> Column:
    """128-bit digest of a row's id and text: equal for repeated rows alone."""
    doc_id, text = (F.col(c) if isinstance(c, str) else c for c in (doc_id, text))
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("long").cast("string"), F.lit("")), F.lit(":"), F.coalesce(text.cast("string"), F.lit("")))))


#: Keys of rows to drop up to which they are broadcast, about 60 bytes each.
BROADCAST_KEYS = 500_000


def keep_rows(docs: DataFrame, decided: DataFrame, key: Column, text: str = "text") -> DataFrame:
    """The rows of ``docs`` without those whose ``key`` is decided (key, kept) not to be kept.

    Rows of one kept key become one, the longest text first. Only keys to drop, and repeated
    ones, are joined; up to ``BROADCAST_KEYS``, counted first, no text goes through a shuffle.
    Rows whose key is not decided stay.
    """
    mine, other = free_name(docs, "row_key"), free_name(docs, "other_key")
    per_key = materialize(decided.groupBy("key").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")).where("NOT kept OR n > 1").withColumnRenamed("key", other), "decided")
    few = per_key.count() <= BROADCAST_KEYS
    rows, match = docs.withColumn(mine, key), F.col(mine) == F.col(other)

    def join(keys: DataFrame, how: str) -> DataFrame:
        return rows.join(F.broadcast(keys) if few else keys, match, how)

    once = join(per_key.select(other), "left_anti").drop(mine)
    twice = per_key.where("kept").select(other)
    if twice.isEmpty():
        return once
    # Partial aggregates merge repeated rows before they travel.
    longest = F.max_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), F.struct(F.length(text), F.xxhash64(text)))
    return once.unionByName(join(twice, "left_semi").groupBy(mine).agg(longest.alias(other)).select(f"{other}.*"))


def as_text_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the id and the text, under the names ``doc_id`` and ``text``; ids are longs, or strings of digits, other strings an error."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
