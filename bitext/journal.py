"""A journal of model replies: what was answered once is not asked again.

A task writes each call's replies to ``<path>/run=<id>/partition=<n>`` before it goes on, under a
hidden name that is then renamed. A repeated task of the same run reads its own partition's
files; a later run joins all replies to its requests by their digest, whatever ended the earlier
one. ``compact`` turns the many small files of ended runs into a few.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitext.storage import listing, open_fs

Call = Callable[[list[str]], list[str | None]]
ENTRY = "digest string, reply string"


def digest(text: Column, key: str) -> Column:
    """Of a request: ``key`` names what is asked, such as a model and a language pair."""
    return F.sha2(F.concat(F.lit(key + "\x1f"), F.coalesce(text, F.lit(""))), 256)


def answers(spark: SparkSession, path: str) -> DataFrame:
    """digest, reply: one row a request, of all runs."""
    if not any(f.base_name.endswith(".parquet") for f in listing(path, recursive=True)):
        return spark.createDataFrame([], ENTRY)
    found = spark.read.schema(ENTRY).option("recursiveFileLookup", "true").parquet(path)
    return found.groupBy("digest").agg(F.min("reply").alias("reply"))


def compact(spark: SparkSession, path: str) -> None:
    """Rewrite the replies of all ended runs as one run. No run may be under way."""
    old = [f.path for f in listing(path)]
    answers(spark, path).write.parquet(f"{path}/run={uuid.uuid4().hex}")
    fs, _ = open_fs(path)
    for folder in old:
        fs.delete_dir(folder)


def _read(folder: str) -> dict[str, str]:
    fs, _ = open_fs(folder)
    out: dict[str, str] = {}
    for f in listing(folder):
        if f.base_name.endswith(".parquet"):
            with fs.open_input_file(f.path) as source:
                out.update(zip(*(c.to_pylist() for c in pq.read_table(source).columns), strict=True))
    return out


def _append(folder: str, rows: dict[str, str]) -> None:
    fs, path = open_fs(folder)
    fs.create_dir(path, recursive=True)
    name = uuid.uuid4().hex
    with fs.open_output_stream(f"{path}/.{name}") as out:
        pq.write_table(pa.table({"digest": pa.array(list(rows), pa.string()), "reply": pa.array(list(rows.values()), pa.string())}), out)
    fs.move(f"{path}/.{name}", f"{path}/{name}.parquet")


def _free(rows: DataFrame, name: str) -> str:
    while name in rows.columns:
        name = "_" + name
    return name


def ask(rows: DataFrame, text: str, out: str, call: Call, size: int, path: str, key: str, run: str | None = None) -> DataFrame:
    """``rows`` plus ``out``: the journal's reply, or that of ``call`` on up to ``size`` texts, which is written at once.

    Equal requests of a task are asked once; a null reply is not kept. ``run`` names the run
    that is continued, by default a new one.
    """
    spark, schema = rows.sparkSession, T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())])
    mine, known = (_free(rows, name) for name in ("request_digest", "request_reply"))
    stored = answers(spark, path).select(F.col("digest").alias(mine), F.col("reply").alias(known))
    asked = rows.withColumn(mine, digest(F.col(text), key)).join(stored, mine, "left").select(*(F.col(f"`{c}`") for c in rows.columns), mine, known)
    folder = f"{path}/run={run or uuid.uuid4().hex}"

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = f"{folder}/partition={TaskContext.get().partitionId()}"
        told = _read(own)
        for given in batches:
            *columns, digests, replies = given.columns
            texts = given.column(given.schema.get_field_index(text)).to_pylist()
            digests, replies = digests.to_pylist(), replies.to_pylist()
            todo = {d: t for d, t, r in zip(digests, texts, replies, strict=True) if r is None and d not in told}
            open_ones, fresh = list(todo), {}
            for at in range(0, len(open_ones), size):
                part = open_ones[at : at + size]
                new = dict(zip(part, call([todo[d] or "" for d in part]), strict=True))
                fresh.update(new)
                if kept := {d: r for d, r in new.items() if r is not None}:
                    _append(own, kept)
                    told.update(kept)
            final = [told.get(d, fresh.get(d)) if r is None else r for d, r in zip(digests, replies, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(final, pa.string())], names=schema.names)

    return asked.mapInArrow(step, schema)
