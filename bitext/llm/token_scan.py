"""Token counts by a separator scan of flat token files.

The files hold little-endian ids of 16 bits, or 32 where the vocabulary has larger ones, each
document followed by the end-of-document id, which no token has, and no index. Blocks of fixed size are read by range and searched with numpy; a block reports
its separators only. A prefix scan over a file's blocks gives each block the number of
separators before it and the last separator's place, which stitches documents that cross
block boundaries, however many blocks they span.

Defined results: null or empty texts are documents of 0 tokens; repeated rows are documents
each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe, shared

#: Tokens of a block.
BLOCK = 1 << 21
#: Parts of the documents that are on disk as token files one after another.
WAVES = 2


@dataclass(frozen=True)
class Layout:
    """The end-of-document id and the numpy type of the ids of a file."""

    eod: int
    type: str

    @property
    def bytes(self) -> int:
        return np.dtype(self.type).itemsize


def layout(vocabulary: str | None = None, eod: int | None = None) -> Layout:
    """``eod`` is the first id above the vocabulary where none is given."""
    ids = bpe.codec(vocabulary).ranks.values()
    top = max(ids)
    eod = top + 1 if eod is None else eod
    if eod in ids or not 0 <= eod < 1 << 32:
        raise ValueError(f"{eod} cannot end documents: it is a token or has more than 32 bits")
    return Layout(eod, "<u2" if max(top, eod) < 1 << 16 else "<u4")


def write_tokens(docs: DataFrame, path: str, form: Layout, vocabulary: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and write the documents, one flat file per task below ``path``.

    Returns where each document went: doc_id, file, ordinal. A retried task writes a file of
    another name; only files named in the result count.
    """
    rows = shared.as_text_rows(docs, doc_id, text)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = bpe.codec(vocabulary).encode_all
        fs, base = shared.open_fs(path)
        fs.create_dir(base, recursive=True)
        name = f"tokens-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.bin"
        done = 0
        with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
            for batch in batches:
                for packed in encode(t.as_py() for t in batch.column(1)):
                    ids = np.frombuffer(packed, "<u4")
                    out.write(np.append(ids, np.uint32(form.eod)).astype(form.type).tobytes())
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([name] * n, pa.string()), pa.array(np.arange(done, done + n))], names=["doc_id", "file", "ordinal"]
                )
                done += n

    return shared.materialize(rows.mapInArrow(write, "doc_id long, file string, ordinal long"), "token-places")


def scan_tokens(spark: SparkSession, path: str, files: DataFrame, form: Layout, block: int = BLOCK) -> DataFrame:
    """file, ordinal, first_token, n_tokens of every document of ``files`` (a column ``file``)."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = shared.open_fs(path)
        for batch in batches:
            info = fs.get_file_info([f"{base}/{f}" for f in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([i.size // form.bytes for i in info], pa.int64())], names=["file", "tokens"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = shared.open_fs(path)
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{base}/{file}") as f:
                    ids = np.frombuffer(f.read_at(form.bytes * block, form.bytes * start), form.type)
                ends = np.flatnonzero(ids == form.eod) + start
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file]), pa.array([start]), pa.array([ends], pa.list_(pa.int64()))], names=["file", "start", "ends"]
                )

    starts = (
        files.select("file").distinct().mapInArrow(sizes, "file string, tokens long").where("tokens > 0")
        .select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tokens") - 1, F.lit(block).cast("long"))).alias("start"))
    )
    found = starts.repartition("file", "start").mapInArrow(search, "file string, start long, ends array<long>")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    stitched = found.where("size(ends) > 0").select(
        "file", "ends",
        F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).alias("done"),
        F.coalesce(F.max(F.element_at("ends", -1)).over(before), F.lit(-1)).alias("last"),
    )
    return stitched.select("file", "done", F.posexplode(F.arrays_zip(F.col("ends").alias("end"), F.concat(F.array("last"), F.slice("ends", 1, F.size("ends") - 1)).alias("previous")))).select(
        "file", (F.col("done") + F.col("pos")).alias("ordinal"), (F.col("col.previous") + 1).alias("first_token"), (F.col("col.end") - F.col("col.previous") - 1).alias("n_tokens")
    )


def token_counts(docs: DataFrame, vocabulary: str | None = None, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK, waves: int = WAVES, eod: int | None = None) -> DataFrame:
    """doc_id, n_tokens, wave, file (its number), ordinal, first_token: written, then scanned back.

    The documents are dealt by a hash into ``waves``. Each wave's token files are written,
    scanned and removed before the next, which divides the disk that they take.
    """
    spark = docs.sparkSession
    form = layout(vocabulary, eod)
    done = []
    for wave in range(waves):
        path = shared.new_path(spark, "tokens")
        own = docs.where(F.pmod(F.xxhash64(doc_id), F.lit(waves)) == wave)
        places = write_tokens(own, path, form, vocabulary, doc_id, text)
        counts = scan_tokens(spark, path, places, form, block)
        # Both sides grow with the corpus, and the places look small on disk: no broadcast.
        joined = places.hint("merge").join(counts, ["file", "ordinal"]).select(
            "doc_id", "n_tokens", F.lit(wave).alias("wave"), F.split_part("file", F.lit("-"), F.lit(2)).cast("int").alias("file"), "ordinal", "first_token"
        )
        done.append(shared.materialize(joined, "token-counts"))
        remove_tokens(path)
    return reduce(DataFrame.unionByName, done)


def remove_tokens(path: str) -> None:
    """Remove the token files below ``path``, if any were written."""
    fs, base = shared.open_fs(path)
    if fs.get_file_info(base).type == pafs.FileType.Directory:
        fs.delete_dir(base)
