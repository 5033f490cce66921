"""The folder that driver and executors share, and tables written there."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
#: Tables with buckets by some of the columns of a join need no shuffle for it.
BUCKETED = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}


def shared_dir(spark: SparkSession) -> str:
    """Folder that all processes of the application can reach.

    ``spark.checkpoint.dir`` where it is set. Otherwise, in local mode only, a temporary folder
    of the application; a cluster without the setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    sc = spark.sparkContext
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _own:
        _own[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _own[sc.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends here.

    The files stay until the owner of the folder removes them; their size is known to the
    optimizer, which therefore broadcasts the table only below its own threshold.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """Session settings for a while; a query keeps those it was started with."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialize_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """As ``materialize``, in one file for each bucket of ``key``.

    What groups by it, and maybe by more, shuffles nothing; nor does what joins such tables, while ``BUCKETED`` holds.
    """
    spark = df.sparkSession
    path, n = new_path(spark, name), int(spark.conf.get("spark.sql.shuffle.partitions"))
    listed = re.sub(r"\W", "_", path.rsplit("/", 1)[1])
    df.repartition(n, key).write.bucketBy(n, key).option("path", path).format("parquet").saveAsTable(listed)
    out = spark.table(listed)
    spark.sql(f"DROP TABLE {listed}")  # its files stay
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or plain path, on the driver or in a task."""
    if "://" in uri:
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri.removeprefix("file:")


def listing(uri: str, recursive: bool = False) -> list[pafs.FileInfo]:
    """What is below a folder; nothing where it does not exist."""
    fs, path = open_fs(uri)
    return fs.get_file_info(pafs.FileSelector(path, allow_not_found=True, recursive=recursive))
