"""Bounded runs of streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from bitext.storage import new_path, settings


def stream_table(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A Parquet table, one file or a folder, as a stream of its files, up to ``files`` of them a micro-batch."""
    # As a pattern, since a stream's plain path has to be a folder.
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    reader = reader if files is None else reader.option("maxFilesPerTrigger", files)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def finish(query: StreamingQuery, timeout: int | None = None) -> None:
    """Wait until a bounded query ends by itself, however long, then stop it; fails if it failed.

    With a ``timeout`` in seconds it also fails if the query did not end by then.
    """
    try:
        if timeout is None:
            query.awaitTermination()
        elif not query.awaitTermination(timeout):
            raise TimeoutError(f"streaming query not done after {timeout} s")
    finally:
        query.stop()


#: State store that timers and several state variables need.
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def run_available(stream: DataFrame, mode: str, name: str, conf: dict[str, str] = ROCKSDB) -> DataFrame:
    """Process what is there now and return it: all rows in append mode, the last result in complete mode.

    Each micro-batch goes to a folder of its own, named by its id, so a repeated one replaces
    itself. ``conf`` holds session settings of this query alone.
    """
    spark = stream.sparkSession
    path = new_path(spark, name)

    def write(batch: DataFrame, batch_id: int) -> None:
        target = path + "/rows" if mode == "complete" else f"{path}/rows/batch={batch_id}"
        batch.write.mode("overwrite").parquet(target)

    with settings(spark, conf):
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", path + "/state").trigger(availableNow=True).foreachBatch(write).start()
        finish(query)
    return spark.read.schema(stream.schema).parquet(path + "/rows")
