"""Versions of a table: a log of commits, of which the last one counts.

``<base>/data-<id>`` holds the rows of a version, ``<base>/_log/<number>.json`` names it. The
entry is written under a hidden name and then renamed, so a version is there as a whole or not
at all, and readers keep the version they started with. One writer at a time, as a streaming
query is. Each commit has a tag; the tag of the last one tells a repeated writer that its work
is done.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from bitext.storage import listing, open_fs


def _entries(base: str) -> list[str]:
    """Paths of the log, oldest first."""
    return sorted(f.path for f in listing(f"{base}/_log") if f.base_name.endswith(".json") and not f.base_name.startswith("."))


def last(base: str) -> dict | None:
    """number, data, tag of the latest version, or None before the first."""
    entries = _entries(base)
    if not entries:
        return None
    fs, _ = open_fs(base)
    with fs.open_input_stream(entries[-1]) as f:
        return json.loads(f.read())


def latest(spark: SparkSession, base: str) -> DataFrame | None:
    now = last(base)
    return None if now is None else spark.read.parquet(f"{base}/{now['data']}")


def commit(df: DataFrame, base: str, tag: str) -> int:
    """Write ``df`` as the next version and return its number; nothing if the last commit has this tag."""
    now = last(base)
    if now is not None and now["tag"] == tag:
        return now["number"]
    number, data = (0 if now is None else now["number"] + 1), f"data-{uuid.uuid4().hex}"
    df.write.parquet(f"{base}/{data}")
    fs, path = open_fs(f"{base}/_log")
    fs.create_dir(path, recursive=True)
    hidden = f"{path}/.{data}"
    with fs.open_output_stream(hidden) as f:
        f.write(json.dumps({"number": number, "data": data, "tag": tag}).encode())
    fs.move(hidden, f"{path}/{number:020d}.json")
    return number
