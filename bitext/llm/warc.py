"""WARC archives with a two-level capture index.

Archives hold one gzip member per capture. The index has two levels: captures sorted by
reversed-host URL key in compressed blocks, and a sparse directory with one entry per block.
A lookup searches the directory by halving, reads one block by range, and then the capture
itself by range.

Defined results: a null html is an empty payload, and empty payloads are equal payloads; a
null url has the key ``)/``; of equal payloads the smallest page_id is the response and rows
that share it are responses too; a null page_id revisits the smallest id, or is a response
where its payload has no id at all; repeated rows give a row each; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

DATE = "2024-01-01T00:00:00Z"
#: Captures per index block, at least; the directory never has more than MAX_BLOCKS entries
#: besides one per index file, because blocks grow with the number of captures.
LINES = 3000
MAX_BLOCKS = 100_000
#: Characters of a key that the directory keeps, so that its size is bounded too.
KEY_CHARS = 256
#: Bytes of archive records that one reading task is dealt.
READ_BYTES = 16 << 20
#: Payloads from this many bytes may be revisits.
MIN_REVISIT = 0
COMPRESSION = 1


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: Column) -> Column:
    """Reversed host, ``)`` and path with query: http://a.b.org:80/x?y#z becomes org,b,a)/x?y."""
    u = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"#.*$", "")
    authority = F.regexp_replace(F.regexp_extract(u, r"^[^/?]*", 0), r"^.*@", "")
    port = F.regexp_extract(authority, r":(\d+)$", 1)
    host = F.lower(F.regexp_replace(authority, r":\d*$", ""))
    rest = F.regexp_extract(u, r"^[^/?]*(.*)$", 1)
    return F.concat(
        F.array_join(F.reverse(F.split(host, r"\.")), ","),
        F.when(port.isin("", "80", "443"), F.lit("")).otherwise(F.concat(F.lit(":"), port)),
        F.lit(")"), F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)),
    )


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, kind: str) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP header, with the payload's length, only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '').replace(chr(10), '')}", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case, HTTP ones under ``http:``) and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    fields |= {f"http:{k.lower()}": v.strip() for k, _, v in (line.partition(":") for line in http.decode().split("\r\n")[1:])}
    return fields, payload


def _page(urn: str | None) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">") if urn else ""
    return int(number) if number else None


@dataclass
class Archive:
    """Where archives and index lie, and the sparse directory."""

    path: str
    captures: int
    bytes: int
    key_chars: int
    directory: DataFrame  # first, last (keys, up to key_chars), file, offset, length


def write_archive(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT, lines: int = LINES, key_chars: int = KEY_CHARS) -> Archive:
    """Write archives and both index levels for page_id, url, html."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    # Equal payloads are told by 256 bits: different pages with one SHA-1 can be made.
    rows = rows.select("*", F.sha2("html", 256).alias("same"), F.octet_length("html").alias("bytes"))
    # Only payloads that come more than once need to know their response.
    repeated = shared.materialize(
        rows.where(F.col("bytes") >= min_revisit).groupBy("same", "bytes").agg(F.min("page_id").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"),
        "warc-repeated",
    )
    typed = rows.join(repeated, ["same", "bytes"], "left").withColumn("revisit", F.col("response").isNotNull() & ~F.col("response").eqNullSafe(F.col("page_id")))
    # The page_id makes keys unique, so that one lookup means one capture.
    typed = typed.select(index_key(F.col("url"), F.col("page_id")).alias("key"), "page_id", "url", "html", F.when(F.col("revisit"), F.col("response")).alias("refers_to"), "revisit")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = shared.open_fs(path)
        fs.create_dir(base, recursive=True)
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        at = 0
        with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
            for batch in batches:
                offsets, lengths = [], []
                for page_id, url, html, refers_to, revisit in zip(*(batch.column(i) for i in range(1, 6)), strict=True):
                    payload = html.as_py().encode()
                    kind = "revisit" if revisit.as_py() else "response"
                    raw = gzip.compress(record(page_id.as_py(), url.as_py(), payload, payload_digest(payload), refers_to.as_py(), kind), COMPRESSION, mtime=0)
                    out.write(raw)
                    offsets.append(at)
                    lengths.append(len(raw))
                    at += len(raw)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([name] * len(offsets), pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], names=["key", "file", "offset", "length"])

    entries = shared.materialize(typed.mapInArrow(write, "key string, file string, offset long, length long"), "warc-entries")
    captures, size = entries.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    per_block = max(lines, -(-captures // MAX_BLOCKS))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = shared.open_fs(path)
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.cdx"
        found, held, at = [], [], 0
        with fs.open_output_stream(f"{base}/{name}", compression=None) as out:

            def flush() -> None:
                nonlocal at
                raw = zlib.compress("\n".join("\t".join(map(str, x)) for x in held).encode(), COMPRESSION)
                out.write(raw)
                found.append((held[0][0][:key_chars], held[-1][0][:key_chars], name, at, len(raw)))
                at += len(raw)
                held.clear()

            for batch in batches:
                for entry in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    held.append(entry)
                    if len(held) == per_block:
                        flush()
            if held:
                flush()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names=["first", "last", "file", "offset", "length"])

    ordered = entries.repartitionByRange("key").sortWithinPartitions("key")
    directory = shared.materialize(ordered.mapInArrow(index, "first string, last string, file string, offset long, length long"), "warc-directory")
    return Archive(path, captures, size, key_chars, directory)


def index_key(url: Column, page_id: Column) -> Column:
    """URL key and page_id; tabs and line ends, which end index fields, become blanks."""
    return F.concat(F.regexp_replace(url_key(url), r"[\t\r\n]", " "), F.lit(" "), F.coalesce(page_id.cast("string"), F.lit("")))


def lookup(spark: SparkSession, archive: Archive, keys: DataFrame) -> DataFrame:
    """The captures with the given index keys (a column ``key``), read from the archives.

    page_id, url, payload_bytes, payload_digest, record_type, refers_to and payload (null for
    revisits). The directory, bounded by MAX_BLOCKS and KEY_CHARS, goes to every task; keys are
    dealt by block, so that each block is read once.
    """
    path, key_chars = archive.path, archive.key_chars
    blocks = archive.directory.orderBy("first", "last").toArrow().to_pydict()
    directory = spark.sparkContext.broadcast(blocks)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = directory.value
        for batch in batches:
            out_key, out_block = [], []
            for key in batch.column(0).to_pylist():
                # Repeated keys, and keys that begin alike, may fill several blocks.
                short = key[:key_chars]
                for b in range(bisect_left(d["last"], short), bisect_right(d["first"], short)):
                    out_key.append(key)
                    out_block.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(out_key, pa.string()), pa.array(out_block, pa.int32())], names=["key", "block"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = directory.value
        fs, base = shared.open_fs(path)
        block, entries, open_files = None, {}, {}
        for batch in batches:
            wanted = []
            for key, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if b != block:
                    block, entries = b, {}
                    with fs.open_input_file(f"{base}/{d['file'][b]}") as f:
                        raw = f.read_at(d["length"][b], d["offset"][b])
                    for line in zlib.decompress(raw).decode().split("\n"):
                        k, file, offset, length = line.split("\t")
                        entries.setdefault(k, []).append((file, int(offset), int(length)))
                wanted += entries.get(key, [])
            for at in range(0, len(wanted), 200):
                out = []
                for file, offset, length in wanted[at : at + 200]:
                    if file not in open_files:
                        if len(open_files) >= 64:
                            open_files.pop(next(iter(open_files))).close()
                        open_files[file] = fs.open_input_file(f"{base}/{file}")
                    out.append(_capture(*parse(gzip.decompress(open_files[file].read_at(length, offset)))))
                yield pa.RecordBatch.from_pylist(out, schema=CAPTURE)
        for f in open_files.values():
            f.close()

    placed = keys.select("key").distinct().mapInArrow(search, "key string, block int")
    # By the bytes to read, not by those of the keys.
    tasks = min(len(blocks["file"]), max(spark.sparkContext.defaultParallelism, -(-archive.bytes // READ_BYTES)))
    dealt = placed.repartition(max(1, tasks), "block").sortWithinPartitions("block", "key")
    return dealt.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string")


CAPTURE = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.string()),
])


def _capture(fields: dict[str, str], payload: bytes) -> dict:
    digest, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
    if kind == "response" and payload_digest(payload) != digest:
        raise ValueError(f"damaged record {fields['warc-record-id']}")
    return {
        "page_id": _page(fields["warc-record-id"]), "url": fields["warc-target-uri"], "payload_bytes": int(fields["http:content-length"]), "payload_digest": digest,
        "record_type": kind, "refers_to": _page(fields.get("warc-refers-to")), "payload": payload.decode() if kind == "response" else None,
    }


def archive_report(pages: DataFrame) -> DataFrame:
    """Write all pages, then look every page up again: the digest columns of each record."""
    spark = pages.sparkSession
    archive = write_archive(pages, shared.new_path(spark, "warc"))
    keys = pages.select(index_key(F.col("url").cast("string"), F.col("page_id").cast("long")).alias("key"))
    return lookup(spark, archive, keys).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
