"""Zipped documents as a data source: no archive and no part has to fit a row.

``read_zipped`` gives the paragraphs of all documents below a folder. Small archives share a
partition up to ``GROUP_BYTES``; of a larger one only the directory is read first, by range, and
each part becomes a partition. A part is unpacked and cut at its closing tags piece by piece, so a
task holds a piece and one paragraph. ``write_zipped`` stores (path, content) rows as files: tasks
write hidden files, and the driver renames them when all tasks have ended, from their messages.
"""

from __future__ import annotations

import codecs
import re
import uuid
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from bitext.storage import listing, open_fs

from . import elements
from .containers import DAMAGE, KINDS

#: Bytes of archives that share a partition; larger ones have a partition a part.
GROUP_BYTES = 64 << 20
#: Unpacked bytes of a part that are looked at at once.
PIECE = 1 << 20
#: Partitions at most, and threads for what the driver does for each file.
PARTITIONS, THREADS = 1000, 16
SCHEMA = "doc_id string, part_no int, part string, p_index long, text string, error string"
_CLOSING = {"docx": "</w:p>", "pptx": "</a:p>"}
_OPENING = {"docx": re.compile(r"<w:p\b[^>]*>"), "pptx": re.compile(r"<a:p\b[^>]*>")}


def paragraphs(pieces: Iterator[str], kind: str) -> Iterator[tuple[int, str]]:
    """(index, text) of the paragraphs with text in a part (of XML, no tag within a tag) that comes in pieces; indexes count all paragraphs."""
    closing, opening, run = _CLOSING[kind], _OPENING[kind], re.compile(KINDS[kind][1])
    unfinished = re.compile(rf"{closing[0]}{closing[2:-1]}(?!\w)[^>]*\Z|<[^<>]{{0,{len(closing)}}}\Z")
    index, held, looked = 0, "", 0
    for piece in pieces:
        held += piece
        while (end := held.find(closing, looked)) >= 0:
            start = opening.search(held, 0, end)
            if start:
                text = "".join(m[1] for m in run.finditer(held, start.end(), end))
                if text.strip(elements.BLANKS):
                    yield index, text
                index += 1
            held, looked = held[end + len(closing):], 0
        # What stands before the first opening tag is in no paragraph; a tag may go on in the next piece.
        start = opening.search(held) or unfinished.search(held)
        held = held[start.start():] if start else ""
        looked = max(0, len(held) - len(closing) + 1)


def _decoded(part, size: int) -> Iterator[str]:
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    while data := part.read(size):
        yield decoder.decode(data)
    yield decoder.decode(b"", True)


def part_rows(archive: zipfile.ZipFile, name: str, kind: str, size: int) -> Iterator[tuple[int, str]]:
    with archive.open(name) as part:
        if kind == "epub":  # elements may nest in any order: a page is one piece
            html = "".join(_decoded(part, size))
            yield from ((n, html[a:b]) for n, (_, _, a, b, _) in enumerate(elements.elements(html)) if elements.has_text(html[a:b]))
        else:
            yield from paragraphs(_decoded(part, size), kind)


@dataclass
class Archives(InputPartition):
    """Whole archives, and parts (number and name) of archives."""

    units: list[tuple[str, tuple[int, str] | None]]


class ZippedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.kind = options["path"], options["kind"]
        self.group, self.piece = int(options.get("group_bytes", GROUP_BYTES)), int(options.get("piece", PIECE))
        self.wanted = re.compile(KINDS[self.kind][2])

    def partitions(self) -> list[Archives]:
        files = sorted((f.path, f.size) for f in listing(self.path, recursive=True) if f.is_file and f.path.lower().endswith("." + self.kind) and not f.base_name.startswith("."))
        with ThreadPoolExecutor(THREADS) as pool:  # directories of large archives are read at once
            parts = dict(pool.map(lambda path: (path, self._parts(path)), (path for path, n in files if n > self.group)))
        groups: list[list] = []
        held, size = [], 0
        for path, n in files:
            if n > self.group:
                groups += [[unit] for unit in parts[path]]
                continue
            if held and size + n > self.group:
                groups.append(held)
                held, size = [], 0
            held.append((path, None))
            size += n
        groups.append(held)
        # Many small groups share a partition: the number of tasks does not grow with the files.
        each = -(-len(groups) // PARTITIONS)
        return [Archives([unit for group in groups[k : k + each] for unit in group]) for k in range(0, len(groups), each)]

    def _names(self, archive: zipfile.ZipFile) -> list[tuple[int, str]]:
        return list(enumerate(n for n in archive.namelist() if self.wanted.search(n) and "[Content_Types]" not in n))

    def _parts(self, path: str) -> list[tuple[str, tuple[int, str] | None]]:
        fs, _ = open_fs(self.path)
        try:
            with fs.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                return [(path, part) for part in self._names(z)]
        except DAMAGE:
            return [(path, None)]  # its task says what is wrong

    def read(self, partition: Archives) -> Iterator[tuple]:
        fs, _ = open_fs(self.path)
        for path, part in partition.units:
            try:
                with fs.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                    for no, name in [part] if part else self._names(z):
                        try:
                            for index, text in part_rows(z, name, self.kind, self.piece):
                                yield path, no, name, index, text, None
                        except DAMAGE as e:
                            yield path, no, name, None, None, f"{type(e).__name__}: {e}"
            except DAMAGE as e:
                yield path, None, None, None, None, f"{type(e).__name__}: {e}"


@dataclass
class Written(WriterCommitMessage):
    """Hidden files of a task and the names that they get."""

    files: list[tuple[str, str]]


class ZippedWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, rows: Iterator) -> Written:
        fs, folder = open_fs(self.path)
        fs.create_dir(folder, recursive=True)
        files = []
        for row in rows:
            hidden = f"{folder}/.{uuid.uuid4().hex}"
            with fs.open_output_stream(hidden) as out:
                out.write(bytes(row.content or b""))
            files.append((hidden, f"{folder}/{row.path.rsplit('/', 1)[-1]}"))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, _ = open_fs(self.path)
        with ThreadPoolExecutor(THREADS) as pool:
            for message in messages:
                for _ in pool.map(lambda names: fs.move(*names), message.files if message else ()):
                    pass

    def abort(self, messages: list[Written | None]) -> None:
        fs, _ = open_fs(self.path)
        for message in messages:
            for hidden, _ in message.files if message else ():
                fs.delete_file(hidden)


class Zipped(DataSource):
    """Format ``zipped``, with options path and kind (docx, pptx, epub)."""

    @classmethod
    def name(cls) -> str:
        return "zipped"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ZippedReader:
        return ZippedReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> ZippedWriter:
        return ZippedWriter(self.options)


def read_zipped(spark: SparkSession, path: str, kind: str, **options: int) -> DataFrame:
    """doc_id (the path), part_no, part, p_index, text, error: paragraphs with text, and a row with the error of what cannot be read."""
    spark.dataSource.register(Zipped)
    reader = spark.read.format("zipped").option("kind", kind)
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load(path)


def write_zipped(files: DataFrame, path: str) -> None:
    """Store ``files`` (path, content) below ``path``, under the last part of each path."""
    files.sparkSession.dataSource.register(Zipped)
    files.select("path", "content").write.format("zipped").mode("append").save(path)
