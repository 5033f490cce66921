"""Zipped documents: parts out, paragraphs out, translations back in."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitext.functions.compat import strip

from . import elements
from .blocks import PIECE, scan_elements

#: Paragraph element and text run of each kind, and the parts they are in; pages of a book have block elements.
KINDS = {
    "docx": (r"(?s)<w:p\b[^>]*>.*?</w:p>", r"(?s)<w:t\b[^>]*>(.*?)</w:t>", r"\.xml$"),
    "pptx": (r"(?s)<a:p\b[^>]*>.*?</a:p>", r"(?s)<a:t\b[^>]*>(.*?)</a:t>", r"^ppt/.*\.xml$"),
    "epub": ("", "", r"(?i)\.(?:xhtml|html|htm)$"),
}
#: What reading a damaged or encrypted archive raises.
DAMAGE = (zipfile.BadZipFile, zlib.error, EOFError, OSError, RuntimeError, NotImplementedError, ValueError)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def unzip_parts(files: DataFrame, kind: str) -> DataFrame:
    """doc_id (the path), part, xml of a container's text parts, in the archive's order.

    A part that cannot be read has no xml but an ``error``; a file that is no archive, or has no
    content, is one such row without a part.
    """
    wanted = re.compile(KINDS[kind][2])

    def parts(content: bytes | None) -> Iterator[tuple]:
        try:
            with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
                names = [n for n in z.namelist() if wanted.search(n) and "[Content_Types]" not in n]
                for i, name in enumerate(names):
                    try:
                        yield i, name, z.read(name).decode("utf-8", "replace"), None
                    except DAMAGE as e:
                        yield i, name, None, f"{type(e).__name__}: {e}"
        except DAMAGE as e:
            yield None, None, None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())

        def out(held: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), kinds, strict=True)], names=["doc_id", "part_no", "part", "xml", "error"])

        for batch in batches:
            held, size = [], 0
            for path, content in zip(*batch.columns, strict=True):
                for row in parts(content.as_py()):
                    held.append((path.as_py(), *row))
                    size += len(row[2] or "")
                    if size >= PIECE:
                        yield out(held)
                        held, size = [], 0
            if held:
                yield out(held)

    return files.select("path", "content").mapInArrow(run, "doc_id string, part_no int, part string, xml string, error string")


def damaged(files: DataFrame, kind: str) -> DataFrame:
    """doc_id, part, error of what ``scan_container`` leaves out."""
    return unzip_parts(files, kind).where("error IS NOT NULL").select("doc_id", "part", "error")


def scan_container(files: DataFrame, kind: str) -> DataFrame:
    """doc_id, part, p_index, text of paragraphs with text; entities stay as they are.

    Damaged files and parts give no paragraphs (see ``damaged``).
    """
    paragraph, run, _ = KINDS[kind]
    parts = unzip_parts(files, kind).where("error IS NULL")
    if kind == "epub":
        found = scan_elements(parts.select("doc_id", "part_no", "part", "xml"), "xml", only_text=False, seq="p_index").drop("tag")
        return found.where(strip(F.regexp_replace("text", "<[^>]*>", "")) != "")
    found = parts.select("doc_id", "part_no", "part", F.posexplode(F.regexp_extract_all("xml", F.lit(paragraph), F.lit(0))).alias("p_index", "p"))
    return found.withColumn("text", F.array_join(F.regexp_extract_all("p", F.lit(run), F.lit(1)), "")).where(strip(F.col("text")) != "").drop("p")


def _escape(text: str) -> str:
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&apos;"), ('"', "&quot;")):
        text = text.replace(raw, escaped)
    return text


def _unescape(text: str) -> str:
    for raw, escaped in (("<", "&lt;"), (">", "&gt;"), ("'", "&apos;"), ('"', "&quot;"), ("&", "&amp;")):
        text = text.replace(escaped, raw)
    return text


def rewrite_part(xml: str, kind: str, texts: dict[int, str]) -> str:
    """A part with the texts of its paragraphs, by index, replaced."""
    if kind == "epub":
        return elements.rewritten(xml, texts, all_elements=True)
    paragraph, run, _ = KINDS[kind]
    counter = iter(range(1 << 60))

    def one(m: re.Match) -> str:
        text = texts.get(next(counter))
        if text is None:
            return m[0]
        rest = iter([_escape(_unescape(text))])
        return re.sub(run, lambda r: r[0][: r.start(1) - r.start()] + next(rest, "") + r[0][r.end(1) - r.start() :], m[0])

    return re.sub(paragraph, one, xml)


def repack(files: DataFrame, bitext: DataFrame, kind: str) -> DataFrame:
    """path, content with translations (doc_id, part, p_index, translated) put back; parts are stored uncompressed.

    A damaged file, or one without content, comes back as it is.
    """

    def one(given: bytes | None, parts: list, indices: list, texts: list) -> bytes | None:
        by_part: dict[str, dict[int, str]] = {}
        for part, index, text in zip(parts, indices, texts, strict=True):
            by_part.setdefault(part, {})[int(index)] = text
        out = io.BytesIO()
        try:
            with zipfile.ZipFile(io.BytesIO(given or b"")) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as new:
                for name in z.namelist():
                    raw = z.read(name)
                    new.writestr(name, rewrite_part(raw.decode("utf-8", "replace"), kind, by_part[name]) if name in by_part else raw)
        except DAMAGE:
            return given
        return out.getvalue()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = ([], []), 0
            for row, (path, given, *texts) in enumerate(zip(*batch.columns, strict=True), 1):
                content = one(given.as_py(), *(x.as_py() or [] for x in texts))
                held[0].append(path.as_py())
                held[1].append(content)
                size += len(content or b"")
                if size >= PIECE or row == len(batch):
                    yield pa.RecordBatch.from_arrays([pa.array(held[0], pa.string()), pa.array(held[1], pa.binary())], names=["path", "content"])
                    held, size = ([], []), 0

    # One row a file, not one group: a group costs Python milliseconds.
    new = bitext.where("translated IS NOT NULL").groupBy(F.col("doc_id").alias("path")).agg(F.collect_list(F.struct("part", "p_index", "translated")).alias("new"))
    rows = files.select("path", "content").join(new, "path", "left")
    return rows.select("path", "content", "new.part", "new.p_index", "new.translated").mapInArrow(run, "path string, content binary")


#: Paragraph markup, and the part that holds it, of the kinds that ``pack_lines`` writes.
SHELLS = {
    "docx": ("word/document.xml", '<w:document xmlns:w="w"><w:body>{}</w:body></w:document>', '<w:p><w:r><w:t xml:space="preserve">{}</w:t></w:r></w:p>'),
    "pptx": ("ppt/slides/slide1.xml", '<p:sld xmlns:p="p" xmlns:a="a">{}</p:sld>', "<a:p><a:r><a:t>{}</a:t></a:r></a:p>"),
    "epub": ("OEBPS/text.xhtml", "<html><body>{}</body></html>", "<p>{}</p>"),
}


def pack_lines(docs: DataFrame, kind: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """path, content: a minimal container per document, one paragraph per line."""
    part, shell, paragraph = SHELLS[kind]

    def pack(value: str | None) -> bytes:
        out = io.BytesIO()
        body = "".join(paragraph.format(line) for line in _escape(value or "").split("\n"))
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("[Content_Types].xml", "<Types/>")
            z.writestr(part, shell.format(body))
        return out.getvalue()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = ([], []), 0
            for row, (name, value) in enumerate(zip(*batch.columns, strict=True), 1):
                value = value.as_py()
                held[0].append(f"{name.as_py()}.{kind}")
                held[1].append(pack(value))
                size += len(value or "")
                if size >= PIECE or row == len(batch):
                    yield pa.RecordBatch.from_arrays([pa.array(held[0], pa.string()), pa.array(held[1], pa.binary())], names=["path", "content"])
                    held, size = ([], []), 0

    return docs.select(doc_id, text).mapInArrow(run, "path string, content binary")
