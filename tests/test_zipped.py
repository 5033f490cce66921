"""Zipped documents as a data source."""

from __future__ import annotations

import io
import random
import re
import zipfile

import pytest

from bitext.sources import containers, zipped


@pytest.mark.parametrize("seed", range(4))
def test_pieces_equal_the_whole_part(seed):
    r = random.Random(seed)
    bits = ["<w:p>", "<w:p a='b'>", "</w:p>", "<w:t>", "<w:t xml:space='x'>", "</w:t>", "text", " ", "é", "<w:px>", ">", "\u3000", "<x/>"]
    paragraph, run, _ = containers.KINDS["docx"]
    for _ in range(300):
        xml = "".join(r.choices(bits, k=r.randint(0, 40)))
        want = [(i, "".join(re.findall(run, re.sub(r"\A<w:p\b[^>]*>", "", m[0])))) for i, m in enumerate(re.finditer(paragraph, xml))]
        want = [(i, t) for i, t in want if t.strip("\u3000 ")]
        size = r.randint(1, 9)
        pieces = (xml[k : k + size] for k in range(0, len(xml), size))
        assert list(zipped.paragraphs(pieces, "docx")) == want, xml


def test_large_archives_have_a_partition_a_part(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "big.docx", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        for part in range(3):
            z.writestr(f"word/part{part}.xml", "<w:body>" + "".join(f"<w:p><w:t>{part} {k} é</w:t></w:p>" for k in range(20000)) + "</w:body>")
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "no.txt").write_bytes(b"x")
    df = zipped.read_zipped(spark, str(tmp_path), "docx", group_bytes=1000, piece=1000)
    assert df.rdd.getNumPartitions() == 4
    rows = df.collect()
    assert len(rows) == 60001
    assert {(r.part, r.p_index): r.text for r in rows if not r.error} == {(f"word/part{p}.xml", k): f"{p} {k} é" for p in range(3) for k in range(20000)}
    assert [r.doc_id.rsplit("/", 1)[-1] for r in rows if r.error] == ["bad.docx"]


def test_written_files_come_whole_or_not_at_all(spark, tmp_path):
    files = containers.pack_lines(spark.createDataFrame([(1, "a\nb"), (2, None), (3, "")], "doc_id long, text string"), "pptx")
    zipped.write_zipped(files, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["1.pptx", "2.pptx", "3.pptx"]
    assert zipfile.ZipFile(io.BytesIO((tmp_path / "out" / "1.pptx").read_bytes())).namelist() == ["[Content_Types].xml", "ppt/slides/slide1.xml"]
    got = zipped.read_zipped(spark, str(tmp_path / "out"), "pptx")
    assert [(r.p_index, r.text) for r in got.orderBy("p_index").collect()] == [(0, "a"), (1, "b")]
    assert zipped.read_zipped(spark, str(tmp_path / "none"), "pptx").collect() == []


def test_tasks_do_not_grow_with_the_files(tmp_path, monkeypatch):
    monkeypatch.setattr(zipped, "PARTITIONS", 7)
    for k in range(50):
        with zipfile.ZipFile(tmp_path / f"{k}.docx", "w") as z:
            for part in range(1 + k % 2):
                z.writestr(f"word/part{part}.xml", "<w:p><w:t>" + f"{k}" * (1 + k % 2 * 500) + "</w:t></w:p>")
    reader = zipped.ZippedReader({"path": str(tmp_path), "kind": "docx", "group_bytes": "300"})
    found = reader.partitions()
    assert len(found) <= 7
    rows = [row for p in found for row in reader.read(p)]
    assert sorted((int(r[0].rsplit("/", 1)[-1][:-5]), r[1]) for r in rows) == sorted((k, part) for k in range(50) for part in range(1 + k % 2))
