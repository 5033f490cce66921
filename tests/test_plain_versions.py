"""Queries that SQL cannot express, whole results against plain Python."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from datetime import timedelta

import pytest

from bitext import inputs, queries
from bitext.functions import python_text
from bitext.operators import checks
from bitext.plans import edits
from bitext.sources.elements import BLOCK_TAGS
from bitext.storage import table

SF = "/root/testdata/sf0.001"
HTML_BLOCK = rf"(?is)<({'|'.join(BLOCK_TAGS)})\b([^>]*)>(.*?)</\1>"


@pytest.fixture(scope="module")
def edited(spark):
    return queries._edits(spark, SF).collect()


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def test_term_candidates(spark, edited):
    want = [(r.doc_id, r.block_id, k, *c) for r in edited for k, c in enumerate(edits.candidates(r.source_text, r.before_text, r.after_text))]
    got = [tuple(r) for r in queries.x5_term_candidates(spark, SF).collect()]
    assert sorted(got) == sorted(want) and len(want) > 10
    # Every guess is about what changed: it is part of the new text, and the old part of the old one.
    texts = {(r.doc_id, r.block_id): r for r in edited}
    squeeze = lambda t: " ".join(t.split())
    for doc_id, block_id, _, _, target, old, confidence in want:
        r = texts[doc_id, block_id]
        assert target in squeeze(r.after_text) and old in squeeze(r.before_text) and target != old and 0 < confidence <= 0.9


def learned(rows):
    """Terms learned from edits: source, target, frequency by the key of a term, in the order of the edits."""
    best = defaultdict(list)
    for r in sorted(rows, key=lambda r: (f"{r.doc_id:020}", r.block_id)):
        good = [c for c in edits.candidates(r.source_text, r.before_text, r.after_text) if c[3] >= 0.5][:3]
        for source, target, _, _ in good:
            source, target = " ".join(source.split()), " ".join(target.split())
            if source and target and source != target:
                best[source.lower()].append((source, target))
    return sorted((*found[-1], len(found)) for found in best.values())


def test_learning_from_edits(spark, edited):
    got = queries.t6_learn_from_edits(spark, SF).collect()
    assert sorted((r.source, r.target, r.frequency) for r in got) == learned(edited) != []
    assert {(r.domain, r.confirmed, r.change) for r in got} == {("proofread", False, "imported")}


def test_learning_from_a_stream_of_edits(spark):
    rows = table(spark, SF, "conversations").where("role = 'assistant'").collect()

    class Edit:
        def __init__(self, r):
            self.doc_id, self.block_id, self.source_text, self.before_text = r.conv_id, f"block-{r.turn}", r.text, r.text
            self.after_text = re.sub(r"^(\S+) (\S+)", r"\1 \2x", r.text)

    got = queries.r5_learn_stream(spark, SF).collect()
    assert sorted((r.source, r.target, r.frequency) for r in got) == learned(map(Edit, rows)) != []


def test_repaired_tags_and_pages(spark):
    rows = checks.tag_balance(inputs.tagged(spark, SF)).collect()
    repaired = {(r.doc_id, r.seq): python_text.reapply_tags(r.original, r.translated) if r.broken else r.translated for r in rows}
    got = {(r.doc_id, r.seq): (r.broken, r.translated_md5) for r in queries.f17_repair_inline_tags(spark, SF).collect()}
    assert got == {(r.doc_id, r.seq): (r.broken, md5(repaired[r.doc_id, r.seq])) for r in rows}

    block = re.compile(HTML_BLOCK)
    want = {}
    for page in table(spark, SF, "pages").collect():
        seq = -1

        def new(m, page_id=page.page_id):
            nonlocal seq
            if not re.sub(r"<[^>]*>", "", m[3]).strip():
                return m[0]
            seq += 1
            start = m.start()
            return m[0][: m.start(3) - start] + repaired[page_id, seq] + m[0][m.end(3) - start :]

        want[page.page_id] = md5(block.sub(new, page.html))
    assert {r.page_id: r.html_md5 for r in queries.k6_assemble_html(spark, SF).collect()} == want


def test_repaired_tags_are_those_of_the_source(spark):
    texts = ["a <b>bold</b> word", "<i>x</i> y <b>z</b>", "one <a href='u'>link <b>in</b></a> it", "plain", "<span>s</span><span>t</span>"]
    pairs = [(k, j, f"block-{j}", o, t) for k, o in enumerate(texts) for j, t in enumerate(["", "ein Wort", "<b>ein Wort", "ein</b> <i>Wort</i> und noch eins", o])]
    rows = checks.tag_balance(spark.createDataFrame(pairs, "doc_id long, seq int, block_id string, original string, translated string"))
    before = {(r.doc_id, r.seq): r for r in rows.collect()}
    after = {(r.doc_id, r.seq): r.translated for r in python_text.repair_tags(rows).collect()}
    inline = re.compile(r"</?(?:b|i|em|strong|a|span)\b[^>]*>", re.I)
    assert sum(r.broken for r in before.values()) > 8
    for key, r in before.items():
        if r.broken:
            assert sorted(inline.findall(after[key])) == sorted(inline.findall(r.original))
            assert inline.sub("", after[key]) == inline.sub("", r.translated)
        else:
            assert after[key] == r.translated


def test_cleaned_texts(spark):
    got = {r.doc_id: (r.n_chars, r.text_md5) for r in queries.f11_clean_extracted(spark, SF).collect()}
    rows = {r.doc_id: r.text.replace(" ", " ") for r in table(spark, SF, "documents").collect() if r.text is not None}
    want = {i: python_text.clean_text(t) for i, t in rows.items()}
    assert got == {i: (len(t), md5(t)) for i, t in want.items()}
    # Nothing but line ends and trailing brackets changes in these texts.
    assert all("".join(t.split()) in "".join(rows[i].split()) for i, t in want.items())


def test_sessions(spark):
    """A session starts at a document's first event and takes what follows within half an hour; open ones are not out yet."""
    stamps = defaultdict(list)
    for r in table(spark, SF, "events").select("user_id", "ts").collect():
        stamps[r.user_id].append(r.ts)
    want, end = [], max(max(x) for x in stamps.values()) - timedelta(minutes=10)
    for doc_id, own in stamps.items():
        found = []
        for t in sorted(own):
            if found and t < found[-1][0] + timedelta(minutes=30):
                found[-1][1] += 1
            else:
                found.append([t, 1])
        want += [(doc_id, n) for k, (t, n) in enumerate(found) if k + 1 < len(found) or t + timedelta(minutes=30) <= end]
    got = queries.r3_evict_stale_sessions(spark, SF).collect()
    assert sorted((r.doc_id, r.events) for r in got) == sorted(want) != []
