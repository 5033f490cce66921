"""Operators on small inputs: golden cases, boundaries and plan shapes."""

from __future__ import annotations

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from bitext.operators import assemble, checks, match, terms, workspace
from bitext.plans import edits, inference, replies
from bitext.sources import blocks, containers, glossary
from bitext.storage import settings
from bitext.streaming import events, runs

INCOMING = "seq long, source string, target string, source_lang string, target_lang string, domain string, confirmed boolean"


def incoming(spark, *pairs):
    return spark.createDataFrame([(i, s, t, None, None, None, c) for i, (s, t, c) in enumerate(pairs)], INCOMING)


def base(spark, *pairs):
    rows = [(f"id{i}", s, t, "Auto", "中文 (简体)", "general", 1, False, None, None) for i, (s, t) in enumerate(pairs)]
    return spark.createDataFrame(rows, glossary.TERM)


def counts(old, new):
    return tuple(terms.merge_counts(terms.merge_terms(old, new), new).select("imported", "updated", "skipped").first())


def test_merge_terms(spark):
    old = base(spark, ("AI", "人工智能"), ("ML", "机器学习"))
    assert counts(old, incoming(spark, ("DL", "深度学习", None))) == (1, 0, 0)
    assert counts(old, incoming(spark, ("", "x", None), ("same", "same", None), ("  ", "y", None))) == (0, 0, 3)
    merged = {r.source: r for r in terms.merge_terms(old, incoming(spark, ("ai", "智能", True))).collect()}
    assert (merged["ai"].frequency, merged["ai"].target, merged["ai"].confirmed, merged["ai"].id, merged["ai"].change) == (2, "智能", True, "id0", "updated")
    thrice = terms.merge_terms(old, incoming(spark, ("x", "1", True), ("X", "2", None), ("x", "3", None)))
    row = thrice.where("change = 'imported'").collect()
    assert [(r.source, r.target, r.frequency, r.confirmed) for r in row] == [("x", "3", 3, True)]
    assert counts(old, incoming(spark, ("x", "1", None), ("X", "2", None), ("x", "3", None))) == (1, 2, 0)


def test_merge_terms_with_duplicates_inside_the_termbase_and_with_nothing(spark):
    old = base(spark, ("a", "1"), ("A", "2"))
    got = {r.id: (r.target, r.frequency) for r in terms.merge_terms(old, incoming(spark, ("a", "9", None))).collect()}
    assert got == {"id0": ("9", 2), "id1": ("2", 1)}
    assert terms.merge_terms(old.limit(0), incoming(spark)).count() == 0
    total = terms.merge_terms(old, incoming(spark, ("a", "9", None), ("b", "3", None))).agg(F.sum("frequency")).first()[0]
    assert total == 4


def test_import_terms_json_never_meets_its_own_incomplete_rows(spark):
    entry = "seq long, id string, source string, target string, source_lang string, target_lang string, domain string, frequency long, confirmed boolean"
    rows = [(0, None, "a", "b", None, None, None, None, None), (1, None, "a", "b", None, None, None, None, None), (2, None, "c", "d", "en", "zh", "general", 5, True), (3, None, "C", "D", "en", "zh", "general", None, None)]
    got = terms.import_terms_json(base(spark).limit(0), spark.createDataFrame(rows, entry)).collect()
    assert sorted((r.source, r.source_lang, r.frequency, r.confirmed) for r in got) == [("a", "en", 1, False), ("a", "en", 1, False), ("c", "en", 6, True)]
    assert len({r.id for r in got}) == 3


def test_term_lines(spark):
    lines = ["cat => 猫", "dog → 狗", "bird\t鸟", "fish,鱼", "# comment", "", "hello => hello", " => bar", "foo => ", "hello,world,foo", '"a ""b""",c', "single"]
    got = glossary.parse_term_lines(spark.createDataFrame([(x,) for x in lines], "line string")).collect()
    assert [(r.source, r.target) for r in got] == [("cat", "猫"), ("dog", "狗"), ("bird", "鸟"), ("fish", "鱼"), ("hello", "world,foo"), ('a "b"', "c")]
    assert got[0].source_lang == "en"


def test_intake_of_ties_and_null_batches(spark):
    r = random.Random(3)
    rows = [(b, r.randint(0, 3), r.choice(["a.md", "b.exe", "c.PDF", "d.docx"]), r.randint(1, 40)) for b in ("x", "y", None) for _ in range(r.randint(3, 30))]
    df = spark.createDataFrame(rows, "batch_id string, pos long, path string, length long")
    got = [tuple(x) for x in workspace.intake(df, max_files=6, max_bytes=30, max_total=70).collect()]
    assert sorted(map(repr, (g[:4] for g in got))) == sorted(map(repr, rows))
    for b in ("x", "y", None):
        own = [g for g in got if g[0] == b]
        first = sorted((g[1], g[2]) for g in own)[:6]
        kept = [g for g in own if g[4] != "too_many"]
        assert sorted((g[1], g[2]) for g in kept) == first
        good = [g for g in kept if not g[2].endswith("exe") and g[3] <= 30]
        whole = "accepted" if sum(g[3] for g in good) <= 70 else "batch_too_large"
        assert all(g[4] == (whole if g in good else "bad_type" if g[2].endswith("exe") else "too_large") for g in kept)
    assert workspace.intake(df.limit(0)).count() == 0


def csv_by_hand(line):
    out, field, quoted, i = [], "", False, 0
    while i < len(line):
        c = line[i]
        if quoted and line[i : i + 2] == '""':
            field += '"'
            i += 1
        elif c == '"':
            quoted = not quoted
        elif c == "," and not quoted:
            out.append(field)
            field = ""
        else:
            field += c
        i += 1
    return [*out, field]


def test_term_lines_have_any_number_of_fields(spark):
    r = random.Random(8)
    lines = ["a," + ",".join(f"t{i}" for i in range(500)), '"a,b",c', 'a"b,c"d,e', '"",x', ',', '', '"a""', 'x,"" ""', *("".join(r.choices('ab",  ', k=r.randint(1, 14))) for _ in range(400))]
    got = spark.createDataFrame([(x,) for x in lines], "line string").select("line", glossary.csv_fields(F.col("line"))).collect()
    assert {r[0]: r[1] for r in got} == {x: csv_by_hand(x) for x in lines}
    row = glossary.parse_term_lines(spark.createDataFrame([(lines[0],)], "line string")).first()
    assert row.target == ",".join(f"t{i}" for i in range(500))


def test_glossary_files(spark, tmp_path):
    csv = tmp_path / "g.csv"
    csv.write_text('source,target,confirmed\n"a ""q""",b,true\nshort\n,x,true\nc,d,false\n', encoding="utf-8")
    rows = glossary.read_glossary_csv(spark, str(csv)).collect()
    assert [(r.source, r.target, r.source_lang, r.confirmed) for r in rows] == [('a "q"', "b", "en", True), ("c", "d", "en", False)]
    (tmp_path / "a.json").write_text('[{"source": "a", "target": "b", "frequency": 3}]', encoding="utf-8")
    (tmp_path / "m.json").write_text('{"c": "d"}', encoding="utf-8")
    assert sorted((r.source, r.target) for r in glossary.read_glossary_json(spark, str(tmp_path / "*.json")).collect()) == [("a", "b"), ("c", "d")]
    assert glossary.default_glossary(spark).count() == 43
    out = tmp_path / "out"
    glossary.write_terms_csv(base(spark, ("x", 'y"z')), str(out))
    assert [r.target for r in glossary.read_glossary_csv(spark, str(out)).collect()] == ['y"z']
    glossary.write_terms_json(base(spark, ("x", "y")), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().sourceLang == "Auto"


DRIFT = {19: "high", 20: "low", 29: "low", 30: None, 180: None, 181: "low", 250: "low", 251: "medium"}
OVERFLOW = {120: None, 121: "medium", 150: "medium", 151: "high"}


def bitext(spark, lengths, constraint):
    rows = [(1, n, f"b{n}", "o" * 100, "t" * n, [], constraint) for n in lengths]
    return spark.createDataFrame(rows, "doc_id long, seq long, block_id string, original string, translated string, preserved_tags array<string>, constraint string")


def test_thresholds(spark):
    got = {r.block_id: r.severity for r in checks.check_drift(bitext(spark, DRIFT, "x")).collect()}
    assert {f"b{n}": s for n, s in DRIFT.items() if s} == got
    got = {r.block_id: r.severity for r in checks.check_overflow(bitext(spark, OVERFLOW, "Concise")).collect()}
    assert {f"b{n}": s for n, s in OVERFLOW.items() if s} == got
    assert checks.check_overflow(bitext(spark, OVERFLOW, "x")).count() == 0


def test_terms_and_tags(spark):
    rows = [(1, 0, "b0", "The API and the <b>key</b>", "接口 <term>key</term> <B >", ["<b>", "</b>", "**x**"], "x")]
    df = spark.createDataFrame(rows, bitext(spark, [1], "x").schema)
    g = spark.createDataFrame([("api", "接口"), ("key", "键"), ("and", "和"), ("none", "无")], "source string, target string")
    got = {r.detail: (r.severity, r.suggestion) for r in checks.check_terms(df, g).collect()}
    assert set(got) == {"key", "and"}
    assert got["key"] == ("medium", "接口 键 <B >")
    assert got["and"][0] == "high"
    assert {r.detail: r.severity for r in checks.check_tags(df).collect()} == {"</b>": "medium", "**x**": "medium"}


@pytest.mark.parametrize("automaton", [0, 1 << 20])
def test_contains_join_has_no_cartesian_product_on_its_large_paths(spark, automaton):
    texts = spark.createDataFrame([(1, 0, "The Quick brown fox"), (2, 0, "nothing"), (3, 0, None)], "doc_id long, seq long, text string")
    g = spark.createDataFrame([("quick b", "x"), ("ox", "y"), ("zzz", "z"), ("THE", "t")], "source string, target string")
    large = match.relevant_glossary(texts, g, small=1, automaton=automaton)
    small = match.relevant_glossary(texts, g)
    want = {(1, "quick b"), (1, "ox"), (1, "THE")}
    assert {(r.doc_id, r.source) for r in large.collect()} == want == {(r.doc_id, r.source) for r in small.collect()}
    plan = large._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    # With the automaton texts meet no gram and no exchange; without it, no Python.
    assert ("Python" in plan) == (automaton > 0)
    assert not automaton or ("Exchange hash" not in plan and "regexp_extract_all" not in plan)


def test_contains_join_finds_terms_of_any_length(spark):
    r = random.Random(2)
    sources = {"".join(r.choices("abc东西 ", k=r.randint(1, 5))) for _ in range(120)} | {"İ", "ß", "\n"}
    rows = [(i, "".join(r.choices("ABCabc东西\n ", k=r.randint(0, 30))) + r.choice(["", "İx", "ẞ"])) for i in range(80)]
    texts = spark.createDataFrame(rows, "doc_id long, text string").withColumn("seq", F.lit(0))
    g = spark.createDataFrame([(s, s[::-1]) for s in sources] + [("a", "a")] * 2, "source string, target string")
    ways = [sorted((x.doc_id, x.source, x.target) for x in match.relevant_glossary(texts, g, small=n, automaton=size).collect()) for n, size in ((0, 0), (0, 1 << 20), (2000, 0))]
    assert ways[0] == ways[1] == ways[2] and len(ways[0]) > 500


def test_incoming_rows_are_counted_before_they_are_sorted(spark):
    merged = terms.merge_terms(base(spark, ("AI", "人工智能")), incoming(spark, *[("ai", "b", None)] * 3))
    plan = merged._jdf.queryExecution().executedPlan().toString()
    first = plan.rindex("HashAggregate(keys=[source")
    assert all(plan.rindex("SortAggregate", 0, first) < first for _ in [0])
    assert [tuple(x) for x in merged.where("change = 'updated'").select("target", "frequency").collect()] == [("b", 4)]


def test_issues_carry_descriptions(spark):
    rows = [(1, 0, "b0", "A term, " * 5, "<term>term</term>" * 10, ["<b>", "**x**"], "Concise"), (1, 1, "b1", "x" * 100, "y", ["<i>"], "x"), (1, 2, "b2", "the term", "y" * 5, [], "x"), (1, 3, "b3", "x" * 100, "y" * 25, [], "x")]
    df = spark.createDataFrame(rows, bitext(spark, [1], "x").schema)
    g = spark.createDataFrame([("term", "Begriff")], "source string, target string")
    found = checks.check_all(df, g)
    assert checks.valid_issues(found).count() == found.count() == 9
    said = {(r.block_id, r.type, r.severity): r.description for r in found.collect()}
    assert said["b0", "layout_overflow", "high"] == "Concise block translation exceeds 1.2x limit (4.25x, 170 vs 40 chars). May cause layout overflow."
    assert said["b1", "semantic_drift", "high"] == "Translation is suspiciously short (1 vs 100 chars, ratio 0.01). May have lost significant content."
    assert said["b0", "semantic_drift", "medium"] == "Translation is suspiciously long (170 vs 40 chars, ratio 4.25). May contain added content or hallucinations."
    assert said["b3", "semantic_drift", "low"] == "Translation length ratio 0.25 is outside expected range (0.5-1.8). Verify content accuracy."
    assert said["b0", "tag_lost", "high"] == 'Tag "<b>" from original was lost in translation'
    assert said["b0", "tag_lost", "medium"] == 'Structural element "**x**" was lost'
    assert said["b0", "term_mismatch", "medium"].startswith('Term "term" was marked uncertain')
    assert said["b2", "term_mismatch", "high"] == 'Glossary term "term" should be "Begriff" but was not found in translation'


def counting(folder):
    """A model that notes each text it is asked for, and answers differently every time."""

    def fn(texts):
        import uuid
        from pathlib import Path

        for t in texts:
            (Path(folder) / uuid.uuid4().hex).write_text(t)
        return [f"{t} {uuid.uuid4().hex}" for t in texts]

    return fn


def test_each_block_is_asked_for_once(spark, tmp_path):
    rows = [(2**53 + 1, 0, "b0", "the API", "x", ["<b>"], "x", 0), (2**53 + 2, 1, "b1", "word", "words", [], "x", None), (None, 2, "b2", "rest", "rest of it", [], "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, seq int, block_id string, original string, translated string, preserved_tags array<string>, constraint string, retry_count int")
    g = spark.createDataFrame([("api", "接口")], "source string, target string")
    after, issues = inference.review_round(df, checks.check_all(df, g), g, counting(tmp_path))
    assert [p.read_text() for p in tmp_path.iterdir()] == ["the API"]
    got = {r.block_id: r for r in after.collect()}
    assert {b: r.doc_id for b, r in got.items()} == {"b0": 2**53 + 1, "b1": 2**53 + 2, "b2": None}
    # The issues are about the very text that is returned.
    long = [r.description for r in issues.where("block_id = 'b0' AND type = 'semantic_drift'").collect()]
    assert long and f"({len(got['b0'].translated)} vs 7 chars" in long[0]
    assert len(list(tmp_path.iterdir())) == 1
    asked = inference.ask_documents(spark.createDataFrame([(2**60 + 1, "p"), (None, None)], "doc_id long, prompt string"), counting(tmp_path))
    assert sorted(r.doc_id or 0 for r in asked.collect()) == [0, 2**60 + 1] and asked.where("reply is null").count() == 0
    assert len(list(tmp_path.iterdir())) == 3
    changed = spark.createDataFrame([(2**53 + 1, "b", "The big cat.", "le gros chat noir", "le grand chat noir")], "doc_id long, block_id string, source_text string, before_text string, after_text string")
    assert {r.doc_id for r in edits.term_candidates(changed).collect()} == {2**53 + 1}
    assert edits.term_candidates(changed.limit(0)).count() == 0


def test_damaged_containers_end_no_job(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr("word/a.xml", "<w:p><w:r><w:t>good part</w:t></w:r></w:p>")
        z.writestr("word/document.xml", "<w:p><w:r><w:t>hello there</w:t></w:r></w:p>")
    good = out.getvalue()
    files = [("ok", good), ("half", good.replace(b"hello there", b"hallo there", 1)), ("text", b"no archive"), ("empty", b""), ("none", None)]
    df = spark.createDataFrame(files, "path string, content binary")
    assert sorted((r.doc_id, r.text) for r in containers.scan_container(df, "docx").collect()) == [("half", "good part"), ("ok", "good part"), ("ok", "hello there")]
    assert {(r.doc_id, r.part) for r in containers.damaged(df, "docx").collect()} == {("half", "word/document.xml"), ("text", None), ("empty", None), ("none", None)}
    texts = spark.createDataFrame([(p, "word/document.xml", 0, "salut") for p, _ in files], "doc_id string, part string, p_index int, translated string")
    back = {r.path: r.content for r in containers.repack(df, texts, "docx").collect()}
    assert back["text"] == b"no archive" and back["none"] is None and back["half"] == dict(files)["half"]
    assert b"salut" in back["ok"]


def test_local_checks_scan_once(spark):
    df = bitext(spark, [10], "Concise")
    g = spark.createDataFrame([("a", "b")], "source string, target string")
    found = checks.check_all(df, g)
    assert {r.type for r in found.collect()} == {"semantic_drift"}
    # The bitext for the local checks, the bitext for the terms, the glossary.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 3


@pytest.mark.parametrize(
    ("n", "batch", "most", "expected"),
    [(100, 20, 6, [20] * 5), (1000, 1, 4, [250] * 4), (96, 20, 5, [20, 20, 20, 20, 16]), (50, 20, 3, [17, 17, 16]), (0, 20, 6, []), (-5, 20, 6, []), (7, 1, 6, [2, 2, 2, 1])],
)
def test_allocate(spark, n, batch, most, expected):
    rows = workspace.allocate(spark.createDataFrame([(1, n)], "doc_id long, n long"), batch, most).orderBy("worker_index").collect()
    assert [r.item_count for r in rows] == expected
    assert [r.start_index for r in rows] == [sum(expected[:i]) for i in range(len(expected))]


def test_intake(spark):
    mib = workspace.MIB
    rows = [("a", i, f"f{i}.{e}", n) for i, (e, n) in enumerate([("docx", mib), ("exe", 1), ("PDF", 201 * mib), *[("md", 1)] * 8])] + [("b", i, f"g{i}.pdf", 180 * mib) for i in range(3)]
    got = {(r.batch_id, r.pos): r.reason for r in workspace.intake(spark.createDataFrame(rows, "batch_id string, pos long, path string, length long")).collect()}
    assert (got["a", 0], got["a", 1], got["a", 2], got["a", 9], got["a", 10]) == ("accepted", "bad_type", "too_large", "accepted", "too_many")
    assert {got["b", i] for i in range(3)} == {"batch_too_large"}


def test_memory_takes_the_last_and_never_an_empty_translation(spark):
    b = spark.createDataFrame([(1, " x "), (2, "y"), (3, "z"), (4, " "), (5, None)], "doc_id long, text string")
    m = spark.createDataFrame([(1, "x", "old"), (2, "x ", "new"), (3, "y", "")], "seq long, original string, translated string")
    want = {1: "new", 2: "y", 3: "z", 4: " ", 5: None}
    assert {r.doc_id: r.translated for r in workspace.memory_lookup(b, m).collect()} == want
    blank = m.unionByName(spark.createDataFrame([(9, "\t", "-")], m.schema))
    assert {r.doc_id: r.translated for r in workspace.memory_lookup(b, blank).collect()} == want | {4: "-", 5: "-"}


def test_memory_trims_a_text_once_a_row_and_joins_what_comes_straight_from_a_shuffle(spark):
    b = spark.createDataFrame([(1, "\u3000same\ufeff"), (2, "same\n"), (3, "sa me"), (4, "\ufeff\t"), (5, "Same")], "doc_id long, text string")
    m = spark.createDataFrame([(2, "same", "last"), (1, "\u00a0same", "first"), (3, "same x", "-"), (4, None, "null"), (5, "Same", "kept"), (6, "Same ", "")], "seq long, original string, translated string")
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}):
        got = workspace.memory_lookup(b, m)
        assert got.columns == ["doc_id", "text", "translated"]
        assert {r.doc_id: r.translated for r in got.collect()} == {1: "last", 2: "last", 3: "sa me", 4: "\ufeff\t", 5: "Same"}
        plan = got._jdf.queryExecution().executedPlan().toString()
    # A sort or join by an expression works it out at each comparison.
    assert "SortMergeJoin [memory_key" in plan
    # Adaptive joins split a common key only where nothing stands between shuffle and sort.
    assert "Aggregate" not in plan


def sequential_paragraphs(lines):
    import re

    out, current = [], ""
    for raw in lines:
        line = raw.strip()
        if not line or re.match(blocks.SPECIAL_LINE, line) or len(line) < 25:
            out += [x for x in (current, line) if x]
            current = ""
            continue
        if not current:
            current = line
        elif current.endswith("-"):
            current = current[:-1] + line
        else:
            current += line if re.search(r"[぀-ヿ㐀-䶿一-鿿]$", current) else " " + line
        if re.search(r"[.:!?。！？’”」]$", line) or len(line) < 50:
            out.append(current)
            current = ""
    return [x for x in [*out, current] if x]


def test_paragraphs_equal_a_line_by_line_reader(spark):
    a, b = "An ordinary line of text that is long enough to go on", "and a line that ends with a hyphen so that it is glued-"
    lines = [a, b, a, "", "Title", "1.2 Heading", "* item of a list that is longer than usual, much longer", a, a + ".", "这是一个很长的中文行这是一个很长的中文行这是一个很长的中文行这是一个很长的中文行这是一个很长的中文行字", a, "short", b]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "doc_id long, seq long, text string")
    got = [r.text for r in blocks.reconstruct_paragraphs(df).orderBy("seq").collect()]
    assert got == sequential_paragraphs(lines)


def test_html_round_trip(spark):
    html = '<html><title>T</title><P class="a">one <b>x</b></P><p> </p><li>two</li>tail</html>'
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    found = blocks.scan_html_blocks(pages).orderBy("seq")
    assert [(r.tag, r.text) for r in found.collect()] == [("title", "T"), ("p", "one <b>x</b>"), ("li", "two")]
    same = assemble.assemble_html(pages, found.withColumn("translated", F.col("text")))
    assert same.first().html == html
    new = assemble.assemble_html(pages, found.where("seq = 1").withColumn("translated", F.lit("$1 neu")))
    assert new.first().html == html.replace("one <b>x</b>", "$1 neu")


def docx(texts):
    runs_ = "".join(f"<w:p><w:r><w:t>{t[:1]}</w:t></w:r><w:r><w:t xml:space='preserve'>{t[1:]}</w:t></w:r></w:p>" for t in texts)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<x/>")
        z.writestr("word/document.xml", f"<w:document>{runs_}</w:document>")
        z.writestr("media/p.bin", b"\x00\x01")
    return out.getvalue()


def test_containers(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx(["Hello &amp; you", " ", "Second"]))
    files = containers.read_files(spark, str(tmp_path / "*.docx"))
    found = containers.scan_container(files, "docx").orderBy("p_index")
    assert [(r.p_index, r.text) for r in found.collect()] == [(0, "Hello &amp; you"), (2, "Second")]
    again = containers.repack(files, found.withColumn("translated", F.when(F.col("p_index") == 0, "A < B & C")), "docx").first()
    with zipfile.ZipFile(io.BytesIO(again.content)) as z:
        xml = z.read("word/document.xml").decode()
        assert z.read("media/p.bin") == b"\x00\x01"
    assert "<w:t>A &lt; B &amp; C</w:t></w:r><w:r><w:t xml:space='preserve'></w:t>" in xml
    assert "econd" in xml


def test_candidates():
    got = edits.candidates("The Model Context Protocol is important.", "模型上下文协议很重要。", "MCP 协议很重要。")
    assert got[0][1] == "MCP 协议"
    assert edits.candidates("x", "same", "same") == []
    assert edits.candidates("keep API here please now then", "use API now", "use 接口 now") == [("API", "接口", "API", 0.85)]
    assert edits.candidates("one two three four five six seven", "a b", "a zz") == [("", "zz", "b", 0.5)][:0]


def test_translate_batch_halves_retries_and_falls_back():
    calls = []

    def flaky(texts):
        calls.append(len(texts))
        if len(texts) > 1:
            return texts[:-1]
        if texts == ["bad"]:
            raise RuntimeError("boom")
        return [t.upper() for t in texts]

    assert inference.translate_batch(["a", "bad", "c"], flaky, [("bad", "good")]) == ["A", "good", "C"]
    waits = []

    def limited(texts):
        if len(waits) < 2:
            raise RuntimeError("429 retry in 7s" if waits else "rate limit")
        return texts

    assert inference.translate_batch(["x"], limited, sleep=waits.append) == ["x"]
    assert waits == [1.5, 7.0]
    with pytest.raises(RuntimeError, match="401"):
        inference.translate_batch(["x", "y"], lambda t: (_ for _ in ()).throw(RuntimeError("401")))
    assert inference.translate_batch(["x"], lambda t: [""]) == ["x"]


def test_translate_blocks_keeps_order(spark):
    df = spark.range(100).select("id", F.concat(F.lit("the "), F.col("id").cast("string")).alias("text"))
    got = inference.translate_blocks(df, inference.stub([("the", "le")]), batch=7).collect()
    assert all(r.translated == f"le {r.id}" for r in got)


REPLIES = {'```json\n{"a": 1}\n```': '{"a": 1}', 'Sure: {"a": [1]} ok': '{"a": [1]}', "x [1, 2] y": "[1, 2]", "none": None, None: None, "{broken": None}


def test_extract_json(spark):
    df = spark.createDataFrame([(k,) for k in REPLIES], "t string")
    assert {r[0]: r[1] for r in df.select("t", replies.extract_json(F.col("t"))).collect()} == REPLIES


def test_translations_array(spark):
    cases = {'["a", 1]': ["a", "1"], '{"results": ["r"]}': ["r"], '{"n": 1, "other": ["o"]}': ["o"], '{"n": 1}': ["src"], '{"translations": ["t"], "translated": ["u"]}': ["t"]}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r[0]: r[1] for r in df.select("t", replies.translations_array(F.col("t"), F.array(F.lit("src")))).collect()} == cases


def test_corrections(spark):
    cases = {'{"corrections": ["x", ""]}': ["x", "b"], '{"corrections": ["x"]}': ["x", "b"], "[1] Source: s Translation: p [2] Source: s Translation: q": ["p", "q"], "nothing": ["a", "b"]}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r[0]: r[1] for r in df.select("t", replies.apply_corrections(F.col("t"), F.array(F.lit("a"), F.lit("b")))).collect()} == cases


def test_alignment_and_splitting(spark):
    b = spark.createDataFrame([(1, 0, 0, "a"), (1, 0, 1, "b"), (1, 1, 0, "c"), (1, 1, 1, "d"), (1, 1, 2, "e")], "doc_id long, batch long, pos int, text string")
    r = spark.createDataFrame([(1, 0, ["A", ""]), (1, 1, ["C"])], "doc_id long, batch long, texts array<string>")
    got = replies.align_replies(b, r)
    assert {x.text: (x.translated, x.needs_split) for x in got.collect()} == {"a": ("A", False), "b": ("b", False), "c": ("c", True), "d": ("d", True), "e": ("e", True)}
    halves = {(x.batch, x.pos): x.text for x in replies.split_batches(got).collect()}
    assert halves == {("1.0", 0): "c", ("1.1", 0): "d", ("1.1", 1): "e"}


def test_executor_reply(spark):
    rows = [('{"translatedText": "t", "confidence": 2}', "o", "x"), ("no", "<b>o", "x"), ('{"preservedTags": ["q"]}', "o", "x")]
    got = replies.parse_executor_reply(spark.createDataFrame(rows, "reply string, original string, constraint string")).collect()
    assert [(r.translated, r.confidence, r.preserved_tags) for r in got] == [("t", 1.0, []), ("<b>o", 0.0, []), ("o", 0.6, ["q"])]


def test_token_stream(spark):
    def data(x):
        return 'data: {"choices": [{"delta": {"content": "%s"}}]}' % x

    lines = [data("He"), "", ": ping", "data: {bad", data("llo"), 'data: {"choices": []}', "data: [DONE]", data(" 世界")]
    df = spark.createDataFrame([("r", i, x) for i, x in enumerate(lines)], "response_id string, line_no long, line string")
    assert events.assemble_token_stream(df).first().text == "Hello 世界"


def expected_sessions(stamps, limit=30 * 60_000_000):
    out, start, n = [], None, 0
    for t in stamps:
        if start is not None and t >= start + limit:
            out.append((start, n))
            start, n = None, 0
        if start is None:
            start = t
        n += 1
    return out, (start, n)


def test_sessions_end_30_minutes_after_creation(spark):
    df = runs.stream_table(spark, "/root/testdata/sf0.001/events.parquet").select(F.col("user_id").alias("doc_id"), F.col("ts").cast("timestamp").alias("ts"))
    got = runs.run_available(events.evict_stale_sessions(df), "append", "sessions").collect()
    by_user = {}
    for r in spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).orderBy("t").collect():
        by_user.setdefault(r.user_id, []).append(r.t)
    found = {}
    for r in got:
        found.setdefault(r.doc_id, []).append((r.created, r.events))
    for user, stamps in by_user.items():
        ended, last = expected_sessions(stamps)
        assert sorted(found.get(user, [])) in (ended, [*ended, last])


def test_incremental_run_repeats_nothing(spark, tmp_path):
    spark.createDataFrame([(1, "b0", "the a"), (1, "b1", "b"), (1, "b0", "the a")], "doc_id long, block_id string, text string").write.parquet(str(tmp_path / "in"))
    stream = runs.stream_table(spark, str(tmp_path / "in"))
    for i in range(2):
        runs.finish(events.incremental_translate(stream, inference.stub([("the", "le")]), str(tmp_path / "out"), str(tmp_path / f"cp{i}")))
    assert sorted(r.translated for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["b", "le a"]


def test_bounded_streams_are_waited_for_without_a_limit():
    import pytest

    from bitext.streaming import runs

    class Slow:
        stopped = False

        def awaitTermination(self, timeout=None):  # noqa: N802
            return None if timeout is None else False

        def stop(self):
            self.stopped = True

    query = Slow()
    runs.finish(query)
    assert query.stopped
    with pytest.raises(TimeoutError):
        runs.finish(Slow(), 1)


def test_validity_of_terms_is_tested_behind_the_aggregate(spark):
    rows = spark.createDataFrame([(1, " a ", "b", "en", None, "d", True), (2, " a ", "b", "en", None, "d", True), (3, "x", "x", "en", None, "d", None)], "seq long, source string, target string, source_lang string, target_lang string, domain string, confirmed boolean")
    same = rows.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))
    valid = terms.valid_terms(same, "n")
    plan = valid._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") < plan.index("Aggregate") and "Filter" not in plan[plan.index("Aggregate") :]
    assert [tuple(r) for r in valid.collect()] == [("a", "b", 2)]


def test_short_spans_are_merged_without_a_join(spark):
    from bitext import queries

    assert "Join" not in queries.f24_merge_short(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
