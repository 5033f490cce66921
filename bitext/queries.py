"""Registered queries, one or more per operator, each over whole tables, and their oracles."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitext import inputs, versions
from bitext.functions import predicates, python_text, register, text
from bitext.inputs import sql, sql_apply_terms, sql_quote
from bitext.operators import assemble, checks, layout, match, terms, workspace
from bitext.plans import edits, glossary_pass, inference, replies, requests
from bitext.sources import blocks as scans
from bitext.sources import containers, zipped
from bitext.sources import glossary as glossaries
from bitext.storage import materialize, new_path, table
from bitext.streaming import events as streams
from bitext.streaming import runs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_WS = r"[\s\x0B\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


_MARKED = "'U' || text"


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _md5(c: Column | str) -> Column:
    return F.md5(c)


# Scans

_FILES = "SELECT source AS batch_id, doc_id AS pos, doc_id || ['.docx', '.PDF', '.md', '.exe'][doc_id % 4 + 1] AS path, n_chars * 100000 AS length FROM documents"


@query(
    f"""WITH f AS ({_FILES}), r AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY batch_id ORDER BY pos) > 10 THEN 'too_many' WHEN path LIKE '%.exe' THEN 'bad_type' WHEN length > 209715200 THEN 'too_large' END AS why FROM f)
    SELECT batch_id, pos, coalesce(why, CASE WHEN sum(CASE WHEN why IS NULL THEN length END) OVER (PARTITION BY batch_id) > 524288000 THEN 'batch_too_large' END, 'accepted') AS reason FROM r"""
)
def s1_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.element_at(F.array(*map(F.lit, (".docx", ".PDF", ".md", ".exe"))), (F.col("doc_id") % 4 + 1).cast("int"))
    files = table(spark, sf_dir, "documents").select(
        F.col("source").alias("batch_id"), F.col("doc_id").alias("pos"), F.concat(F.col("doc_id").cast("string"), ending).alias("path"), (F.col("n_chars") * 100000).alias("length")
    )
    return workspace.intake(files).select("batch_id", "pos", "reason")


_XML = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '''', '&apos;'), '\"', '&quot;')"


def _scan_packed(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    found = containers.scan_container(containers.pack_lines(table(spark, sf_dir, "documents"), kind), kind)
    return found.select("doc_id", F.col("p_index").cast("long").alias("p_index"), "text")


def _sql_packed(kind: str, expression: str = "text") -> str:
    return sql(f"SELECT doc_id || '.{kind}' AS doc_id, seq AS p_index, {_XML.format(expression)} AS text FROM lines WHERE {_strip('text')} <> ''", "lines")


@query(_sql_packed("docx"))
def s2_scan_docx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan_packed(spark, sf_dir, "docx")


@query(_sql_packed("pptx"))
def s3_scan_pptx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan_packed(spark, sf_dir, "pptx")


@query(_sql_packed("epub"))
def s5_scan_epub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan_packed(spark, sf_dir, "epub")


def _scan_files(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """The same documents as files of a folder, large ones part by part."""
    path = new_path(spark, kind)
    zipped.write_zipped(containers.pack_lines(table(spark, sf_dir, "documents"), kind), path)
    found = zipped.read_zipped(spark, path, kind, group_bytes=20_000)
    return found.select(F.regexp_extract("doc_id", r"[^/]*\z", 0).alias("doc_id"), "p_index", "text")


@query(_sql_packed("docx"))
def s2_scan_docx_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan_files(spark, sf_dir, "docx")


@query(_sql_packed("pptx"))
def s3_scan_pptx_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan_files(spark, sf_dir, "pptx")


@query(_sql_packed("epub"))
def s5_scan_epub_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan_files(spark, sf_dir, "epub")


_TERM_TEXTS = "SELECT source, target, source_lang, domain, confirmed FROM termbase"


@query(sql(_TERM_TEXTS, "termbase"))
def s9_k2_glossary_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "terms-csv")
    glossaries.write_terms_csv(inputs.termbase(spark, sf_dir), path)
    return glossaries.read_glossary_csv(spark, path).select("source", "target", "source_lang", "domain", "confirmed")


@query(sql("SELECT id, frequency, source, target, source_lang, domain, confirmed FROM termbase", "termbase"))
def s10_k1_glossary_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "terms-json")
    glossaries.write_terms_json(inputs.termbase(spark, sf_dir), path)
    return glossaries.read_glossary_json(spark, path, lines=True).select("id", "frequency", "source", "target", "source_lang", "domain", "confirmed")


@query(sql("SELECT domain, count(*) AS terms, sum(frequency)::BIGINT AS frequency FROM (SELECT domain, frequency FROM termbase UNION ALL SELECT 'default-glossary', 1 FROM range(43)) GROUP BY domain", "termbase"))
def s12_default_glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = terms.merge_terms(inputs.termbase(spark, sf_dir), glossaries.default_glossary(spark))
    return merged.groupBy("domain").agg(F.count(F.lit(1)).alias("terms"), F.sum("frequency").alias("frequency"))


@query(sql("SELECT doc_id, seq, tag, md5(text) AS text_md5 FROM html_blocks", "html_blocks"))
def s4_scan_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.html_blocks(spark, sf_dir).select("doc_id", F.col("seq").cast("long").alias("seq"), "tag", _md5("text").alias("text_md5"))


_MARKDOWN = "SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents"


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))


@query(
    f"SELECT doc_id, seq, text FROM (SELECT doc_id, unnest(range(len(l))) AS seq, unnest(l) AS text FROM (SELECT doc_id, regexp_split_to_array(text, '\\r?\\n\\r?\\n') AS l FROM ({_MARKDOWN}))) "
    f"WHERE {_strip('text')} <> ''"
)
def s6_scan_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.scan_markdown(_markdown(spark, sf_dir)).withColumn("seq", F.col("seq").cast("long"))


@query(
    f"SELECT doc_id, unnest(range(len(l))) AS page_index, unnest(l) AS text FROM (SELECT doc_id, "
    f"list_filter(list_transform(string_split(replace(text, '. ', chr(12)), chr(12)), lambda x: {_strip('x')}), lambda x: x <> '') AS l FROM documents)"
)
def s7_scan_paged_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Sentence ends stand for page ends.
    paged = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit(". "), F.lit("\f")).alias("text"))
    return scans.scan_paged_text(paged).withColumn("page_index", F.col("page_index").cast("long"))


#: Lines wrapped at 60 characters or less, as a page of fixed width would have them.
_WRAPPED = (
    "wrapped AS (SELECT doc_id, seq * 1000 + k AS seq, part AS text FROM (SELECT doc_id, seq, unnest(range(len(l))) AS k, unnest(l) AS part FROM "
    r"(SELECT doc_id, seq, regexp_extract_all(text, '.{1,60}(?:\s|$)') AS l FROM lines)))"
)


def _wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.lines(spark, sf_dir)
    parts = rows.select("doc_id", "seq", F.posexplode(F.regexp_extract_all("text", F.lit(r".{1,60}(?:\s|$)"), F.lit(0))).alias("k", "text"))
    return parts.select("doc_id", (F.col("seq") * 1000 + F.col("k")).cast("long").alias("seq"), "text")


@query(
    sql(
        f""", {_WRAPPED},
        l AS (SELECT doc_id, seq, {_strip('text')} AS line FROM wrapped),
        f AS (SELECT *, line = '' AS blank,
                regexp_matches(line, '^(?:Section|Chapter|Title|Page|[0-9]+(?:\\.[0-9]+)*)(?:[^A-Za-z0-9_]|$)') OR regexp_matches(line, '^(?:\\*|-|•|◆)[A-Za-z0-9_]') OR length(line) < 25 AS special,
                regexp_matches(line, '[.:!?。！？’”」]$') OR length(line) < 50 AS closes FROM l),
        s AS (SELECT *, lag(blank) OVER w AS b, lag(special) OVER w AS sp, lag(closes) OVER w AS c FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY seq)),
        r AS (SELECT *, sum(CASE WHEN b IS NULL OR b OR sp OR c OR blank OR special THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq) AS run FROM s)
        SELECT doc_id, min(seq) AS seq, list_reduce(list(line ORDER BY seq), lambda a, x: CASE WHEN a LIKE '%-' THEN a[:-2] || x ELSE a || ' ' || x END) AS text
        FROM r WHERE NOT blank GROUP BY doc_id, run""",
        "lines",
    )
)
def s8_reconstruct_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.reconstruct_paragraphs(_wrapped(spark, sf_dir))


@query(ORACLES["s8_reconstruct_paragraphs"])
def s8_reconstruct_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.reconstruct_long_paragraphs(_wrapped(spark, sf_dir))


_TERM_LINE = "word || CASE length(word) % 4 WHEN 0 THEN ' => ' WHEN 1 THEN ' → ' WHEN 2 THEN chr(9) ELSE ',' END || CASE WHEN length(word) % 5 = 0 THEN word ELSE reverse(word) END"


@query(
    sql(
        """SELECT word AS source, reverse(word) AS target, CASE WHEN regexp_matches(word, '[A-Za-z]') THEN 'en' ELSE 'Auto' END AS source_lang, 'zh-CN' AS target_lang, 'general' AS domain, true AS confirmed
        FROM (SELECT DISTINCT word FROM words) WHERE length(word) % 5 <> 0 AND reverse(word) <> word""",
        "words",
    )
)
def s11_read_glossary_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("word")
    mark = F.when(n % 4 == 0, " => ").when(n % 4 == 1, " → ").when(n % 4 == 2, "\t").otherwise(",")
    rows = inputs.distinct_words(spark, sf_dir)
    lines = rows.select(F.concat("word", mark, F.when(n % 5 == 0, F.col("word")).otherwise(F.reverse("word"))).alias("line"))
    return glossaries.parse_term_lines(lines).drop("line")


# Sinks


@query(
    sql(
        """SELECT any_value(source_lang) AS source_lang, count(*) AS terms, md5(string_agg(source || '=' || target, chr(10) ORDER BY -length(source), source)) AS map_md5
        FROM termbase WHERE source_lang = 'en' AND target_lang = '中文 (简体)'""",
        "termbase",
    )
)
def k3_glossary_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = match.glossary_map(inputs.termbase(spark, sf_dir), "en", "中文 (简体)")
    entries = F.map_entries(F.from_json("glossary", "map<string,string>"))
    rows = F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return one.select(F.lit("en").alias("source_lang"), F.size(entries).cast("long").alias("terms"), _md5(F.array_join(rows, "\n")).alias("map_md5"))


@query(sql("SELECT row_number() OVER (ORDER BY length(source) DESC, source) - 1 AS rank, source, target FROM termbase WHERE source_lang = 'en' AND target_lang = '中文 (简体)'", "termbase"))
def k3_glossary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.glossary_rows(inputs.termbase(spark, sf_dir), "en", "中文 (简体)")


@query(
    sql(
        """, pages_ AS (SELECT doc_id, seq // 4 AS page, string_agg(CASE WHEN seq % 3 = 0 THEN 'U' || text ELSE text END, chr(10) || chr(10) ORDER BY seq) AS text FROM lines GROUP BY ALL)
        SELECT doc_id, md5(string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY page)) AS text_md5 FROM pages_ GROUP BY doc_id""",
        "lines",
    )
)
def k4_assemble_paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.lines(spark, sf_dir).select(
        "doc_id", F.floor(F.col("seq") / 4).alias("page_index"), "seq", F.col("text").alias("original"), F.when(F.col("seq") % 3 == 0, F.concat(F.lit("U"), "text")).alias("translated")
    )
    return assemble.assemble_paged(rows).select("doc_id", _md5("text").alias("text_md5"))


@query(sql("SELECT doc_id, md5(string_agg(CASE WHEN seq % 3 = 0 THEN 'U' || text ELSE text END, chr(10) || chr(10) ORDER BY seq)) AS text_md5 FROM lines GROUP BY doc_id", "lines"))
def k5_assemble_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.lines(spark, sf_dir)
    done = rows.where("seq % 3 = 0").withColumn("translated", F.concat(F.lit("U"), "text"))
    return assemble.assemble_markdown(rows, done).select("doc_id", _md5("text").alias("text_md5"))


@query()
def k6_assemble_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = python_text.repair_tags(checks.tag_balance(inputs.tagged(spark, sf_dir)))
    return assemble.assemble_html(table(spark, sf_dir, "pages"), rows).select("page_id", F.length("html").alias("n_chars"), _md5("html").alias("html_md5"))


@query(_sql_packed("docx", sql_apply_terms("text")))
def k7_repack_container(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = materialize(containers.pack_lines(table(spark, sf_dir, "documents"), "docx"), "packed")
    found = containers.scan_container(files, "docx")
    done = found.withColumn("translated", text.apply_terms(text.unescape_xml(F.col("text")), inputs.GLOSSARY))
    again = containers.scan_container(containers.repack(files, done, "docx"), "docx")
    return again.select("doc_id", F.col("p_index").cast("long").alias("p_index"), "text")


@query(
    sql(
        "SELECT doc_id, md5(string_agg(CASE WHEN seq % 4 = 0 THEN 'edit ' || seq ELSE text END, chr(10) || chr(10) ORDER BY seq)) AS text_md5 FROM lines GROUP BY doc_id", "lines"
    )
)
def k8_corrected_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.lines(spark, sf_dir)
    edit = F.when(F.col("seq") % 4 == 0, F.concat(F.lit("edit "), F.col("seq").cast("string"))).otherwise(" ")
    done = workspace.positional_overlay(rows, rows.select("doc_id", "seq", edit.alias("translated")))
    return assemble.assemble_markdown(rows, done).select("doc_id", _md5("text").alias("text_md5"))


@query(
    sql(
        f"SELECT doc_id, count(*) AS total_spans, count(*) FILTER (WHERE text <> {sql_apply_terms('text')}) AS overlaid_count, count(*) FILTER (WHERE length(text) % 6 = 0) AS glossary_fixes FROM spans GROUP BY doc_id",
        "spans",
    )
)
def k9_run_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.spans(spark, sf_dir)
    done = rows.select("doc_id", F.col("text").alias("original"), text.apply_terms(F.col("text"), inputs.GLOSSARY).alias("translated"))
    return layout.run_metadata(rows, done, rows.where(F.length("text") % 6 == 0))


# Filters


def _term_rows(df: DataFrame) -> DataFrame:
    return df.select("id", "source", "target", "source_lang", "domain", "frequency", "confirmed")


_TERM_ROWS = "SELECT id, source, target, source_lang, domain, frequency, confirmed FROM termbase"


@query(sql(f"{_TERM_ROWS} WHERE source_lang = 'en' AND target_lang = '中文 (简体)'", "termbase"))
def p1_terms_by_lang_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _term_rows(match.terms_by_lang_pair(inputs.termbase(spark, sf_dir), "en", "中文 (简体)"))


@query(sql(f"{_TERM_ROWS} WHERE domain = 'words'", "termbase"))
def p2_terms_by_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _term_rows(match.terms_by_domain(inputs.termbase(spark, sf_dir), "words"))


@query(sql(f"{_TERM_ROWS} WHERE source_lang IN ('', 'en')", "termbase"))
def p3_active_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _term_rows(match.active_terms(inputs.termbase(spark, sf_dir), "en", "中文 (简体)"))


@query(sql(f"{_TERM_ROWS} WHERE contains(lower(source || ' ' || target || ' ' || domain), 'tion') ORDER BY id LIMIT 300", "termbase"))
def p4_search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _term_rows(match.search_terms(inputs.termbase(spark, sf_dir), "TION"))


@query(sql("SELECT doc_id, seq, original, translated FROM pairs WHERE contains(lower(original), 'that') OR contains(lower(translated), 'that')", "pairs"))
def p5_search_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.search_pairs(inputs.pairs(spark, sf_dir), "That").select("doc_id", "seq", "original", "translated")


_SYMBOLS = r"[\-0-9\s.,%$€£¥₩₽₹₱₿+/\\*#@()\[\]{}]"


@query(
    sql(
        rf"""SELECT doc_id, seq, w, text, length({_strip('text')}) < 2 OR regexp_matches({_strip('text')}, '^{_SYMBOLS}+$') AS skip_text,
        regexp_matches(regexp_replace(text, '[-. ~]', '', 'g'), '^[0-9]{{1,6}}$') AS skip_numeric_short,
        length({_strip('text')}) < 3 OR (length({_strip('text')}) < 10 AND regexp_matches({_strip('text')}, '^[\-0-9\s.,%$€£¥₩₽₹₱₿]+$')) AS skip_short_number,
        regexp_matches(text, '[一-鿿]') AS has_han, regexp_matches(text, '[㐀-鿿぀-ヿ가-힯]') AS contains_cjk, {_strip('text')} <> '' AS non_blank
        FROM (SELECT doc_id, seq, unnest(range(len(l))) AS w, unnest(l) AS text FROM (SELECT doc_id, seq, string_split(text, ' ') AS l FROM lines))""",
        "lines",
    )
)
def p6_p10_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.lines(spark, sf_dir).select("doc_id", "seq", F.posexplode(F.split("text", " ")).alias("w", "text"))
    names = ("skip_text", "skip_numeric_short", "skip_short_number", "has_han", "contains_cjk", "non_blank")
    return rows.select("doc_id", F.col("seq").cast("long").alias("seq"), F.col("w").cast("long").alias("w"), "text", *(getattr(predicates, n)(F.col("text")).alias(n) for n in names))


_STATUS_ROWS = "SELECT doc_id, event_id, status, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'x' END AS translated FROM ev"


@query(sql(f"SELECT * FROM ({_STATUS_ROWS}) WHERE (status = 'pending' OR translated = '') AND status NOT IN ('translating', 'done', 'edited')", "ev"))
def p11_pending_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.events(spark, sf_dir).select("doc_id", "event_id", "status", F.when(F.col("event_id") % 3 == 0, "").otherwise("x").alias("translated"))
    return workspace.pending_blocks(rows)


@query(sql("SELECT * FROM (SELECT doc_id, arg_max(phase, event_id) AS phase FROM ev GROUP BY doc_id) WHERE phase NOT IN ('completed', 'failed')", "ev"))
def p12_incomplete_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = inputs.events(spark, sf_dir).groupBy("doc_id").agg(F.max_by("phase", "event_id").alias("phase"))
    return workspace.incomplete_tasks(tasks)


@query(sql(f"SELECT * FROM (SELECT doc_id, span_id, text AS original, {sql_apply_terms('text')} AS translated FROM spans) WHERE original <> translated", "spans"))
def p14_drop_noop(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.spans(spark, sf_dir).select("doc_id", "span_id", F.col("text").alias("original"), text.apply_terms(F.col("text"), inputs.GLOSSARY).alias("translated"))
    return workspace.drop_noop(rows)


@query(sql("SELECT doc_id, block_id, type, severity FROM issues WHERE severity <> 'low'", "issues"))
def p15_valid_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.issues(spark, sf_dir).withColumn("description", F.when(F.col("severity") != "low", F.col("suggestion")).otherwise(""))
    return checks.valid_issues(rows).select("doc_id", "block_id", "type", "severity")


@query(
    sql(
        """SELECT id, source, CASE WHEN id = 'w-the' THEN 'changed' ELSE target END AS target, CASE WHEN id = 'w-the' THEN true ELSE confirmed END AS confirmed FROM termbase
        WHERE source NOT IN (SELECT word FROM words WHERE length(word) % 2 = 1)""",
        "termbase", "words",
    )
)
def p16_update_and_delete_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = terms.update_term(inputs.termbase(spark, sf_dir), "w-the", target="changed", confirmed=True)
    gone = inputs.words(spark, sf_dir).where(F.length("word") % 2 == 1).select(F.concat(F.lit("w-"), "word").alias("id"))
    return terms.delete_terms(rows, gone).select("id", "source", "target", "confirmed")


# Joins

_HITS = "SELECT doc_id, seq, source, target FROM lines, {0} WHERE source <> '' AND contains(lower(text), lower(source))"


@query(sql(_HITS.format("glossary"), "lines", "glossary"))
def j1_relevant_glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.relevant_glossary(inputs.lines(spark, sf_dir), inputs.glossary(spark)).withColumn("seq", F.col("seq").cast("long"))


@query(sql(_HITS.format("termbase"), "lines", "termbase"))
def j1_relevant_glossary_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = match.relevant_glossary(inputs.lines(spark, sf_dir), inputs.termbase(spark, sf_dir), small=100)
    return hits.withColumn("seq", F.col("seq").cast("long"))


_MEMORY = "SELECT doc_id * 100000 + seq AS s, text AS original, CASE WHEN seq % 5 = 0 THEN '' ELSE 'T' || seq || ':' || left(text, 20) END AS translated FROM lines WHERE seq % 2 = 0"


@query(
    sql(
        f""", m AS ({_MEMORY}), k AS (SELECT {_strip('original')} AS key, arg_max(translated, s) AS known FROM m GROUP BY 1)
        SELECT doc_id, seq, coalesce(nullif(known, ''), text) AS translated FROM lines LEFT JOIN k ON k.key = {_strip('text')}""",
        "lines",
    )
)
def j2_memory_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.lines(spark, sf_dir)
    known = F.when(F.col("seq") % 5 == 0, "").otherwise(F.concat(F.lit("T"), F.col("seq").cast("string"), F.lit(":"), F.left("text", F.lit(20))))
    memory = rows.where("seq % 2 = 0").select((F.col("doc_id") * 100000 + F.col("seq")).alias("seq"), F.col("text").alias("original"), known.alias("translated"))
    return workspace.memory_lookup(rows, memory).select("doc_id", F.col("seq").cast("long").alias("seq"), "translated")


@query(sql("SELECT doc_id, seq, CASE WHEN seq % 4 = 0 THEN 'edit ' || seq ELSE text END AS translated FROM lines", "lines"))
def j3_positional_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.lines(spark, sf_dir)
    edit = F.when(F.col("seq") % 4 == 0, F.concat(F.lit("edit "), F.col("seq").cast("string"))).otherwise("  ")
    done = workspace.positional_overlay(rows, rows.select("doc_id", "seq", edit.alias("translated")))
    return done.select("doc_id", F.col("seq").cast("long").alias("seq"), "translated")


@query(sql("SELECT doc_id, block_id FROM blocks WHERE seq % 3 <> 0", "blocks"))
def j4_pending_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.blocks(spark, sf_dir)
    return workspace.pending_after(rows, rows.where("seq % 3 = 0")).select("doc_id", "block_id")


_RETRY = "SELECT * FROM pairs p WHERE retry_count < 2 AND EXISTS (FROM issues i WHERE i.doc_id = p.doc_id AND i.block_id = p.block_id AND severity = 'high')"


@query(sql(f"SELECT doc_id, block_id, retry_count FROM ({_RETRY})", "pairs", "issues"))
def j5_retry_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace.retry_set(inputs.pairs(spark, sf_dir), inputs.issues(spark, sf_dir)).select("doc_id", "block_id", "retry_count")


@query(sql("""SELECT doc_id, block_id, CASE WHEN seq % 5 = 0 THEN 'PreserveLayout' ELSE coalesce("constraint", 'ExpandAllowed') END AS "constraint" FROM blocks""", "blocks"))
def j6_attach_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.blocks(spark, sf_dir)
    plan = rows.where("seq % 5 = 0").select("doc_id", "block_id", F.lit("PreserveLayout").alias("constraint"))
    return workspace.attach_constraints(rows, plan).select("doc_id", "block_id", "constraint")


@query(
    sql(
        """, e AS (SELECT lower(source) AS key, arg_max({'s': source, 't': target}, seq) AS v FROM incoming WHERE source <> '' AND target <> '' GROUP BY 1),
        x AS (SELECT lower(source) AS key, {'s': source, 't': target} AS v FROM termbase)
        SELECT coalesce(x.v, e.v).s AS source, coalesce(x.v, e.v).t AS target, x.v IS NOT NULL AS confirmed FROM e FULL JOIN x USING (key)""",
        "incoming", "termbase",
    )
)
def j7_merge_plan_glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    mined = inputs.incoming(spark, sf_dir).select(F.col("seq").alias("ord"), "source", "target")
    known = inputs.termbase(spark, sf_dir).select(F.col("id").alias("ord"), "source", "target")
    return workspace.merge_plan_glossary(mined, known)


@query(
    sql(
        f", r AS ({_RETRY}) SELECT p.doc_id, p.block_id, CASE WHEN r.doc_id IS NOT NULL THEN {sql_apply_terms('p.original')} ELSE p.translated END AS translated, "
        "p.retry_count + (r.doc_id IS NOT NULL)::INTEGER AS retry_count FROM pairs p LEFT JOIN r ON r.doc_id = p.doc_id AND r.block_id = p.block_id",
        "pairs", "issues",
    )
)
def j9_overlay_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.pairs(spark, sf_dir)
    again = workspace.retry_set(rows, inputs.issues(spark, sf_dir)).withColumn("translated", text.apply_terms(F.col("original"), inputs.GLOSSARY))
    return workspace.overlay_retry(rows, again).select("doc_id", "block_id", "translated", "retry_count")


# Termbase

_MERGE = """, v AS (SELECT seq, source, target, confirmed, lower(source) AS ks, coalesce(nullif(source_lang, ''), 'Auto') AS sl, coalesce(nullif(target_lang, ''), '中文 (简体)') AS tl,
            coalesce(nullif(domain, ''), 'general') AS dm FROM incoming WHERE source <> target),
        n AS (SELECT ks, sl, tl, dm, count(*) AS n, arg_max({'s': source, 't': target}, seq) AS last, arg_max(confirmed, seq) FILTER (WHERE confirmed IS NOT NULL) AS flag FROM v GROUP BY ALL),
        merged AS (SELECT CASE WHEN n IS NULL THEN source ELSE last.s END AS source, CASE WHEN n IS NULL THEN target ELSE last.t END AS target, coalesce(sl, source_lang) AS source_lang,
            coalesce(dm, domain) AS domain, (coalesce(frequency, 0) + coalesce(n, 0))::BIGINT AS frequency, CASE WHEN n IS NULL THEN confirmed ELSE coalesce(flag, confirmed, false) END AS confirmed,
            CASE WHEN n IS NULL THEN 'kept' WHEN id IS NULL THEN 'imported' ELSE 'updated' END AS change, coalesce(n, 0) AS rows_in
            FROM termbase FULL JOIN n ON lower(source) = ks AND source_lang = sl AND target_lang = tl AND domain = dm)"""


@query(sql(f"{_MERGE} SELECT source, target, source_lang, domain, frequency, confirmed, change FROM merged", "incoming", "termbase"))
def t1_merge_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = terms.merge_terms(inputs.termbase(spark, sf_dir), inputs.incoming(spark, sf_dir))
    return merged.select("source", "target", "source_lang", "domain", "frequency", "confirmed", "change")


@query(
    sql(
        f"{_MERGE} SELECT count(*) FILTER (WHERE change = 'imported') AS imported, (sum(rows_in) - count(*) FILTER (WHERE change = 'imported'))::BIGINT AS updated, "
        "((SELECT count(*) FROM incoming) - sum(rows_in))::BIGINT AS skipped FROM merged",
        "incoming", "termbase",
    )
)
def t2_merge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.incoming(spark, sf_dir)
    return terms.merge_counts(terms.merge_terms(inputs.termbase(spark, sf_dir), rows), rows)


_ENTRIES = "SELECT seq, NULL AS id, word AS source, reverse(word) AS target, CASE WHEN length(word) % 3 = 0 THEN 'en' ELSE 'Auto' END AS source_lang, '中文 (简体)' AS target_lang, CASE WHEN length(word) % 2 = 0 THEN 'words' ELSE 'general' END AS domain, confirmed FROM incoming"


@query(
    sql(
        f""", e AS ({_ENTRIES}), n AS (SELECT source AS s, target AS t, source_lang AS sl, domain AS dm, count(*) AS n, bool_or(coalesce(confirmed, false)) AS c,
            arg_min({{'c': confirmed}}, seq).c AS first FROM e GROUP BY ALL)
        SELECT coalesce(source, s) AS source, coalesce(target, t) AS target, coalesce(source_lang, sl) AS source_lang, coalesce(domain, dm) AS domain,
            (CASE WHEN id IS NULL THEN n ELSE frequency + coalesce(n, 0) END)::BIGINT AS frequency,
            CASE WHEN id IS NULL THEN coalesce(first, false) OR c ELSE confirmed OR coalesce(c, false) END AS confirmed, CASE WHEN id IS NULL THEN 'imported' ELSE 'kept' END AS change,
            (CASE WHEN id IS NULL THEN n - 1 ELSE coalesce(n, 0) END)::BIGINT AS rows_skipped
        FROM termbase FULL JOIN n ON lower(source) = s AND lower(target) = t AND source_lang = sl AND domain = dm""",
        "incoming", "termbase",
    )
)
def t3_import_terms_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("word")
    entries = inputs.incoming(spark, sf_dir).select(
        "seq", F.lit(None).cast("string").alias("id"), F.col("word").alias("source"), F.reverse("word").alias("target"), F.when(n % 3 == 0, "en").otherwise("Auto").alias("source_lang"),
        F.lit("中文 (简体)").alias("target_lang"), F.when(n % 2 == 0, "words").otherwise("general").alias("domain"), F.lit(None).cast("long").alias("frequency"), "confirmed",
    )
    merged = terms.import_terms_json(inputs.termbase(spark, sf_dir), entries)
    return merged.select("source", "target", "source_lang", "domain", "frequency", "confirmed", "change", "rows_skipped")


@query(sql(f"{_MERGE} SELECT source, target, domain, frequency FROM merged WHERE change <> 'kept'", "incoming", "termbase"))
def t4_import_terms_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = terms.merge_terms(inputs.termbase(spark, sf_dir), inputs.incoming(spark, sf_dir))
    return merged.where("change <> 'kept'").select("source", "target", "domain", "frequency")


@query(
    sql(
        """SELECT count(*) AS total, count(*) FILTER (WHERE confirmed) AS confirmed, string_agg(DISTINCT domain, ',' ORDER BY domain) AS domains,
        string_agg(DISTINCT source_lang || '→' || target_lang, ',' ORDER BY source_lang || '→' || target_lang) AS lang_pairs FROM termbase""",
        "termbase",
    )
)
def t5_termbase_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.termbase_stats(inputs.termbase(spark, sf_dir))


def _edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of bitext: one word in the middle of a reply replaced, or several."""
    rows = inputs.pairs(spark, sf_dir)
    words = F.split("translated", " ")
    at = F.floor(F.size(words) / 2)
    new = F.transform(words, lambda w, i: F.when((i == at) | ((F.col("seq") % 3 == 0) & (i == at + 2)), F.concat(w, F.lit("x"))).otherwise(w))
    return rows.select("doc_id", "block_id", F.col("original").alias("source_text"), F.col("translated").alias("before_text"), F.array_join(new, " ").alias("after_text"))


@query()
def t6_learn_from_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = edits.term_candidates(_edits(spark, sf_dir))
    return terms.learn_from_edits(found, inputs.termbase(spark, sf_dir)).where("change <> 'kept'").select("source", "target", "domain", "frequency", "confirmed", "change")


@query(
    sql(
        r"""SELECT term, count(*) AS frequency FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^\p{L}]+')) AS term FROM lines) WHERE term <> '' AND term NOT IN (SELECT source FROM glossary)
        GROUP BY term HAVING count(*) >= 3""",
        "lines", "glossary",
    )
)
def t7_mine_frequent_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    stop = inputs.glossary(spark).select(F.col("source").alias("term"))
    return terms.mine_frequent_terms(inputs.lines(spark, sf_dir), stop)


_LINES_WORDS = r"SELECT regexp_extract_all(s, '[\p{L}\p{M}]+') AS w FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\s]+')) AS s FROM lines)"


@query(
    sql(
        f""", w AS ({_LINES_WORDS}), g AS (SELECT array_to_string(w[k : k + n - 1], ' ') AS gram, n FROM (SELECT w, n, unnest(range(1, len(w) - n + 2)) AS k FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS n) WHERE len(w) >= n)),
        f AS (SELECT gram, n AS words, count(*) AS frequency FROM g GROUP BY ALL HAVING count(*) >= 3 AND split_part(gram, ' ', 1) NOT IN (SELECT source FROM glossary) AND split_part(gram, ' ', -1) NOT IN (SELECT source FROM glossary)),
        p AS (SELECT string_split(gram, ' ') AS l, words FROM f),
        i AS (SELECT DISTINCT array_to_string(l[k : k + n - 1], ' ') AS gram FROM (SELECT l, words, n, unnest(range(1, words - n + 2)) AS k FROM p, (SELECT unnest([1, 2, 3, 4]) AS n) WHERE n < words))
        SELECT gram AS term, words, frequency FROM f WHERE gram NOT IN (SELECT gram FROM i)""",
        "lines", "glossary",
    )
)
def t7_mine_frequent_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    stop = inputs.glossary(spark).select(F.col("source").alias("term"))
    return terms.mine_frequent_phrases(inputs.lines(spark, sf_dir), stop)


# Aggregates


@query(
    sql(
        """SELECT doc_id, count(*) AS total, count(*) FILTER (WHERE severity = 'high') AS high_count, count(*) FILTER (WHERE severity = 'medium') AS medium_count,
        count(*) FILTER (WHERE severity = 'low') AS low_count, count(*) FILTER (WHERE severity = 'low') AS patches FROM issues GROUP BY doc_id""",
        "issues",
    )
)
def a1_issue_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.issue_summary(inputs.issues(spark, sf_dir))


@query(
    sql(
        """SELECT doc_id, block_id, count(*) AS issues, ['low', 'medium', 'high'][max(list_position(['low', 'medium', 'high'], severity))] AS severity FROM issues GROUP BY ALL""",
        "issues",
    )
)
def a2_badge_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.badges(inputs.issues(spark, sf_dir))


@query(
    sql("SELECT doc_id, count(*) AS total, count(*) FILTER (WHERE status IN ('done', 'edited')) AS done, round(100.0 * count(*) FILTER (WHERE status IN ('done', 'edited')) / greatest(count(*), 1))::BIGINT AS percent FROM ev GROUP BY doc_id", "ev")
)
def a3_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace.completion(inputs.events(spark, sf_dir))


@query(
    sql(
        """, t AS (SELECT doc_id, count(*) AS total, count(*) FILTER (WHERE type = 'block_completed') AS completed FROM ev GROUP BY doc_id)
        SELECT doc_id, total, completed, round(100.0 * completed / greatest(total, 1))::BIGINT AS percent FROM t""",
        "ev",
    )
)
def a4_task_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.events(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("total_blocks"), F.count_if(F.col("type") == "block_completed").alias("completed_blocks"))
    return workspace.task_progress(rows)


_INLINE = ("b", "i", "em", "strong", "a", "span")


def _count_list(column: str, pattern: str) -> str:
    return "[" + ", ".join(f"len(regexp_extract_all({column}, '(?is){pattern.format(t)}'))" for t in _INLINE) + "]"


#: Pairs of the source, leftmost first and not nested, by name.
_PAIRED = "list_transform(regexp_extract_all(original, '(?is)" + "|".join(rf"<{t}\b[^>]*?>.*?</{t}>" for t in _INLINE) + "'), lambda x: lower(regexp_extract(x, '^<([A-Za-z]+)', 1)))"
_BALANCE = (
    rf"b AS (SELECT *, {_count_list('translated', r'<{}\b[^>]*>')} AS opens, {_count_list('translated', '</{}>')} AS closes, "
    f"list_transform({list(_INLINE)}, lambda t: len(list_filter({_PAIRED}, lambda x: x = t))) AS src FROM tagged)"
)
_BROKEN = "list_sum(src) > 0 AND len(list_filter(range(1, 7), lambda i: opens[i] <> closes[i] OR (src[i] > 0 AND opens[i] <> src[i]))) > 0"


@query(sql(f", {_BALANCE} SELECT doc_id, seq, array_to_string(opens, ',') AS opens, array_to_string(closes, ',') AS closes, array_to_string(src, ',') AS source_tags, {_BROKEN} AS broken FROM b", "tagged"))
def a5_tag_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = checks.tag_balance(inputs.tagged(spark, sf_dir))
    return rows.select("doc_id", F.col("seq").cast("long").alias("seq"), *(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("opens", "closes", "source_tags")), "broken")


# Windows


@query(
    sql(
        """SELECT doc_id, seq, len(c) AS n_context, md5(array_to_string(c, chr(10))) AS context_md5 FROM (SELECT doc_id, seq,
        list(left(original, 150) || chr(9) || left(translated, 150)) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS c FROM pairs) WHERE c IS NOT NULL""",
        "pairs",
    )
)
def w1_context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = workspace.context_window(inputs.pairs(spark, sf_dir)).where(F.size("context") > 0)
    joined = F.array_join(F.transform("context", lambda x: F.concat(x["original"], F.lit("\t"), x["translated"])), "\n")
    return rows.select("doc_id", "seq", F.size("context").cast("long").alias("n_context"), _md5(joined).alias("context_md5"))


_SPAN_ORDER = "PARTITION BY doc_id, page ORDER BY y0, x0, span_id"
_SPAN_LINES = f"sl AS (SELECT *, (sum(s) OVER ({_SPAN_ORDER}))::BIGINT AS line FROM (SELECT *, CASE WHEN abs(y0 - lag(y0) OVER w) >= 1.2 * greatest(lag(size) OVER w, 6.0) THEN 1 ELSE 0 END AS s FROM spans WINDOW w AS ({_SPAN_ORDER})))"


@query(sql(f", {_SPAN_LINES} SELECT doc_id, span_id, line FROM sl", "spans"))
def w2_group_spans_by_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.group_spans_by_line(inputs.spans(spark, sf_dir)).select("doc_id", "span_id", "line")


@query(sql(f", {_SPAN_LINES} SELECT span_id, doc_id, line, row_number() OVER ({_SPAN_ORDER}) AS place FROM sl", "spans"))
def w2_l4_long_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = layout.group_spans_by_line(inputs.spans(spark, sf_dir), long=True)
    return layout.reading_order(lines, long=True).select("doc_id", "span_id", "line", "place")


@query(sql("SELECT doc_id, seq, (row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1) // 20 AS batch, 'block-' || seq AS block_id FROM lines", "lines"))
def w3_w7_long_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = workspace.chunk(inputs.lines(spark, sf_dir), 20, long=True)
    return scans.number_blocks(rows, long=True).select("doc_id", F.col("seq").cast("long").alias("seq"), "batch", "block_id")


@query(sql("SELECT doc_id, seq, (row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1) // 20 AS batch FROM lines", "lines"))
def w3_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace.chunk(inputs.lines(spark, sf_dir), 20).select("doc_id", F.col("seq").cast("long").alias("seq"), "batch")


@query(
    sql(
        """, c AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id), k AS (SELECT *, least(6, greatest(1, ceil(n / 20)))::BIGINT AS w FROM c),
        r AS (SELECT doc_id, n, unnest(range(w)) AS worker_index, ceil(n / w)::BIGINT AS span FROM k)
        SELECT doc_id, worker_index, worker_index * span AS start_index, least((worker_index + 1) * span, n) AS end_index, least((worker_index + 1) * span, n) - worker_index * span AS item_count
        FROM r WHERE worker_index * span < n""",
        "words",
    )
)
def w4_allocate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace.allocate(inputs.words(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")))


@query(
    sql(
        """, s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS p, count(*) OVER (PARTITION BY doc_id) AS n FROM pairs)
        SELECT doc_id, block_id, left(original, 200) AS original, left(translated, 200) AS translated FROM s WHERE p <= 30 AND (n <= 50 OR doc_id IN (SELECT doc_id FROM issues WHERE severity = 'high'))""",
        "pairs", "issues",
    )
)
def w6_deep_check_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = workspace.deep_check_sample(inputs.pairs(spark, sf_dir), inputs.issues(spark, sf_dir))
    return rows.select("doc_id", "block_id", "original", "translated")


@query(sql("SELECT doc_id, 'block-' || seq AS block_id, 'body/p[' || seq || ']' AS dom_path, 'paragraph' AS node_type FROM lines", "lines"))
def w7_number_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.number_blocks(inputs.lines(spark, sf_dir)).select("doc_id", "block_id", "dom_path", "node_type")


# Sort, limit, sets


@query(sql("SELECT id, frequency, confirmed FROM termbase WHERE source_lang = 'en' ORDER BY confirmed DESC, frequency DESC, id LIMIT 80", "termbase"))
def l1_prompt_glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.prompt_glossary(inputs.termbase(spark, sf_dir), "en", "中文 (简体)").select("id", "frequency", "confirmed")


@query(sql("SELECT id, frequency, confirmed FROM termbase ORDER BY confirmed DESC, frequency DESC, id LIMIT 120", "termbase"))
def l2_active_glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.active_glossary(inputs.termbase(spark, sf_dir), "Auto", "中文 (简体)").select("id", "frequency", "confirmed")


@query(
    sql(
        "SELECT doc_id, seq, string_agg(source, ',' ORDER BY -length(source), ord) AS terms FROM lines, glossary WHERE source <> '' AND target <> '' AND contains(lower(text), lower(source)) GROUP BY ALL",
        "lines", "glossary",
    )
)
def l3_longest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = match.relevant_glossary(inputs.lines(spark, sf_dir), inputs.glossary(spark).where("target <> ''"))
    rank = F.create_map(*(F.lit(x) for i, (s, _) in enumerate(inputs.GLOSSARY) for x in (s, i)))
    entries = F.array_sort(F.collect_list(F.struct((-F.length("source")).alias("n"), rank[F.col("source")].alias("ord"), "source")))
    return hits.groupBy("doc_id", F.col("seq").cast("long").alias("seq")).agg(F.array_join(F.transform(entries, lambda e: e["source"]), ",").alias("terms"))


@query(sql(f"SELECT doc_id, span_id, row_number() OVER ({_SPAN_ORDER}) AS place FROM spans", "spans"))
def l4_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.reading_order(inputs.spans(spark, sf_dir)).select("doc_id", "span_id", F.col("place").cast("long").alias("place"))


@query(
    sql(
        "SELECT doc_id, min(n) AS total_blocks, md5(string_agg('[block-' || seq || '] (' || node_type || '): ' || left(text, 300), chr(10) || chr(10) ORDER BY seq)) AS samples_md5 FROM "
        "(SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS p FROM blocks) WHERE p <= 20 GROUP BY doc_id",
        "blocks",
    )
)
def l6_planner_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _planner(spark, sf_dir).select("doc_id", "total_blocks", _md5("samples").alias("samples_md5"))


@query(sql("SELECT source, target, 0 AS part FROM glossary UNION ALL SELECT source, target, 1 FROM termbase", "glossary", "termbase"))
def u1_extend_glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = inputs.termbase(spark, sf_dir).select(F.col("frequency").alias("ord"), "source", "target")
    return workspace.extend_glossary(inputs.glossary(spark), known).select("source", "target", "part")


@query(
    sql(
        f", r AS ({_RETRY}) SELECT i.doc_id, i.block_id, i.type, i.severity FROM issues i WHERE NOT EXISTS (FROM r WHERE r.doc_id = i.doc_id AND r.block_id = i.block_id) "
        "UNION ALL SELECT r.doc_id, r.block_id, 'recheck', 'low' FROM r",
        "pairs", "issues",
    )
)
def u2_merge_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.issues(spark, sf_dir).select("doc_id", "block_id", "type", "severity")
    retry = workspace.retry_set(inputs.pairs(spark, sf_dir), rows)
    return workspace.merge_issues(rows, retry, retry.select("doc_id", "block_id", F.lit("recheck").alias("type"), F.lit("low").alias("severity")))


@query(sql("SELECT DISTINCT source_lang, domain FROM termbase", "termbase"))
def u3_distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace.distinct_values(inputs.termbase(spark, sf_dir), "source_lang", "domain")


# Functions


@query(
    sql(
        rf"SELECT doc_id, seq, trim(regexp_replace(text, '{_WS}+', ' ', 'g')) AS term, CASE WHEN regexp_matches(text, '[一-鿿]') THEN 'zh-CN' WHEN regexp_matches(text, '[぀-ヿ]') THEN 'ja' "
        "WHEN regexp_matches(text, '[가-힯]') THEN 'ko' WHEN regexp_matches(text, '[؀-ۿ]') THEN 'ar' WHEN regexp_matches(text, '[Ѐ-ӿ]') THEN 'ru' WHEN regexp_matches(text, '[A-Za-z]') THEN 'en' ELSE 'Auto' END AS lang FROM lines",
        "lines",
    )
)
def f1_f2_normalize_and_detect_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.lines(spark, sf_dir)
    return rows.select("doc_id", F.col("seq").cast("long").alias("seq"), text.normalize_term(F.col("text")).alias("term"), text.detect_term_lang(F.col("text")).alias("lang"))


@query(
    sql(
        rf"""SELECT word, CASE WHEN regexp_matches(t, '^[a-zA-ZÀ-ſ{_WS[1:-1]}\-]+$') THEN 'fr' ELSE 'Auto' END AS lang FROM (SELECT DISTINCT raw AS word, raw AS t FROM
        (SELECT unnest(string_split(text, ' ')) AS raw FROM lines))""",
        "lines",
    )
)
def f3_detect_text_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.lines(spark, sf_dir).select(F.explode(F.split("text", " ")).alias("word")).distinct()
    return rows.select("word", text.detect_text_lang(F.col("word")).alias("lang"))


@query(
    """SELECT doc_id, CASE WHEN lang = 'en' THEN 'en' ELSE lang END AS code, CASE doc_id % 3 WHEN 0 THEN 'zh' WHEN 1 THEN 'ja' ELSE 'en' END AS from_name FROM documents"""
)
def f4_normalize_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    name = F.when(F.col("doc_id") % 3 == 0, " Chinese (Simplified) ").when(F.col("doc_id") % 3 == 1, "Japanese").otherwise("AUTO")
    return docs.select("doc_id", text.normalize_lang(F.upper("lang")).alias("code"), text.normalize_lang(name).alias("from_name"))


_NAMED = "['English', ' chinese (Traditional) ', 'JAPANESE', 'ko', ' Auto ', '', 'Klingon ', upper(lang)][doc_id % 8 + 1]"


@query(
    f"""WITH n AS (SELECT doc_id, {_NAMED} AS name, lower(trim({_NAMED})) AS t FROM documents)
    SELECT doc_id, CASE WHEN t IN ('english', 'en', 'auto') THEN 'en' WHEN t IN ('chinese', 'chinese (simplified)', 'chinese (traditional)', 'zh') THEN 'zh' WHEN t IN ('japanese', 'ja') THEN 'ja' WHEN t IN ('korean', 'ko') THEN 'ko' ELSE name END AS code FROM n"""
)
def f4_normalize_lang_as_is(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*(F.lit(x) for x in ("English", " chinese (Traditional) ", "JAPANESE", "ko", " Auto ", "", "Klingon ")), F.upper("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize_lang(F.element_at(names, (F.col("doc_id") % 8 + 1).cast("int")), lower_unknown=False).alias("code"))



@query(sql(f"SELECT doc_id, seq, {sql_apply_terms('text')} AS text FROM lines", "lines"))
def f5_apply_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.lines(spark, sf_dir).select("doc_id", F.col("seq").cast("long").alias("seq"), text.apply_terms(F.col("text"), inputs.GLOSSARY).alias("text"))


def _sql_fix(x: str) -> str:
    return f"replace(replace(replace({x}, '代理', '智能体'), '特工', '智能体'), '智能体智能体', '智能体')"


def _sql_replace(x: str, pairs: list[tuple[str, str]]) -> str:
    for s, t in pairs:
        x = f"replace({x}, {sql_quote(s)}, {sql_quote(t)})"
    return x


_HAN_TERMS = [("the", "代理"), ("tion", "智能体"), ("AI", "人工智能"), ("ouer", "特工"), ("and", "和")]


@query()
def f5_apply_glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The termbase, of any size, on every line."""
    glossary = inputs.termbase(spark, sf_dir).select(F.col("id").alias("ord"), "source", "target")
    return glossary_pass.apply_glossary(inputs.lines(spark, sf_dir), glossary).select("doc_id", F.col("seq").cast("long").alias("seq"), "translated")


@query(
    sql(
        f"""SELECT doc_id, seq, CASE WHEN seq % 2 = 0 THEN {_sql_fix(_sql_replace("text || '智能'", [t for t in text.longest_first(_HAN_TERMS) if t[0] != 'AI']))} ELSE text END AS han,
        {_strip(_sql_fix(_sql_replace('text', [t for t in _HAN_TERMS if len(t[0]) > 3])))} AS full_terms FROM lines""",
        "lines",
    )
)
def f6_f7_fix_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.lines(spark, sf_dir)
    han = F.when(F.col("seq") % 2 == 0, F.concat("text", F.lit("智能"))).otherwise(F.col("text"))
    return rows.select("doc_id", F.col("seq").cast("long").alias("seq"), text.fix_han_terms(han, _HAN_TERMS).alias("han"), text.fix_full_terms(F.col("text"), _HAN_TERMS).alias("full_terms"))


_NOTES = "CASE seq % 4 WHEN 0 THEN text || '（此段落已准确翻译，谢谢）' WHEN 1 THEN '[' || seq || '] Source: x' || chr(10) || ' Translation: ' || text WHEN 2 THEN '无需修改' ELSE text END"


_SQL_META = r"regexp_replace(t, '[\(（]\s*此段落已(?:准确)?翻译[^\)）]*[\)）]|无需修改|已准确翻译', '', 'g')"
_SQL_LEAKED = r"regexp_extract(cleaned, '(?is)^\[[0-9]+\]\s*Source:\s*.*?\n\s*Translation:\s*(.*)$', 1)"


@query(
    sql(
        f""", n AS (SELECT doc_id, seq, {_NOTES} AS t FROM lines), c AS (SELECT *, {_strip(_SQL_META)} AS cleaned FROM n)
        SELECT doc_id, seq, coalesce(nullif({_strip(_SQL_LEAKED)}, ''), nullif(cleaned, ''), t) AS text FROM c""",
        "lines",
    )
)
def f8_strip_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("seq") % 4
    noted = F.when(n == 0, F.concat("text", F.lit("（此段落已准确翻译，谢谢）")))
    noted = noted.when(n == 1, F.concat(F.lit("["), F.col("seq").cast("string"), F.lit("] Source: x\n Translation: "), "text")).when(n == 2, "无需修改").otherwise(F.col("text"))
    return inputs.lines(spark, sf_dir).select("doc_id", F.col("seq").cast("long").alias("seq"), text.strip_meta(noted).alias("text"))


@query(sql(f"SELECT doc_id, seq, {_strip('text')} AS plain, {_strip('text')} AS quoted FROM lines", "lines"))
def f9_strip_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    fenced = F.concat(F.lit("```json\n"), "text", F.lit("\n```"))
    quoted = F.concat(F.lit('```\n"'), text.strip_fences(F.col("text")), F.lit('"\n```'))
    return inputs.lines(spark, sf_dir).select("doc_id", F.col("seq").cast("long").alias("seq"), text.strip_fences(fenced).alias("plain"), text.strip_fences(quoted, quotes=True).alias("quoted"))


@query(sql(f"SELECT doc_id, seq, CASE seq % 3 WHEN 0 THEN text WHEN 1 THEN text ELSE CASE WHEN {_strip(_MARKED)} = '' THEN text ELSE {_strip(_MARKED)} END END AS text FROM lines", "lines"))
def f10_refusal_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("seq") % 3
    reply = F.when(n == 0, "  ").when(n == 1, F.concat(F.lit("Please provide the text. "), "text")).otherwise(F.concat(F.lit("U"), "text"))
    return inputs.lines(spark, sf_dir).select("doc_id", F.col("seq").cast("long").alias("seq"), text.refusal_fallback(reply, F.col("text")).alias("text"))


@query()
def f11_clean_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit(" "), F.lit(" ")).alias("text"))
    return python_text.clean_extracted(rows).select("doc_id", F.length("text").alias("n_chars"), _md5("text").alias("text_md5"))


_SQL_TAGS = (
    r"</?[a-zA-Z][a-zA-Z0-9]*(?:\s+[^>]*)?/?>", r'<span\s+data-jo-id="[^"]*"[^>]*>.*?</span>', r"\*\*[^*]+\*\*|\*[^*]+\*|`[^`]+`|\[[^\]]+\]\([^)]+\)", r"\{\$[^$]+\$?\}|\{\{[^}]+\}\}",
)
_ALL_TAGS = "list_concat(list_concat(" + "), list_concat(".join(", ".join(f"regexp_extract_all({{0}}, '{p}')" for p in pair) for pair in (_SQL_TAGS[:2], _SQL_TAGS[2:])) + "))"


@query(sql(f"SELECT doc_id, seq, array_to_string(list_sort(list_distinct({_ALL_TAGS.replace('{0}', 'text')})), chr(10)) AS tags FROM html_blocks", "html_blocks"))
def f12_preserved_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.array_join(F.array_sort(text.preserved_tags(F.col("text"))), "\n")
    return inputs.html_blocks(spark, sf_dir).select("doc_id", F.col("seq").cast("long").alias("seq"), tags.alias("tags"))


_ESCAPED = _XML.format("text")


@query(sql(f"SELECT doc_id, seq, {_strip("regexp_replace(text, '<[^>]*>', '', 'g')")} AS plain, {_ESCAPED} AS escaped FROM html_blocks", "html_blocks"))
def f13_f14_strip_and_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.html_blocks(spark, sf_dir)
    return rows.select("doc_id", F.col("seq").cast("long").alias("seq"), text.strip_html(F.col("text")).alias("plain"), text.escape_xml(F.col("text")).alias("escaped"))


_FULL, _NARROW, _WIDE = (f"len(regexp_extract_all(text, '{p}'))" for p in (r"[一-鿿\x{3000}-\x{303f}\x{ff00}-\x{ffef}]", "[ilI.,;:|!]", "[mwMW@]"))
_WIDTH = f"({_FULL} + 0.3::DOUBLE * {_NARROW} + 0.7::DOUBLE * {_WIDE} + 0.52::DOUBLE * (length(text) - {_FULL} - {_NARROW} - {_WIDE}))"


@query(sql(f"SELECT doc_id, span_id, round({_WIDTH} * size, 6) AS width, round(CASE WHEN {_WIDTH} * size > 35 THEN size * greatest(0.6, 35 / ({_WIDTH} * size)) ELSE size END, 6) AS font FROM spans", "spans"))
def f15_f16_width_and_font(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.spans(spark, sf_dir)
    font = text.fit_font(F.col("text"), F.col("size"), F.col("x1") - F.col("x0"))
    return rows.select("doc_id", "span_id", F.round(text.text_width(F.col("text"), F.col("size")), 6).alias("width"), F.round(font, 6).alias("font"))


@query(
    sql(
        f"SELECT doc_id, page, count(*) AS spans, count(*) FILTER (WHERE f < 1) AS shrunk, min(f) AS least_factor FROM (SELECT doc_id, page, round(CASE WHEN {_WIDTH} * size > 35 THEN greatest(0.6, 35 / ({_WIDTH} * size)) ELSE 1 END, 6) AS f FROM spans) GROUP BY ALL",
        "spans",
    )
)
def f16_layout_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.layout_audit(inputs.spans(spark, sf_dir))


@query()
def f17_repair_inline_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = python_text.repair_tags(checks.tag_balance(inputs.tagged(spark, sf_dir)))
    return rows.select("doc_id", F.col("seq").cast("long").alias("seq"), "broken", _md5("translated").alias("translated_md5"))


_CONFIDENCE = """round(CASE WHEN original = '' THEN 0.5 WHEN original = translated THEN 0.6
        WHEN "constraint" = 'Concise' THEN CASE WHEN r <= 1.2 THEN 0.85 ELSE greatest(0.3, 0.85 - (r - 1.2) * 0.5) END
        WHEN "constraint" = 'PreserveLayout' THEN CASE WHEN len(string_split(original, chr(10))) = len(string_split(translated, chr(10))) THEN 0.85 ELSE 0.5 END
        WHEN r >= 0.2 AND r <= 2 THEN 0.8 ELSE 0.4 END::DOUBLE, 6)"""


@query(sql(f"SELECT doc_id, seq, {_CONFIDENCE} AS confidence FROM pairs", "pairs"))
def f18_estimate_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = text.estimate_confidence(F.col("original"), F.col("translated"), F.col("constraint"))
    return inputs.pairs(spark, sf_dir).select("doc_id", "seq", F.round(c.cast("double"), 6).alias("confidence"))


@query(
    sql(
        """SELECT doc_id, block_id, CASE WHEN node_type IN ('code', 'table', 'list') THEN 'PreserveLayout' WHEN node_type IN ('label', 'button', 'caption', 'textbox') OR box_width < 200 THEN 'Concise'
        WHEN "constraint" IS NOT NULL THEN "constraint" ELSE 'ExpandAllowed' END AS "constraint" FROM blocks""",
        "blocks",
    )
)
def f19_classify_constraint(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = text.classify_constraint(F.col("node_type"), F.col("box_width"), F.col("constraint"))
    return inputs.blocks(spark, sf_dir).select("doc_id", "block_id", c.alias("constraint"))


@query(
    "SELECT doc_id, CASE lang "
    f"WHEN 'en' THEN {sql_quote(text.STYLE_GUIDES['academic'])} WHEN 'de' THEN {sql_quote(text.STYLE_GUIDES['business'])} ELSE {sql_quote(text.STYLE_GUIDES['general'])} END AS style_guide FROM documents"
)
def f20_style_guide(spark: SparkSession, sf_dir: str) -> DataFrame:
    domain = F.when(F.col("lang") == "en", "academic").when(F.col("lang") == "de", "business").otherwise("other")
    return table(spark, sf_dir, "documents").select("doc_id", text.style_guide(domain).alias("style_guide"))


@query(sql("SELECT doc_id, seq, replace(text, 'tion', 'TION') AS translated, CASE WHEN contains(text, 'tion') THEN 'edited' ELSE 'done' END AS status FROM lines", "lines"))
def f23_find_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.lines(spark, sf_dir).select("doc_id", F.col("seq").cast("long").alias("seq"), F.col("text").alias("translated"), F.lit("done").alias("status"))
    return workspace.mark_edited(rows, *text.find_replace(F.col("translated"), "tion", "TION"))


@query(
    sql(
        f""", {_SPAN_LINES}, g AS (SELECT doc_id, page, line, list(text ORDER BY x0, span_id) AS c FROM sl GROUP BY ALL)
        SELECT doc_id, span_id, CASE WHEN length({_strip('text')}) < 10 AND len(c) > 1 AND length(array_to_string(list_filter(c, lambda x: {_strip('x')} <> ''), ' ')) > length({_strip('text')})
        THEN array_to_string(list_filter(c, lambda x: {_strip('x')} <> ''), ' ') ELSE {_strip('text')} END AS text FROM sl JOIN g USING (doc_id, page, line)""",
        "spans",
    )
)
def f24_merge_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = layout.group_spans_by_line(inputs.spans(spark, sf_dir))
    # A line, which may be a whole page, is joined once and not for each of its spans, which come out of its own list again.
    groups = rows.groupBy("doc_id", "page", "line").agg(F.array_sort(F.collect_list(F.struct("x0", "span_id", "text"))).alias("spans"))
    lines = groups.select("doc_id", "spans", text.join_context(F.transform("spans", lambda x: x["text"])).alias("joined"), F.size("spans").alias("size"))
    spans = lines.select("doc_id", "joined", "size", F.explode("spans").alias("s"))
    return spans.select("doc_id", "s.span_id", text.merge_joined(F.col("s.text"), F.col("joined"), F.col("size")).alias("text"))


@query(
    sql(
        rf""", t AS (SELECT doc_id, seq, {_strip("text || ' is important'")} AS t FROM lines)
        SELECT doc_id, seq, coalesce(nullif({_strip("regexp_replace(regexp_replace(t, '[。.!！?？；;，,、].*$', ''), '(?i)(很重要|重要|is important|important)$', '')")}, ''), t) AS tail, left(t, 50) AS short FROM t""",
        "lines",
    )
)
def f25_f26_trim_and_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat("text", F.lit(" is important"))
    return inputs.lines(spark, sf_dir).select("doc_id", F.col("seq").cast("long").alias("seq"), text.trim_tail(t).alias("tail"), text.truncate(F.regexp_replace(t, "^\\s+", ""), 50).alias("short"))


# Requests and replies


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file_name"), F.lit("md").alias("file_type"), F.col("lang").alias("source_lang"),
        F.lit("zh").alias("target_lang"), F.lit("general").alias("domain"),
    )


def _json(x: str) -> str:
    return f"to_json({x})::VARCHAR"


def _json_list(*fields: tuple[str, str], order: str) -> str:
    """Rows of a group as a JSON array of objects with the given names and SQL values."""
    item = " || ',' || ".join(f"{sql_quote(_quoted(name) + ':')} || {_json(value)}" for name, value in fields)
    return f"'[' || string_agg('{{' || {item} || '}}', ',' ORDER BY {order}) || ']'"


def _quoted(name: str) -> str:
    return f'"{name}"'


_TERM_LIST = f"(SELECT {_json_list(('source', 'source'), ('target', 'target'), order='ord')} FROM glossary)"
_PLANNER = f""", s AS (SELECT doc_id, count(*) AS total_blocks, {_json_list(('blockId', 'block_id'), ('text', 'left(text, 200)'), ('nodeType', 'node_type'), order='seq')} AS summaries FROM blocks GROUP BY doc_id),
    f AS (SELECT doc_id, string_agg('[' || block_id || '] (' || node_type || '): ' || left(text, 300), chr(10) || chr(10) ORDER BY seq) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS n FROM blocks) WHERE n <= 20 GROUP BY doc_id),
    p AS (SELECT doc_id, total_blocks, summaries, 'Document: "doc-' || doc_id || '.md" (md)' || chr(10) || 'Source language: ' || lang || chr(10) || 'Target language: zh' || chr(10) || 'Domain: general' || chr(10) || 'Total blocks: '
        || total_blocks || chr(10) || chr(10) || 'Blocks:' || chr(10) || summaries || chr(10) || chr(10) || 'Samples:' || chr(10) || samples || chr(10) || chr(10) || 'Known terms:' || chr(10) || {_TERM_LIST}
        || chr(10) || chr(10) || 'Answer with the plan as JSON: glossary, styleGuide, blockConstraints, estimatedExpansionRatio.' AS prompt FROM documents JOIN s USING (doc_id) JOIN f USING (doc_id))"""


def _planner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.planner_requests(_docs(spark, sf_dir), inputs.blocks(spark, sf_dir), inputs.glossary(spark))


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.pairs(spark, sf_dir).withColumn("style_guide", F.lit(text.STYLE_GUIDES["general"]))


@query(sql(f"{_PLANNER} SELECT doc_id, total_blocks, length(summaries) AS summary_chars, md5(prompt) AS prompt_md5 FROM p", "blocks", "glossary"))
def q1_planner_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _planner(spark, sf_dir).select("doc_id", "total_blocks", F.length("summaries").alias("summary_chars"), _md5("prompt").alias("prompt_md5"))


@query(
    sql(
        """, h AS (SELECT doc_id, seq, count(*) AS n FROM pairs, glossary WHERE source <> '' AND contains(lower(original), lower(source)) GROUP BY ALL)
        SELECT doc_id, seq, coalesce(n, 0) AS n_terms, least(row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1, 3) AS n_context, CASE WHEN "constraint" = 'Concise' THEN 0.15 ELSE 0.3 END AS temperature,
        CASE WHEN "constraint" = 'Concise' THEN ceil(length(original) * 1.5) ELSE 4096 END::BIGINT AS max_tokens FROM pairs LEFT JOIN h USING (doc_id, seq)""",
        "pairs", "glossary",
    )
)
def q2_executor_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = requests.executor_requests(_known(spark, sf_dir), inputs.glossary(spark))
    return rows.select("doc_id", "seq", "n_terms", "n_context", "temperature", "max_tokens")


#: Two targets of one source: the last one counts.
_TWO = (*inputs.GLOSSARY, ("the", "die"), ("of", "aus"))


@query(
    sql(
        f""", two AS (SELECT source, arg_max(target, ord) AS target FROM (VALUES {", ".join(f"({i}, {sql_quote(s)}, {sql_quote(t)})" for i, (s, t) in enumerate(_TWO))}) AS g(ord, source, target) GROUP BY source),
        h AS (SELECT doc_id, seq, count(*) AS n, '{{' || string_agg({_json('source')} || ':' || {_json('target')}, ',' ORDER BY source) || '}}' AS terms FROM pairs, two WHERE source <> '' AND contains(lower(original), lower(source)) GROUP BY ALL)
        SELECT doc_id, seq, coalesce(n, 0) AS n_terms, md5(coalesce('Use exactly these terms:' || chr(10) || terms, 'No glossary terms found in this block.')) AS known_md5 FROM pairs LEFT JOIN h USING (doc_id, seq)""",
        "pairs",
    )
)
def q2_executor_two_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    glossary = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(_TWO)], "ord long, source string, target string")
    rows = requests.executor_requests(_known(spark, sf_dir), glossary)
    known = F.regexp_extract("prompt", r"(?s)\n\n((?:Use exactly these terms:\n|No glossary terms).*?)\n\n", 1)
    return rows.select("doc_id", "seq", "n_terms", _md5(known).alias("known_md5"))


_ADVICE = "CASE \"constraint\" " + " ".join(f"WHEN '{k}' THEN {sql_quote(v)}" for k, v in requests.INSTRUCTIONS.items()) + " END"


@query(
    sql(
        f""", h AS (SELECT doc_id, seq, '{{' || string_agg({_json('source')} || ':' || {_json('target')}, ',' ORDER BY source) || '}}' AS terms FROM pairs, glossary WHERE source <> '' AND contains(lower(original), lower(source)) GROUP BY ALL),
        c AS (SELECT *, list({{'o': left(original, 150), 't': left(translated, 150)}}) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS context FROM pairs),
        l AS (SELECT *, coalesce('Context:' || chr(10) || array_to_string(list_transform(context, lambda x, i: '[' || i || '] Original: ' || x.o || chr(10) || '    Translated: ' || x.t), chr(10) || chr(10)), 'This is the first block. No prior context available.') AS before FROM c)
        SELECT doc_id, seq, md5('Source language: English' || chr(10) || 'Target language: Chinese (Simplified)' || chr(10) || 'Block ID: ' || block_id || chr(10) || 'Constraint: ' || "constraint" || chr(10) || {_ADVICE} || chr(10) || 'Style guide: '
            || {sql_quote(text.STYLE_GUIDES["general"])} || chr(10) || chr(10) || coalesce('Use exactly these terms:' || chr(10) || terms, 'No glossary terms found in this block.') || chr(10) || chr(10) || before || chr(10) || chr(10) || 'Text:' || chr(10) || original
            || chr(10) || chr(10) || 'Answer as JSON: translatedText, preservedTags, confidence.') AS prompt_md5 FROM l LEFT JOIN h USING (doc_id, seq)""",
        "pairs", "glossary",
    )
)
def q2_executor_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.executor_requests(_known(spark, sf_dir), inputs.glossary(spark)).select("doc_id", "seq", _md5("prompt").alias("prompt_md5"))


@query(
    sql(
        f""", s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS place, count(*) OVER (PARTITION BY doc_id) AS n FROM pairs)
        SELECT doc_id, count(*) AS blocks, md5('Review these translations.' || chr(10) || 'Terms:' || chr(10) || {_TERM_LIST} || chr(10) || 'Blocks:' || chr(10)
            || {_json_list(('blockId', 'block_id'), ('original', 'left(original, 200)'), ('translation', 'left(translated, 200)'), order='seq')} || chr(10)
            || 'Answer with a JSON array of issues: blockId, type, description, suggestion, severity.') AS prompt_md5
        FROM s WHERE place <= 30 AND (n <= 50 OR doc_id IN (SELECT doc_id FROM issues WHERE severity = 'high')) GROUP BY doc_id""",
        "pairs", "issues", "glossary",
    )
)
def q3_review_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = workspace.deep_check_sample(inputs.pairs(spark, sf_dir), inputs.issues(spark, sf_dir))
    return requests.review_requests(sample, inputs.glossary(spark)).select("doc_id", "blocks", _md5("prompt").alias("prompt_md5"))


_POLISHED = {**requests.ACTIONS, "formal": f"Rewrite the translation so that it is {requests.STYLES['formal']}."}


@query(
    sql(
        f""" SELECT doc_id, block_id, action, CASE WHEN action = 'fit_to_bbox' THEN 0.15 ELSE 0.3 END AS temperature, CASE WHEN action = 'fit_to_bbox' THEN ceil(length(translated) * 1.2::DOUBLE) ELSE 1024 END::BIGINT AS max_tokens,
        md5(advice || chr(10) || 'Original: ' || original || chr(10) || 'Translation: ' || translated || chr(10) || 'Answer with the new translation only.') AS prompt_md5
        FROM pairs, (VALUES {", ".join(f"({sql_quote(k)}, {sql_quote(v)})" for k, v in _POLISHED.items())}) AS a(action, advice)""",
        "pairs",
    )
)
def q4_polish_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.pairs(spark, sf_dir)
    parts = [requests.polish_requests(rows, a).withColumn("action", F.lit(a)) for a in requests.ACTIONS]
    parts.append(requests.polish_requests(rows, "style", "formal").withColumn("action", F.lit("formal")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("doc_id", "block_id", "action", "temperature", "max_tokens", _md5("prompt").alias("prompt_md5"))


@query(
    sql(
        f""", n AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1) // 20 AS batch, seq, text FROM lines)
        SELECT doc_id, batch, count(*) AS items, md5('{{"paragraphs":[' || string_agg({_json('text')}, ',' ORDER BY seq) || ']}}') AS payload_md5 FROM n GROUP BY ALL""",
        "lines",
    )
)
def q5_batch_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.batch_requests(inputs.lines(spark, sf_dir), inputs.glossary(spark)).select("doc_id", "batch", "items", _md5("payload").alias("payload_md5"))


_KEPT = rf"kept AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY page, span_id) - 1 AS n FROM spans WHERE NOT (length({_strip('text')}) < 2 OR regexp_matches({_strip('text')}, '^{_SYMBOLS}+$')))"


@query(
    sql(
        f", {_KEPT} SELECT doc_id, n // 10 AS batch, string_agg('[' || n % 10 || '] ' || text, chr(10) ORDER BY n) AS prompt, count(*) * 300 AS max_tokens FROM kept GROUP BY ALL", "spans"
    )
)
def q6_numbered_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.numbered_batch(inputs.spans(spark, sf_dir))


@query(
    sql(
        """, s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS place FROM pairs)
        SELECT doc_id, count(*) AS pairs, md5(string_agg('[' || place || '] Source: ' || original || chr(10) || 'Translation: ' || translated, chr(10) || chr(10) ORDER BY place)) AS prompt_md5 FROM s WHERE place <= 30 GROUP BY doc_id""",
        "pairs",
    )
)
def q7_proofread_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.proofread_requests(inputs.pairs(spark, sf_dir)).select("doc_id", "pairs", _md5("prompt").alias("prompt_md5"))


@query(
    sql(
        f""", r AS (SELECT source, target FROM termbase WHERE source_lang = 'en' AND target_lang = '中文 (简体)' ORDER BY confirmed DESC, frequency DESC, id LIMIT 80),
        b AS (SELECT coalesce('Use exactly these terms:' || chr(10) || '{{' || string_agg({_json('source')} || ':' || {_json('target')}, ',' ORDER BY -length(source), source) || '}}', '') AS block FROM r)
        SELECT length(block) AS chars, md5(block) AS block_md5 FROM b""",
        "termbase",
    )
)
def q8_glossary_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = match.prompt_glossary(inputs.termbase(spark, sf_dir), "en", "中文 (简体)")
    return requests.glossary_block(ranked).select(F.length("block").alias("chars"), _md5("block").alias("block_md5"))


def _reply(body: Column) -> Column:
    """A model's reply around a JSON body: fenced, with talk around it, or bare."""
    n = F.col("seq") % 3
    return F.when(n == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(n == 1, F.concat(F.lit("Here it is: "), body, F.lit(" Done."))).otherwise(body)


@query(sql("SELECT doc_id, seq, true AS found FROM pairs", "pairs"))
def e1_extract_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.to_json(F.struct(F.array(F.col("translated")).alias("translations")))
    rows = inputs.pairs(spark, sf_dir)
    return rows.select("doc_id", "seq", F.get_json_object(replies.extract_json(_reply(body), first_opened=True), "$.translations[0]").eqNullSafe(F.col("translated")).alias("found"))


@query(sql("SELECT doc_id, seq, len(string_split(translated, chr(10))) AS items, true AS same FROM pairs", "pairs"))
def e2_translations_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = F.split("translated", "\n")
    name = F.element_at(F.array(*map(F.lit, (*replies.ARRAY_NAMES, "lines"))), (F.col("doc_id") % 5 + 1).cast("int"))
    json = F.when(F.col("seq") % 4 == 3, F.to_json(texts)).otherwise(F.to_json(F.create_map(name, texts)))
    out = replies.translations_array(json, F.array(F.col("original")))
    return inputs.pairs(spark, sf_dir).select("doc_id", "seq", F.size(out).alias("items"), (out == texts).alias("same"))


_BATCHES = "b AS (SELECT doc_id, seq // 5 AS batch, seq % 5 AS pos, text, count(*) OVER (PARTITION BY doc_id, seq // 5) AS n FROM lines)"


@query(
    sql(
        f", {_BATCHES} SELECT doc_id, batch, pos, CASE WHEN batch % 2 = 0 AND 'U' || text <> '' THEN 'U' || text ELSE text END AS translated, batch % 2 = 1 AND n > 1 AS needs_split FROM b", "lines"
    )
)
def e3_align_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.lines(spark, sf_dir).select("doc_id", F.floor(F.col("seq") / 5).alias("batch"), (F.col("seq") % 5).alias("pos"), "text")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: F.concat(F.lit("U"), x["text"]))
    given = rows.groupBy("doc_id", "batch").agg(texts.alias("texts"))
    # Odd batches answer one text short.
    given = given.withColumn("texts", F.when(F.col("batch") % 2 == 1, F.slice("texts", F.lit(1), F.size("texts") - 1)).otherwise(F.col("texts")))
    return replies.align_replies(rows, given).select("doc_id", "batch", F.col("pos").cast("long").alias("pos"), "translated", "needs_split")


_HALVED = """WITH RECURSIVE {head}, r AS (
    SELECT *, 1 AS round, batch::VARCHAR AS part, pos AS place FROM b20 UNION ALL
    SELECT doc_id, batch, pos, text, bad, round + 1, part || '.' || (place >= items // 2)::INTEGER, CASE WHEN place >= items // 2 THEN place - items // 2 ELSE place END
    FROM (SELECT *, count(*) OVER w AS items, bool_or(bad) OVER w AS fails FROM r WINDOW w AS (PARTITION BY doc_id, part, round)) WHERE fails AND items > 1
) SELECT doc_id, batch, pos, CASE WHEN bad THEN text ELSE 'U' || text END AS translated, max(round)::INTEGER AS rounds FROM r GROUP BY ALL"""
_B20 = ", b20 AS (SELECT doc_id, seq // 20 AS batch, seq % 20 AS pos, text, length(text) % 7 = 3 AS bad FROM lines) SELECT 1"


@query(_HALVED.format(head=sql(_B20, "lines").removeprefix("WITH ").removesuffix(" SELECT 1")))
def e3_align_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reply is one text short while its batch holds a text that the model leaves out: failures at every size, down to single texts."""
    rows = inputs.lines(spark, sf_dir).select("doc_id", F.floor(F.col("seq") / 20).alias("batch"), (F.col("seq") % 20).alias("pos"), "text")

    def ask(batches: DataFrame) -> DataFrame:
        texts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
        kept = F.transform(F.filter("texts", lambda t: F.length(t) % 7 != 3), lambda t: F.concat(F.lit("U"), t))
        return batches.groupBy("doc_id", "batch").agg(texts.alias("texts")).withColumn("texts", kept)

    return replies.align_until(rows, ask).select("doc_id", "batch", F.col("pos").cast("long").alias("pos"), "translated", "rounds")


@query(
    sql(f", {_BATCHES} SELECT doc_id, batch, pos AS idx, CASE WHEN pos % 2 = 0 AND {_strip('text')} <> '' THEN {_strip(_MARKED)} ELSE text END AS translated FROM b", "lines")
)
def e4_parse_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.lines(spark, sf_dir).select("doc_id", F.floor(F.col("seq") / 5).alias("batch"), (F.col("seq") % 5).cast("long").alias("idx"), "text")
    line = F.when(F.col("idx") % 2 == 0, F.concat(F.lit("["), F.col("idx").cast("string"), F.lit("] "), F.concat(F.lit("U"), "text"))).otherwise("not numbered")
    given = rows.select("doc_id", "batch", "idx", line.alias("line")).groupBy("doc_id", "batch")
    given = given.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "line"))), lambda x: x["line"]), "\n").alias("reply"))
    return replies.parse_numbered(rows, given).select("doc_id", "batch", "idx", "translated")


@query(sql(f"SELECT doc_id, seq, {_strip('left(original, 20)')} AS source, {_strip('left(translated, 20)')} AS target FROM pairs WHERE seq % 4 <> 3", "pairs"))
def e5_parse_key_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, t = F.left("original", F.lit(20)), F.left("translated", F.lit(20))
    n = F.col("seq") % 4
    empty = F.create_map(F.lit("en"), s)
    entry = F.when(n == 0, F.create_map(F.lit("source"), s, F.lit("target"), t)).when(n == 1, F.create_map(F.lit("english"), s, F.lit("chinese_translation"), t))
    entry = entry.when(n == 2, F.create_map(F.lit("original"), s, F.lit("translated"), t)).otherwise(empty)
    found = replies.parse_key_terms(F.to_json(F.struct(F.array(entry, empty).alias("keyTerms"))))
    return inputs.pairs(spark, sf_dir).select("doc_id", "seq", F.inline(found))


@query(sql(f"SELECT doc_id, seq, {_strip('original')} AS source, {_strip('translated')} AS target FROM pairs WHERE seq % 4 <> 3", "pairs"))
def e5_parse_key_terms_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As e5_parse_key_terms, with replies that hold the whole texts, line ends and quotes included."""
    n = F.col("seq") % 4
    entry = F.when(n == 0, F.create_map(F.lit("source"), "original", F.lit("target"), "translated")).when(n == 1, F.create_map(F.lit("english"), "original", F.lit("chinese_translation"), "translated"))
    entry = entry.when(n == 2, F.create_map(F.lit("original"), "original", F.lit("translated"), "translated")).otherwise(F.create_map(F.lit("en"), "original"))
    found = replies.parse_key_terms(F.to_json(F.struct(F.array(entry).alias("keyTerms"))))
    return inputs.pairs(spark, sf_dir).select("doc_id", "seq", F.inline(found))


_UPPER = _strip("upper(replace(x, 'ß', 'SS'))")


@query(
    sql(
        f""", o AS (SELECT doc_id, seq, string_split(translated, chr(10)) AS old FROM pairs),
        n AS (SELECT *, CASE WHEN seq % 4 = 0 THEN greatest(len(old) - 1, 1) ELSE len(old) END AS given FROM o),
        c AS (SELECT doc_id, seq, list_transform(old, lambda x, i: CASE WHEN i % 2 = 1 AND i <= given THEN coalesce(nullif({_UPPER}, ''), x) ELSE x END) AS out FROM n)
        SELECT doc_id, seq, len(out) AS items, md5(array_to_string(out, chr(10))) AS texts_md5 FROM c""",
        "pairs",
    )
)
def e6_apply_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = F.split("translated", "\n")
    new = F.transform(old, lambda x, i: F.when(i % 2 == 0, F.upper(x)).otherwise(""))
    short = F.when(F.col("seq") % 4 == 0, F.slice(new, F.lit(1), F.greatest(F.size(new) - 1, F.lit(1)))).otherwise(new)
    out = replies.apply_corrections(F.to_json(F.struct(short.alias("corrections"))), old)
    return inputs.pairs(spark, sf_dir).select("doc_id", "seq", F.size(out).alias("items"), _md5(F.array_join(out, "\n")).alias("texts_md5"))


@query(
    sql(
        f""" SELECT doc_id, seq, md5(CASE WHEN doc_id % 9 = 8 THEN original ELSE translated END) AS translated_md5, CASE WHEN doc_id % 9 = 8 THEN 0 ELSE len(list_distinct({_ALL_TAGS.replace('{0}', 'original')})) END AS n_tags,
        CASE WHEN doc_id % 9 = 8 THEN 0.0 WHEN seq % 2 = 0 THEN 1.0 ELSE {_CONFIDENCE} END::DOUBLE AS confidence FROM pairs""",
        "pairs",
    )
)
def e7_parse_executor_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.to_json(F.struct(F.col("translated").alias("translatedText"), F.when(F.col("seq") % 2 == 0, F.lit(1.7)).alias("confidence")))
    rows = inputs.pairs(spark, sf_dir).withColumn("reply", F.when(F.col("doc_id") % 9 == 8, "no answer").otherwise(_reply(body))).drop("translated")
    out = replies.parse_executor_reply(rows)
    return out.select("doc_id", "seq", _md5("translated").alias("translated_md5"), F.size("preserved_tags").alias("n_tags"), F.round("confidence", 6).alias("confidence"))


@query(sql(f"SELECT doc_id, 1 AS terms, {sql_quote(text.STYLE_GUIDES['business'])} AS style_guide, 1 AS constraints, 1.3::DOUBLE AS expansion_ratio FROM pairs", "pairs"))
def e8_parse_plan_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.struct(F.col("original").alias("source"), F.col("translated").alias("target"), F.lit("noun").alias("category"))
    body = F.to_json(F.struct(F.array(entry).alias("glossary"), F.create_map(F.col("block_id"), F.col("constraint")).alias("blockConstraints")))
    rows = inputs.pairs(spark, sf_dir).select("doc_id", "seq", F.lit("business").alias("domain"), _reply(body).alias("reply"))
    out = replies.parse_plan_reply(rows)
    return out.select("doc_id", F.size("glossary").alias("terms"), "style_guide", F.size("constraints").alias("constraints"), "expansion_ratio")


@query(sql("SELECT doc_id, block_id, 'style' AS type, original AS description, NULL::VARCHAR AS suggestion, 'low' AS severity FROM pairs WHERE original <> ''", "pairs"))
def e9_parse_issues_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    issue = F.struct(F.col("block_id").alias("blockId"), F.lit("style").alias("type"), F.col("original").alias("description"), F.lit("low").alias("severity"))
    incomplete = F.struct(F.col("block_id").alias("blockId"), F.lit("style").alias("type"), F.lit("").alias("description"), F.lit("low").alias("severity"))
    rows = inputs.pairs(spark, sf_dir).select("doc_id", "seq", _reply(F.to_json(F.array(issue, incomplete))).alias("reply"))
    return replies.parse_issues_reply(rows)


# Checks

_TERM_ISSUES = (
    "SELECT doc_id, block_id, 'term_mismatch' AS type, 'high' AS severity, source AS detail FROM {0}, glossary WHERE source <> '' AND target <> '' "
    "AND contains(lower(original), lower(source)) AND NOT contains(lower(translated), lower(target))"
)


@query(sql(_TERM_ISSUES.format("pairs"), "pairs", "glossary"))
def g1_check_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.check_terms(inputs.pairs(spark, sf_dir), inputs.glossary(spark)).select("doc_id", "block_id", "type", "severity", "detail")


_TAG_ISSUES = (
    f", t AS (SELECT doc_id, block_id, translated, unnest(list_distinct({_ALL_TAGS.replace('{0}', 'original')})) AS tag FROM tagged), "
    r"m AS (SELECT *, regexp_extract(tag, '^<([A-Za-z0-9_]+)', 1) AS name FROM t WHERE NOT contains(translated, tag)) "
    r"SELECT doc_id, block_id, 'tag_lost' AS type, CASE WHEN name = '' THEN 'medium' ELSE 'high' END AS severity, tag AS detail FROM m "
    "WHERE name = '' OR NOT (contains(lower(translated), '<' || lower(name) || '>') OR contains(lower(translated), '<' || lower(name) || ' ') OR contains(lower(translated), '<' || lower(name) || chr(10)))"
)


@query(sql(_TAG_ISSUES, "tagged"))
def g2_check_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.check_tags(inputs.tagged(spark, sf_dir)).select("doc_id", "block_id", "type", "severity", "detail")


@query(sql("SELECT doc_id, block_id, type, severity, suggestion FROM issues WHERE type = 'semantic_drift'", "issues"))
def g3_check_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.check_drift(inputs.pairs(spark, sf_dir)).select("doc_id", "block_id", "type", "severity", "suggestion")


@query(sql("SELECT doc_id, block_id, type, severity, suggestion FROM issues WHERE type = 'layout_overflow'", "issues"))
def g4_check_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.check_overflow(inputs.pairs(spark, sf_dir)).select("doc_id", "block_id", "type", "severity", "suggestion")


def _all_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.check_all(inputs.tagged(spark, sf_dir), inputs.glossary(spark))


_ALL_ISSUES = (
    f"{_TAG_ISSUES} UNION ALL {_TERM_ISSUES.format('tagged')} UNION ALL SELECT doc_id, block_id, 'semantic_drift', CASE WHEN r < 0.2 THEN 'high' WHEN r > 2.5 THEN 'medium' ELSE 'low' END, '' FROM "
    "(SELECT *, length(translated) / nullif(length(original), 0) AS r FROM tagged) WHERE r < 0.3 OR r > 1.8 UNION ALL SELECT doc_id, block_id, 'layout_overflow', CASE WHEN r > 1.5 THEN 'high' ELSE 'medium' END, '' FROM "
    "(SELECT *, length(translated) / nullif(length(original), 0) AS r FROM tagged) WHERE \"constraint\" = 'Concise' AND r > 1.2"
)


@query(sql(_ALL_ISSUES, "tagged", "glossary"))
def g5_check_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_issues(spark, sf_dir).select("doc_id", "block_id", "type", "severity", "detail")


@query(sql("SELECT doc_id, block_id, 'native_rewrite' AS action, suggestion AS patched_text, 0.7 AS confidence FROM issues WHERE severity = 'low'", "issues"))
def g6_suggest_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.suggest_patches(inputs.issues(spark, sf_dir))


@query(
    sql(
        """, p AS (SELECT doc_id, block_id, suggestion FROM issues WHERE severity = 'low')
        SELECT doc_id, block_id, coalesce(suggestion, translated) AS translated FROM pairs LEFT JOIN p USING (doc_id, block_id)""",
        "issues", "pairs",
    )
)
def g7_apply_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    patches = checks.suggest_patches(inputs.issues(spark, sf_dir)).withColumn("seq", F.lit(0))
    worse = patches.withColumns({"confidence": F.lit(0.5), "patched_text": F.lit("?"), "seq": F.lit(1)})
    return checks.apply_patches(inputs.pairs(spark, sf_dir), patches.unionByName(worse)).select("doc_id", "block_id", "translated")


def _issues_of(name: str) -> str:
    """All issues of a bitext, with CTEs of their own."""
    return "(WITH " + _ALL_ISSUES.lstrip(", ").replace("FROM tagged", f"FROM {name}") + ")"


@query(
    sql(
        f""", first AS (SELECT doc_id, seq, block_id, original, translated, "constraint", retry_count FROM pairs), found AS {_issues_of('first')},
        again AS (SELECT * REPLACE (CASE WHEN retry_count < 2 AND (doc_id, block_id) IN (SELECT (doc_id, block_id) FROM found WHERE severity = 'high') THEN {sql_apply_terms('original')} ELSE translated END AS translated) FROM first), after AS {_issues_of('again')}
        SELECT doc_id, count(*) AS total, count(*) FILTER (WHERE severity = 'high') AS high_count, count(*) FILTER (WHERE severity = 'medium') AS medium_count, count(*) FILTER (WHERE severity = 'low') AS low_count,
        count(*) FILTER (WHERE severity = 'low') AS patches FROM after GROUP BY doc_id""",
        "pairs", "glossary",
    )
)
def g8_review_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.pairs(spark, sf_dir).withColumn("preserved_tags", text.preserved_tags(F.col("original")))
    found = checks.check_all(rows, inputs.glossary(spark))
    _, after = inference.review_round(rows, found, inputs.glossary(spark), inference.stub(inputs.GLOSSARY))
    return checks.issue_summary(after)


@query(sql("""SELECT doc_id, block_id, len(string_split(original, chr(10))) = len(string_split(translated, chr(10))) AS lines_match FROM pairs WHERE "constraint" = 'PreserveLayout'""", "pairs"))
def g9_layout_lines_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.layout_check(inputs.pairs(spark, sf_dir)).select("doc_id", "block_id", "lines_match")


# Inference


@query(sql(f"SELECT doc_id, seq, {sql_apply_terms('text')} AS translated FROM lines WHERE {_strip('text')} <> ''", "lines"))
def x1_translate_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.lines(spark, sf_dir).where(predicates.non_blank(F.col("text")))
    return inference.translate_blocks(rows, inference.stub(inputs.GLOSSARY)).select("doc_id", F.col("seq").cast("long").alias("seq"), "translated")


@query(
    sql(
        f""", t AS (SELECT doc_id, seq, text, text IN (SELECT text FROM lines WHERE seq % 2 = 0) AS known FROM lines WHERE {_strip('text')} <> '')
        SELECT doc_id, seq, CASE WHEN known THEN {sql_apply_terms('text')} ELSE text || '?' END AS translated FROM t""",
        "lines",
    )
)
def x1_translate_with_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even lines first; then all lines, by a model that would answer otherwise: only new texts reach it."""
    rows, journal = inputs.lines(spark, sf_dir).where(predicates.non_blank(F.col("text"))), new_path(spark, "journal")
    inference.translate_blocks(rows.where("seq % 2 = 0"), inference.stub(inputs.GLOSSARY), journal=journal)
    done = inference.translate_blocks(rows, inference.scripted(_doubtful), journal=journal)
    return done.select("doc_id", F.col("seq").cast("long").alias("seq"), "translated")


def _doubtful(prompt: str) -> str:
    return prompt + "?"


# Offline models that answer as the prompts ask, and fail or say nothing at times.


def _polisher(prompt: str) -> str:
    """The translation with a mark; nothing for every fifth length."""
    old = re.search(r"\nTranslation: (.*)\nAnswer with", prompt, re.S)[1]
    return "" if len(old) % 5 == 0 else f"{old} (polished)"


def _plan(prompt: str) -> str:
    """A fenced plan with the known terms; no answer for every seventh number of blocks."""
    total = int(re.search(r"\nTotal blocks: (\d+)\n", prompt)[1])
    if total % 7 == 0:
        raise ValueError("no plan")
    known = json.loads(prompt.split("\n\nKnown terms:\n")[1].split("\n\nAnswer with")[0])
    plan = {"glossary": known, "styleGuide": f"{total} blocks", "blockConstraints": {"block-0": "Concise"}, "estimatedExpansionRatio": (10 + total % 5) / 10}
    return f"```json\n{json.dumps(plan, ensure_ascii=False)}\n```"


def _proofreader(prompt: str) -> str:
    """Corrections of every other pair, as JSON with talk around it."""
    parts = re.split(r"(?:\A|\n\n)\[\d+\] Source: ", prompt)[1:]
    new = [p.split("\nTranslation: ", 1)[1] + "!" if i % 2 == 0 else "" for i, p in enumerate(parts)]
    return json.dumps({"corrections": new}, ensure_ascii=False)


@query(sql("SELECT doc_id, block_id, CASE WHEN length(translated) % 5 = 0 THEN translated ELSE translated || ' (polished)' END AS translated FROM pairs", "pairs"))
def x2_polish_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.pairs(spark, sf_dir)
    return inference.polish_blocks(requests.polish_requests(rows, "naturalize"), rows, inference.scripted(_polisher)).select("doc_id", "block_id", "translated")


@query(
    sql(
        f""", n AS (SELECT doc_id, count(*) AS total FROM blocks GROUP BY doc_id)
        SELECT doc_id, CASE WHEN total % 7 = 0 THEN 0 ELSE (SELECT count(*) FROM glossary) END AS terms, CASE WHEN total % 7 = 0 THEN {sql_quote(text.STYLE_GUIDES["general"])} ELSE total || ' blocks' END AS style_guide,
        CASE WHEN total % 7 = 0 THEN 0 ELSE 1 END AS constraints, CASE WHEN total % 7 = 0 THEN 1.3 ELSE (10 + total % 5) / 10 END::DOUBLE AS expansion_ratio FROM n""",
        "blocks", "glossary",
    )
)
def x3_plan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = inference.ask_documents(_planner(spark, sf_dir).select("doc_id", "prompt"), inference.scripted(_plan))
    plans = replies.parse_plan_reply(asked.select("doc_id", F.lit("general").alias("domain"), "reply"))
    return plans.select("doc_id", F.size("glossary").alias("terms"), "style_guide", F.size("constraints").alias("constraints"), "expansion_ratio")


@query(
    sql(
        f""", o AS (SELECT doc_id, list(translated ORDER BY seq) AS old FROM pairs GROUP BY doc_id),
        c AS (SELECT doc_id, list_transform(old, lambda x, i: CASE WHEN i % 2 = 1 AND i <= 30 THEN {_strip("(x || '!')")} ELSE x END) AS out FROM o)
        SELECT doc_id, len(out) AS items, md5(array_to_string(out, chr(10))) AS texts_md5 FROM c""",
        "pairs",
    )
)
def x4_proofread_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.pairs(spark, sf_dir)
    old = F.transform(F.array_sort(F.collect_list(F.struct("seq", "translated"))), lambda x: x["translated"])
    texts = rows.groupBy("doc_id").agg(old.alias("old"))
    asked = inference.ask_documents(requests.proofread_requests(rows).select("doc_id", "prompt"), inference.scripted(_proofreader))
    done = asked.join(texts, "doc_id").withColumn("new", replies.apply_corrections(F.coalesce("reply", F.lit("")), F.col("old")))
    return done.select("doc_id", F.size("new").alias("items"), _md5(F.array_join("new", "\n")).alias("texts_md5"))


@query()
def x5_term_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.term_candidates(_edits(spark, sf_dir))


@query(
    sql(
        rf"""SELECT doc_id, seq, trim(regexp_replace(text, '{_WS}+', ' ', 'g')) AS term, round({_WIDTH} * 10, 6) AS width, length({_strip('text')}) < 2 OR regexp_matches({_strip('text')}, '^{_SYMBOLS}+$') AS skip,
        {_ESCAPED} AS escaped FROM lines""",
        "lines",
    )
)
def x6_sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    register.register_functions(spark)
    rows = inputs.lines(spark, sf_dir)
    return rows.selectExpr("doc_id", "CAST(seq AS BIGINT) AS seq", "normalize_term(text) AS term", "round(text_width(text, 10D), 6) AS width", "skip_text(text) AS skip", "escape_xml(text) AS escaped")


def _both_forms() -> dict[str, tuple[Column, str]]:
    """Every SQL function's Column twin and its call, on a column t."""
    t, u = F.col("t"), F.col("u")
    pairs = inputs.GLOSSARY
    array = "array(" + ", ".join(f"named_struct('source', '{a}', 'target', '{b}')" for a, b in text.longest_first(pairs)) + ")"
    given = "array(" + ", ".join(f"named_struct('source', '{a}', 'target', '{b}')" for a, b in pairs) + ")"
    context = F.array(F.left(t, F.lit(9)), F.lit(" "), F.lit("next words"))
    return {
        "normalize_term": (text.normalize_term(t), "normalize_term(t)"), "strip_html": (text.strip_html(t), "strip_html(t)"), "escape_xml": (text.escape_xml(t), "escape_xml(t)"),
        "skip_text": (predicates.skip_text(t), "skip_text(t)"), "has_han": (predicates.has_han(t), "has_han(t)"), "text_width": (text.text_width(t, F.lit(9.0)), "text_width(t, 9D)"),
        "detect_term_lang": (text.detect_term_lang(t), "detect_term_lang(t)"), "normalize_lang": (text.normalize_lang(t), "normalize_lang(t)"),
        "skip_numeric_short": (predicates.skip_numeric_short(t), "skip_numeric_short(t)"), "contains_cjk": (predicates.contains_cjk(t), "contains_cjk(t)"), "strip_fences": (text.strip_fences(t), "strip_fences(t)"),
        "classify_constraint": (text.classify_constraint(F.lit("text"), F.length(t).cast("double"), u), "classify_constraint('text', cast(length(t) AS DOUBLE), u)"),
        "estimate_confidence": (text.estimate_confidence(t, u, F.lit("Concise")), "estimate_confidence(t, u, 'Concise')"),
        "length_ratio": (F.length(u) / F.nullif(F.length(t), F.lit(0)), "length_ratio(t, u)"), "detect_text_lang": (text.detect_text_lang(t), "detect_text_lang(t)"),
        "apply_terms": (text.apply_terms(t, pairs), f"apply_terms(t, {given})"), "fix_han_terms": (text.fix_han_terms(t, pairs), f"fix_han_terms(t, {array})"), "fix_full_terms": (text.fix_full_terms(t, pairs), f"fix_full_terms(t, {given})"),
        "strip_meta": (text.strip_meta(t), "strip_meta(t)"), "refusal_fallback": (text.refusal_fallback(u, t), "refusal_fallback(u, t)"), "preserved_tags": (text.preserved_tags(t), "preserved_tags(t)"),
        "fit_font": (text.fit_font(t, F.lit(11.0), F.lit(90.0)), "fit_font(t, 11D, 90D)"), "style_guide": (text.style_guide(u), "style_guide(u)"), "find_replace": (text.find_replace(t, "the", "le")[0], "find_replace(t, 'the', 'le')"),
        "merge_short": (text.merge_short(t, context), "merge_short(t, array(left(t, 9), ' ', 'next words'))"), "trim_tail": (text.trim_tail(t), "trim_tail(t)"), "truncate": (text.truncate(t, 50), "truncate(t, 50)"),
        "skip_short_number": (predicates.skip_short_number(t), "skip_short_number(t)"),
    }


@query(sql("SELECT doc_id, seq, '' AS different, true AS cleaned, true AS repaired FROM lines", "lines"))
def x6_all_sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of functions whose SQL form gives another value than their Column form: none, on any line."""
    register.register_functions(spark)
    rows = inputs.lines(spark, sf_dir).select("doc_id", F.col("seq").cast("long").alias("seq"), F.col("text").alias("t"), F.reverse(F.left("text", F.lit(30))).alias("u"))
    # Python first: the SQL functions bring a copy of their texts each, which it need not carry.
    told = rows.select("*", F.expr("clean_extracted(t)").alias("cleaned"), F.expr("repair_inline_tags(t, u)").alias("repaired"))
    twin = python_text.repair_tags(python_text.clean_extracted(told.withColumns({"text": F.col("t"), "original": F.col("t"), "translated": F.col("u"), "broken": F.lit(True)})))
    same = twin.select("doc_id", "seq", "t", "u", (F.col("cleaned") == F.col("text")).alias("cleaned"), (F.col("repaired") == F.col("translated")).alias("repaired"))
    names = [F.when(~F.expr(call).eqNullSafe(form), F.lit(name)) for name, (form, call) in _both_forms().items()]
    # concat_ws skips nulls and stays in generated code, which looks at what several names share once.
    return same.select("doc_id", "seq", F.concat_ws(",", *names).alias("different"), "cleaned", "repaired")


@query()
def x6_lateral_term_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    register.register_functions(spark)
    _edits(spark, sf_dir).createOrReplaceTempView("edits_of_terms")
    return spark.sql("SELECT doc_id, block_id, c.* FROM edits_of_terms, LATERAL term_candidates(source_text, before_text, after_text) AS c WHERE before_text IS DISTINCT FROM after_text")


# Streams


def _sse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation texts as server-sent lines, word by word, with noise between."""
    turns = table(spark, sf_dir, "conversations").withColumn("response_id", F.col("conv_id") * 100 + F.col("turn"))
    words = turns.select("response_id", F.posexplode(F.split("text", " ")).alias("n", "w"))
    content = F.struct(F.array(F.struct(F.struct(F.concat("w", F.lit(" ")).alias("content")).alias("delta"))).alias("choices"))
    kinds = F.array(F.concat(F.lit("data: "), F.to_json(content)), F.lit(""), F.lit(": ping"), F.lit("data: {broken"), F.lit("data: [DONE]"))
    return words.select("response_id", "n", F.posexplode(kinds).alias("k", "line")).select("response_id", (F.col("n") * 10 + F.col("k")).cast("long").alias("line_no"), "line")


@query("SELECT conv_id * 100 + turn AS response_id, md5(text || ' ') AS text_md5 FROM conversations")
def r1_assemble_token_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.assemble_token_stream(_sse(spark, sf_dir)).select("response_id", _md5("text").alias("text_md5"))


@query("SELECT conv_id * 100 + turn AS response_id, md5(text || ' ') AS text_md5, turn % 7 <> 3 AS complete FROM conversations WHERE turn % 7 <> 3")
def r1_assemble_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as a stream of lines in three micro-batches of files, dealt out by a hash; every seventh response lacks its end mark and so does not end."""
    # Conversations of more than 100 turns share numbers, so the stream has both parts.
    turns = table(spark, sf_dir, "conversations").withColumn("response_id", F.concat_ws("-", "conv_id", "turn"))
    words = F.split("text", " ")
    # Two places after the words: a line that is no data, and the end.
    places = turns.select("response_id", "turn", F.size(words).alias("n"), F.posexplode(F.concat(words, F.array(F.lit(""), F.lit("")))).alias("line_no", "w"))
    content = F.to_json(F.struct(F.array(F.struct(F.struct(F.concat("w", F.lit(" ")).alias("content")).alias("delta"))).alias("choices")))
    end = F.when(F.col("turn") % 7 == 3, "data: {broken").otherwise("data: [DONE]")
    line = F.when(F.col("line_no") < F.col("n"), F.concat(F.lit("data: "), content)).when(F.col("line_no") == F.col("n"), ": ping").otherwise(end)
    rows = places.select("response_id", "line_no", line.alias("line"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn") % 60).alias("ts"))
    path, files = new_path(spark, "lines"), spark.sparkContext.defaultParallelism
    rows.repartition(3 * files, F.xxhash64("response_id", "line_no")).write.parquet(path)
    done = runs.run_available(streams.assemble_responses(runs.stream_table(spark, path, files=files)), "append", "responses")
    part = F.split("response_id", "-")
    return done.select((part[0].cast("long") * 100 + part[1].cast("long")).alias("response_id"), _md5("text").alias("text_md5"), "complete")


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = runs.stream_table(spark, f"{sf_dir}/events.parquet")
    phases = F.create_map(*(F.lit(x) for kv in inputs.PHASES.items() for x in kv))
    return raw.select(
        F.col("user_id").alias("doc_id"), "event_id", F.when(F.col("event_type") == "signup", "block_completed").otherwise("progress").alias("type"),
        phases[F.col("event_type")].alias("phase"), F.col("ts").cast("timestamp").alias("ts"),
    )


@query(sql("SELECT doc_id, count(*) FILTER (WHERE type = 'block_completed') AS completed, count(*) AS events, arg_max(phase, event_id) AS phase FROM ev GROUP BY doc_id", "ev"))
def r2_progress_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_available(streams.progress(_event_stream(spark, sf_dir)), "complete", "progress")


@query()
def r3_evict_stale_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_available(streams.evict_stale_sessions(_event_stream(spark, sf_dir)), "append", "sessions")


@query(sql(f"SELECT 'p' || page_id AS doc_id, {sql_apply_terms('url')} AS translated FROM pages"))
def r4_incremental_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = runs.stream_table(spark, f"{sf_dir}/pages.parquet")
    blocks = raw.select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("doc_id"), F.lit("block-0").alias("block_id"), F.col("url").alias("text"))
    results = new_path(spark, "incremental")
    for run in range(2):  # the second run starts over and finds everything stored
        runs.finish(streams.incremental_translate(blocks, inference.stub(inputs.GLOSSARY), results, new_path(spark, f"incremental-state-{run}")))
    return spark.read.parquet(results).select("doc_id", "translated")


@query(sql(f"SELECT doc_id, 'block-' || seq AS block_id, {sql_apply_terms('text')} AS translated FROM html_blocks", "html_blocks"))
def r4_incremental_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every block of every page, translated once although the stream is read twice."""
    raw = scans.scan_html_blocks(runs.stream_table(spark, f"{sf_dir}/pages.parquet"))
    blocks = raw.select("doc_id", F.concat(F.lit("block-"), F.col("seq").cast("string")).alias("block_id"), "text")
    results = new_path(spark, "incremental")
    for run in range(2):
        runs.finish(streams.incremental_translate(blocks, inference.stub(inputs.GLOSSARY), results, new_path(spark, f"incremental-state-{run}")))
    return spark.read.parquet(results).select("doc_id", "block_id", "translated")


@query()
def r5_learn_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = new_path(spark, "learned")
    versions.commit(inputs.termbase(spark, sf_dir), base, "start")
    raw = runs.stream_table(spark, f"{sf_dir}/conversations.parquet")
    rows = raw.where("role = 'assistant'").select(
        F.col("conv_id").alias("doc_id"), F.concat(F.lit("block-"), F.col("turn").cast("string")).alias("block_id"), F.col("text").alias("source_text"), F.col("text").alias("before_text"),
        F.regexp_replace("text", r"^(\S+) (\S+)", r"$1 $2x").alias("after_text"),
    )
    runs.finish(streams.learn_stream(rows, base, new_path(spark, "learned-state")))
    return versions.latest(spark, base).where("domain = 'proofread'").select("source", "target", "frequency", "confirmed")
