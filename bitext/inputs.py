"""Operator inputs that are derived from the base tables, and their SQL form for the oracles.

Each function has its SQL twin in ``SQL`` under the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitext.functions.text import apply_terms, preserved_tags
from bitext.sources import blocks as scans
from bitext.storage import table

#: A glossary that meets the invented words of the tables; some targets contain other sources.
GLOSSARY = (
    ("the", "le"), ("there", "the la"), ("tion", "cion"), ("of", "von"), ("que", "that"), ("der", "the"), ("über", "ober"),
    ("el", "il"), ("and", "und"), ("ouer", "$1"), ("est", "ist"), ("", "nothing"), ("nothing", ""),
)
NODE_TYPES = ("paragraph", "heading", "list", "table", "code", "label", "button", "caption", "textbox")
CONSTRAINTS = ("Concise", "PreserveLayout", "ExpandAllowed")
STATUSES = {"view": "pending", "click": "translating", "signup": "done", "purchase": "edited", "error": "pending"}
PHASES = {"view": "planning", "click": "executing", "signup": "reviewing", "purchase": "completed", "error": "failed"}


def glossary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(GLOSSARY)], "ord long, source string, target string")


def _pick(values: tuple[str, ...], index: str) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.expr(index) + 1).cast("int"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, seq, text: lines of the documents."""
    return scans.scan_lines(table(spark, sf_dir, "documents"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with block_id, node_type, box_width and an own constraint or none."""
    rows = lines(spark, sf_dir)
    return rows.select(
        "doc_id", "seq", "text", F.concat(F.lit("block-"), F.col("seq").cast("string")).alias("block_id"), _pick(NODE_TYPES, "seq % 9").alias("node_type"),
        (F.length("text") % 400).cast("double").alias("box_width"), F.when(F.col("seq") % 2 == 0, _pick(CONSTRAINTS, "seq % 3")).alias("constraint"),
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bitext: a user turn and the assistant's next turn."""
    turns = table(spark, sf_dir, "conversations")
    user = turns.where("role = 'user'").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seq"), F.col("text").alias("original"))
    reply = turns.where("role = 'assistant'").select(F.col("conv_id").alias("doc_id"), (F.col("turn") - 1).alias("seq"), F.col("text").alias("translated"))
    return user.join(reply, ["doc_id", "seq"]).select(
        "doc_id", "seq", F.concat(F.lit("block-"), F.col("seq").cast("string")).alias("block_id"), "original", "translated", _pick(CONSTRAINTS, "(doc_id + seq) % 3").alias("constraint"),
        (F.col("doc_id") % 4).cast("int").alias("retry_count"),
    )


def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.scan_html_blocks(table(spark, sf_dir, "pages"))


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bitext of page blocks with markup: terms applied, and bold marks lost in every fifth block."""
    rows = html_blocks(spark, sf_dir).select("doc_id", "seq", F.col("text").alias("original"))
    applied = apply_terms(F.col("original"), GLOSSARY)
    lost = F.regexp_replace(applied, "</?b>", "")
    return rows.select(
        "doc_id", "seq", F.concat(F.lit("block-"), F.col("seq").cast("string")).alias("block_id"), "original", F.when(F.col("seq") % 5 == 0, lost).otherwise(applied).alias("translated"),
        preserved_tags(F.col("original")).alias("preserved_tags"), _pick(CONSTRAINTS, "seq % 3").alias("constraint"),
    )


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift and overflow issues of ``pairs``."""
    from bitext.operators.checks import check_drift, check_overflow

    rows = pairs(spark, sf_dir)
    return check_drift(rows).unionByName(check_overflow(rows))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of page blocks, laid out line by line."""
    rows = html_blocks(spark, sf_dir)
    words = rows.select("doc_id", "seq", F.posexplode(F.split(F.regexp_replace("text", "<[^>]*>", ""), " ")).alias("w", "text"))
    # Ten words a line.
    line = F.col("seq") * 1000 + F.floor(F.col("w") / 10)
    y0, x0 = (12 * line + F.col("w") % 3).cast("double"), (40 * (F.col("w") % 10)).cast("double")
    return words.select(
        "doc_id", F.lit(0).alias("page"), (F.col("seq").cast("long") * 100000 + F.col("w")).alias("span_id"), "text", x0.alias("x0"), y0.alias("y0"), (x0 + 35.0).alias("x1"),
        (y0 + 10.0).alias("y1"), (8 + F.col("w") % 5).cast("double").alias("size"), "seq", "w",
    )


def _mapped(values: dict[str, str], column: str) -> F.Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[F.col(column)]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipeline events: doc_id, event_id, type, phase, status, ts."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("doc_id"), "event_id", F.when(F.col("event_type") == "signup", "block_completed").otherwise("progress").alias("type"),
        _mapped(PHASES, "event_type").alias("phase"), _mapped(STATUSES, "event_type").alias("status"), F.col("ts").cast("timestamp").alias("ts"),
    )


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, seq, pos, word: blank-separated words of the lines, lower case, letters only."""
    rows = lines(spark, sf_dir).select("doc_id", "seq", F.posexplode(F.split("text", " ")).alias("pos", "raw"))
    return rows.where(F.lower("raw").rlike(r"\p{L}")).select("doc_id", "seq", "pos", _letters("raw").alias("word"))


def _letters(raw: str) -> F.Column:
    return F.regexp_replace(F.lower(raw), r"[^\p{L}]+", "")


def distinct_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``word`` values of ``words``: patterns meet each form, as it stands in the texts, once."""
    raw = lines(spark, sf_dir).select(F.explode(F.split("text", " ")).alias("raw")).groupBy("raw").agg(F.count(F.lit(1)).alias("n"))
    # A condition on the text alone would be moved before the grouping.
    return raw.select(F.when(F.col("n") > 0, _letters("raw")).alias("word")).where("word <> ''").distinct()


def incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Term rows from the words: many keys come often, some rows are invalid."""
    order = F.col("doc_id").cast("long") * 1_000_000_000 + F.col("seq").cast("long") * 100_000 + F.col("pos").cast("long")
    n = F.length("word")
    return words(spark, sf_dir).select(
        order.alias("seq"), "word", F.when(n % 7 == 0, F.concat(F.lit("X"), "word")).otherwise(F.col("word")).alias("source"),
        F.when(n % 5 == 0, F.col("word")).otherwise(F.reverse("word")).alias("target"), F.when(n % 3 == 0, "en").alias("source_lang"), F.when(n % 4 == 0, "").alias("target_lang"),
        F.when(n % 2 == 0, "words").alias("domain"), F.when(F.col("pos") % 10 == 0, F.col("pos") % 20 == 0).alias("confirmed"),
    )


def termbase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored termbase: words of the benchmark items."""
    rows = table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).where("word <> ''")
    n = F.length("word")
    stamp = F.lit("2023-01-01 00:00:00").cast("timestamp")
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("frequency")).select(
        F.concat(F.lit("w-"), "word").alias("id"), F.col("word").alias("source"), F.reverse("word").alias("target"), F.when(n % 3 == 0, "en").otherwise("Auto").alias("source_lang"),
        F.lit("中文 (简体)").alias("target_lang"), F.when(n % 2 == 0, "words").otherwise("general").alias("domain"), "frequency", (n % 4 == 0).alias("confirmed"),
        stamp.alias("created_at"), stamp.alias("updated_at"),
    )


def _case(values: dict[str, str], column: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def sql_quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_apply_terms(expression: str, terms: tuple[tuple[str, str], ...] = GLOSSARY) -> str:
    """Nested replacements, longest source first, targets literal."""
    for source, target in sorted((t for t in terms if t[0] and t[1]), key=lambda t: -len(t[0])):
        expression = f"regexp_replace({expression}, {sql_quote(source)}, {sql_quote(target.replace(chr(92), chr(92) * 2))}, 'gi')"
    return expression


_TAGS = "|".join(rf"<{t}\b[^>]*>.*?</{t}>" for t in scans.BLOCK_TAGS)
_PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "glossary": ((), "SELECT * FROM (VALUES " + ", ".join(f"({i}, {sql_quote(s)}, {sql_quote(t)})" for i, (s, t) in enumerate(GLOSSARY)) + ") AS g(ord, source, target)"),
    "lines": ((), "SELECT doc_id, unnest(range(len(l))) AS seq, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"),
    "blocks": (
        ("lines",),
        f"SELECT doc_id, seq, text, 'block-' || seq AS block_id, {_list(NODE_TYPES)}[seq % 9 + 1] AS node_type, (length(text) % 400)::DOUBLE AS box_width, "
        f"CASE WHEN seq % 2 = 0 THEN {_list(CONSTRAINTS)}[seq % 3 + 1] END AS \"constraint\" FROM lines",
    ),
    "pairs": (
        (),
        f"SELECT u.conv_id AS doc_id, u.turn AS seq, 'block-' || u.turn AS block_id, u.text AS original, a.text AS translated, {_list(CONSTRAINTS)}[(u.conv_id + u.turn) % 3 + 1] AS \"constraint\", "
        "(u.conv_id % 4)::INTEGER AS retry_count, length(a.text) / nullif(length(u.text), 0) AS r FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 "
        "WHERE u.role = 'user' AND a.role = 'assistant'",
    ),
    "html_blocks": (
        (),
        "SELECT page_id AS doc_id, unnest(range(len(e))) AS seq, regexp_extract(unnest(e), '^<([A-Za-z0-9]+)', 1).lower() AS tag, "
        "regexp_replace(regexp_replace(unnest(e), '^<[^>]*>', ''), '</[^<>]*>$', '') AS text FROM (SELECT page_id, "
        rf"list_filter(regexp_extract_all(html, '(?is){_TAGS}'), lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '\s+', ' ', 'g')) <> '') AS e FROM pages)",
    ),
    "tagged": (
        ("html_blocks",),
        f"SELECT doc_id, seq, 'block-' || seq AS block_id, text AS original, CASE WHEN seq % 5 = 0 THEN regexp_replace({sql_apply_terms('text')}, '</?b>', '', 'g') ELSE {sql_apply_terms('text')} END AS translated, "
        f"{_list(CONSTRAINTS)}[seq % 3 + 1] AS \"constraint\" FROM html_blocks",
    ),
    "issues": (
        ("pairs",),
        "SELECT doc_id, block_id, 'semantic_drift' AS type, CASE WHEN r < 0.2 THEN 'high' WHEN r > 2.5 THEN 'medium' ELSE 'low' END AS severity, "
        "CASE WHEN r < 0.2 THEN 'Review and ensure all key information is preserved' WHEN r > 2.5 THEN 'Review and trim any content not present in the original' "
        "ELSE 'Check that translation preserves original meaning' END AS suggestion FROM pairs WHERE r < 0.3 OR r > 1.8 UNION ALL "
        "SELECT doc_id, block_id, 'layout_overflow', CASE WHEN r > 1.5 THEN 'high' ELSE 'medium' END, 'Compress translation using abbreviations and shorter phrasing' FROM pairs "
        "WHERE \"constraint\" = 'Concise' AND r > 1.2",
    ),
    "spans": (
        ("html_blocks",),
        "SELECT doc_id, 0 AS page, seq * 100000 + w AS span_id, text, (40 * (w % 10))::DOUBLE AS x0, (12 * (seq * 1000 + w // 10) + w % 3)::DOUBLE AS y0, (40 * (w % 10) + 35)::DOUBLE AS x1, (8 + w % 5)::DOUBLE AS size, seq, w FROM "
        "(SELECT doc_id, seq, unnest(range(len(l))) AS w, unnest(l) AS text FROM (SELECT doc_id, seq, string_split(regexp_replace(text, '<[^>]*>', '', 'g'), ' ') AS l FROM html_blocks))",
    ),
    "ev": (
        (),
        f"SELECT user_id AS doc_id, event_id, CASE WHEN event_type = 'signup' THEN 'block_completed' ELSE 'progress' END AS type, {_case(PHASES, 'event_type')} AS phase, "
        f"{_case(STATUSES, 'event_type')} AS status, ts FROM events",
    ),
    "words": (
        ("lines",),
        r"SELECT * FROM (SELECT doc_id, seq, pos, regexp_replace(lower(raw), '[^\p{L}]', '', 'g') AS word FROM "
        "(SELECT doc_id, seq, unnest(range(len(l))) AS pos, unnest(l) AS raw FROM (SELECT doc_id, seq, string_split(text, ' ') AS l FROM lines))) WHERE word <> ''",
    ),
    "incoming": (
        ("words",),
        "SELECT doc_id * 1000000000 + seq * 100000 + pos AS seq, word, CASE WHEN length(word) % 7 = 0 THEN 'X' || word ELSE word END AS source, "
        "CASE WHEN length(word) % 5 = 0 THEN word ELSE reverse(word) END AS target, CASE WHEN length(word) % 3 = 0 THEN 'en' END AS source_lang, "
        "CASE WHEN length(word) % 4 = 0 THEN '' END AS target_lang, CASE WHEN length(word) % 2 = 0 THEN 'words' END AS domain, CASE WHEN pos % 10 = 0 THEN pos % 20 = 0 END AS confirmed FROM words",
    ),
    "termbase": (
        (),
        r"SELECT 'w-' || word AS id, word AS source, reverse(word) AS target, CASE WHEN length(word) % 3 = 0 THEN 'en' ELSE 'Auto' END AS source_lang, '中文 (简体)' AS target_lang, "
        "CASE WHEN length(word) % 2 = 0 THEN 'words' ELSE 'general' END AS domain, count(*) AS frequency, length(word) % 4 = 0 AS confirmed FROM "
        r"(SELECT unnest(regexp_split_to_array(lower(text), '[^\p{L}]+')) AS word FROM benchmark) WHERE word <> '' GROUP BY word",
    ),
}


def sql(body: str, *names: str) -> str:
    """``body`` with the named inputs, and what they need, as common table expressions."""
    order: list[str] = []

    def need(name: str) -> None:
        if name not in order:
            for other in _PARTS[name][0]:
                need(other)
            order.append(name)

    for name in names:
        need(name)
    head = ", ".join(f"{n} AS ({_PARTS[n][1]})" for n in order)
    return f"WITH {head}{', ' if head and body.lstrip().startswith(',') else ' '}{body.lstrip().lstrip(',')}" if head else body
