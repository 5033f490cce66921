"""Replies of the model: tolerant JSON, alignment with batches, fallbacks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitext.functions.compat import BLANK, WS, let, not_empty, strip, text_or_empty
from bitext.functions.text import estimate_confidence, preserved_tags, strip_fences, strip_meta, style_guide
from bitext.storage import BUCKETED, materialize_by, settings

# Field names that replies use.
SOURCE_NAMES, TARGET_NAMES = ("source", "english", "en", "original"), ("target", "chinese_translation", "zh", "translation", "translated")
ARRAY_NAMES = ("translations", "translated", "paragraphs", "results")


def _valid(c: Column) -> Column:
    """``c`` where it is JSON, and nothing else stands after it."""
    return let(c, lambda x: F.when(_is_json(x), x))


def _is_json(c: Column) -> Column:
    # The parser stops after one value; as the only item of an array, all has to be that value.
    item = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    return F.try_parse_json(c).isNotNull() & item.isNotNull() & F.try_variant_get(item, "$[1]", "variant").isNull()


def _between(c: Column, opening: str, closing: str) -> Column:
    start = F.locate(opening, c)
    end = F.length(c) - F.locate(closing, F.reverse(c)) + 1
    return F.when((start > 0) & c.contains(closing) & (end > start), F.substring(c, start, end - start + 1))


def extract_json(c: Column, first_opened: bool = False) -> Column:
    """The JSON text inside a reply, or null: the reply without fences, else its outermost braces, else its brackets.

    ``first_opened``: only the kind that opens first counts.
    """

    def find(t: Column) -> Column:
        curly, square = _between(t, "{", "}"), _between(t, "[", "]")
        if first_opened:
            brace, bracket = F.locate("{", t), F.locate("[", t)
            return F.coalesce(_valid(t), _valid(F.when((brace > 0) & ((bracket == 0) | (brace < bracket)), curly).otherwise(square)))
        return F.coalesce(_valid(t), _valid(curly), _valid(square))

    return let(strip_fences(text_or_empty(c)), find)


def _strings(json: Column) -> Column:
    return F.from_json(json, "array<string>")


def translations_array(json: Column, source: Column) -> Column:
    """The array of texts in a reply's JSON; the source texts where there is none."""
    fields = F.from_json(json, "map<string,string>")
    is_object = json.startswith("{")
    named = [F.when(is_object, F.get_json_object(json, f"$.{n}")) for n in ARRAY_NAMES]
    candidates = [F.when(json.startswith("["), json), *(F.when(x.startswith("["), x) for x in named)]
    other = F.element_at(F.filter(F.map_values(fields), lambda x: x.startswith("[")), 1)
    first = F.when(is_object & (F.size(F.filter(F.map_values(fields), lambda x: x.startswith("["))) > 0), other)
    return F.coalesce(*(_strings(x) for x in candidates), _strings(first), source)


def align_replies(batches: DataFrame, replies: DataFrame) -> DataFrame:
    """batch rows (doc_id, batch, pos, text) plus ``translated`` and ``needs_split``.

    ``replies`` has doc_id, batch, texts. A reply of another size than its batch translates
    nothing: the batch has to be split, or, with one item, keeps its source.
    """
    sizes = batches.groupBy("doc_id", "batch").agg(F.count(F.lit(1)).alias("items"))
    ok = sizes.join(replies, ["doc_id", "batch"], "left").withColumn("fits", F.coalesce(F.size("texts") == F.col("items"), F.lit(False)))
    texts = ok.where("fits").select("doc_id", "batch", F.posexplode("texts").alias("pos", "translated"))
    rows = batches.join(ok.select("doc_id", "batch", "fits", "items"), ["doc_id", "batch"]).join(texts, ["doc_id", "batch", "pos"], "left")
    return rows.withColumns({"translated": F.coalesce(not_empty(F.col("translated")), "text"), "needs_split": ~F.col("fits") & (F.col("items") > 1)}).drop("fits", "items")


def split_batches(aligned: DataFrame) -> DataFrame:
    """Halves of the batches that need splitting: rows with new batch and pos, further columns as they are."""
    rows = aligned.where("needs_split")
    sizes = rows.groupBy("doc_id", "batch").agg(F.count(F.lit(1)).alias("items"))
    return _halves(rows.join(sizes, ["doc_id", "batch"]))


def _halves(rows: DataFrame) -> DataFrame:
    middle = F.floor(F.col("items") / 2)
    second = F.col("pos") >= middle
    half = F.concat_ws(".", F.col("batch").cast("string"), F.when(second, "1").otherwise("0"))
    rows = rows.withColumns({"batch": half, "pos": F.when(second, F.col("pos") - middle).otherwise(F.col("pos")).cast("int")})
    return rows.drop("items", "translated", "needs_split")


def align_until(batches: DataFrame, ask: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Every batch row (doc_id, batch, pos, text, ...) plus ``translated`` and ``rounds``, the calls that it took part in.

    ``ask`` takes rows with doc_id, batch, pos, text and returns doc_id, batch, texts: the replies.
    Batches whose replies do not align are halved and asked again, the others are done, so each
    round has fewer and smaller batches and there are at most log2 of the largest batch of them,
    and one. Replies are written before they are used: no batch is asked twice. All that is
    written lies in buckets of documents, and a round writes its rows once, with what they
    became: rows are shuffled once, and by ``ask`` only where it does not group by the batch.
    """
    key = ["doc_id", "batch"]
    frontier = batches.withColumns({"first_batch": F.col("batch"), "first_pos": F.col("pos"), "batch": F.col("batch").cast("string")})
    frontier = materialize_by(frontier, "batches", "doc_id")
    done: list[DataFrame] = []
    while True:
        told = ask(frontier.select("doc_id", "batch", "pos", "text")).select(*key, "texts")
        rows = frontier.withColumn("items", F.count(F.lit(1)).over(Window.partitionBy(*key))).join(told, key, "left")
        fits = F.coalesce(F.size("texts") == F.col("items"), F.lit(False))
        translated = F.when(fits, F.coalesce(not_empty(F.get("texts", F.col("pos"))), "text"))
        rows = rows.withColumns({"translated": translated, "needs_split": ~fits & (F.col("items") > 1)}).drop("texts")
        with settings(batches.sparkSession, BUCKETED):
            rows = materialize_by(rows, "aligned", "doc_id")
        ended = rows.where("NOT needs_split").drop("items", "needs_split")
        done.append(ended.withColumns({"translated": F.coalesce("translated", "text"), "rounds": F.lit(len(done) + 1)}))
        frontier = _halves(rows.where("needs_split"))
        if frontier.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.withColumns({"batch": F.col("first_batch"), "pos": F.col("first_pos")}).drop("first_batch", "first_pos")


def parse_numbered(lines: DataFrame, replies: DataFrame) -> DataFrame:
    """``lines`` (doc_id, batch, idx, text) plus ``translated`` from ``[idx] text`` lines; the last of an idx wins.

    A text of blanks alone stays as it is: nothing of it is asked for.
    """
    found = replies.select("doc_id", "batch", F.posexplode(F.split("reply", "\n")).alias("line_no", "line"))
    # A line ends with \n alone; for Java's dot, also at \r, \x85, \u2028 and \u2029.
    pattern = rf"(?s)^{WS}*\[(\d+)\]{WS}*([^{BLANK}].*)"
    found = found.where(F.col("line").rlike(pattern)).select("doc_id", "batch", "line_no", F.regexp_extract("line", pattern, 1).try_cast("long").alias("idx"), strip(F.regexp_extract("line", pattern, 2)).alias("t"))
    last = found.groupBy("doc_id", "batch", "idx").agg(F.max_by("t", "line_no").alias("translated"))
    given = F.when(F.col("text").rlike(f"[^{BLANK}]"), F.col("translated"))
    return lines.join(last, ["doc_id", "batch", "idx"], "left").withColumn("translated", F.coalesce(given, "text"))


def parse_key_terms(json: Column, limit: int = 10) -> Column:
    """Array of (source, target): at most ``limit`` entries, by any of their usual names; incomplete ones go."""
    entries = F.coalesce(F.from_json(F.get_json_object(json, "$.keyTerms"), "array<map<string,string>>"), F.from_json(json, "array<map<string,string>>"))

    def pick(entry: Column, names: tuple[str, ...]) -> Column:
        return F.coalesce(*(not_empty(strip(F.try_element_at(entry, F.lit(n)))) for n in names))

    pairs = F.transform(F.slice(entries, 1, limit), lambda e: F.struct(pick(e, SOURCE_NAMES).alias("source"), pick(e, TARGET_NAMES).alias("target")))
    return F.coalesce(F.filter(pairs, lambda p: p["source"].isNotNull() & p["target"].isNotNull()), F.array().cast("array<struct<source:string,target:string>>"))


def apply_corrections(reply: Column, old: Column) -> Column:
    """Array of texts after proofreading; ``old`` where a correction is missing or empty.

    A JSON array, whole or short, goes by position. A reply that is no JSON counts if it has
    as many ``Translation:`` parts as there are texts.
    """
    clean = strip_fences(reply)
    given = _strings(F.get_json_object(_valid(clean), "$.corrections"))
    by_position = F.zip_with(old, given, lambda o, g: F.when(o.isNotNull(), F.coalesce(not_empty(strip_meta(F.coalesce(g, F.lit("")))), o)))
    by_position = F.slice(by_position, F.lit(1), F.size(old))
    parts = F.transform(F.regexp_extract_all(clean, F.lit(r"(?is)Translation:\s*([^\[]*?)(?=\s*\[\d+\]\s*Source:|\s*\z)"), F.lit(1)), lambda x: strip_meta(strip(x)))
    parts = F.filter(parts, lambda x: x != "")
    return F.when(F.size(given) > 0, by_position).when(~F.coalesce(_is_json(clean), F.lit(False)) & (F.size(parts) == F.size(old)), parts).otherwise(old)


def parse_executor_reply(replies: DataFrame) -> DataFrame:
    """``replies`` (reply, original, constraint) plus translated, preserved_tags, confidence.

    A missing reply or one without JSON is a failure: the source, no tags, confidence 0.
    """
    json = extract_json(F.col("reply"))
    rows = replies.withColumn("json", json)
    failed = F.col("json").isNull()
    text = F.coalesce(not_empty(F.get_json_object("json", "$.translatedText")), F.col("original"))
    rows = rows.withColumn("translated", F.when(failed, F.col("original")).otherwise(text))
    given = F.get_json_object("json", "$.confidence").try_cast("double")
    confidence = F.coalesce(F.when(given.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), given))), estimate_confidence(F.col("original"), F.col("translated"), F.col("constraint")))
    tags = F.get_json_object("json", "$.preservedTags")
    tags = F.coalesce(F.when(tags.startswith("["), _strings(tags)), preserved_tags(F.col("original")))
    none = F.array().cast("array<string>")
    return rows.withColumns({"preserved_tags": F.when(failed, none).otherwise(tags), "confidence": F.when(failed, 0.0).otherwise(confidence)}).drop("json")


def parse_plan_reply(replies: DataFrame) -> DataFrame:
    """doc_id, glossary (array), style_guide, constraints (map), expansion_ratio from doc_id, domain, reply."""
    json = extract_json(F.col("reply"))
    rows = replies.withColumn("json", json)
    entry = "array<struct<source:string,target:string,category:string>>"
    return rows.select(
        "doc_id", F.coalesce(F.from_json(F.get_json_object("json", "$.glossary"), entry), F.array().cast(entry)).alias("glossary"),
        F.coalesce(not_empty(F.get_json_object("json", "$.styleGuide")), style_guide(F.col("domain"))).alias("style_guide"),
        F.coalesce(F.from_json(F.get_json_object("json", "$.blockConstraints"), "map<string,string>"), F.create_map().cast("map<string,string>")).alias("constraints"),
        F.coalesce(F.nullif(F.get_json_object("json", "$.estimatedExpansionRatio").try_cast("double"), F.lit(0.0)), F.lit(1.3)).alias("expansion_ratio"),
    )


def parse_issues_reply(replies: DataFrame) -> DataFrame:
    """doc_id, block_id, type, description, suggestion, severity of complete issues in an array reply."""
    json = extract_json(F.col("reply"))
    issue = "array<struct<blockId:string,type:string,description:string,suggestion:string,severity:string>>"
    rows = replies.withColumn("json", json).where(F.col("json").startswith("[")).select("doc_id", F.inline(F.from_json("json", issue)))
    rows = rows.withColumnRenamed("blockId", "block_id")
    return rows.where("coalesce(block_id, '') <> '' AND coalesce(type, '') <> '' AND coalesce(description, '') <> ''")
