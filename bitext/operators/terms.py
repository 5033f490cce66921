"""Terminology base: upserts as set logic, statistics, candidates from edits.

Columns: id, source, target, source_lang, target_lang, domain, frequency, confirmed,
created_at, updated_at. Incoming rows have seq, source, target, source_lang, target_lang,
domain, confirmed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitext.functions.compat import not_empty
from bitext.functions.text import normalize_term
from bitext.operators.sequences import UNSPACED, has_unspaced, segmented, sequences, write_filter
from bitext.storage import materialize

DEFAULTS = {"source_lang": "Auto", "target_lang": "中文 (简体)", "domain": "general"}
IMPORT_DEFAULTS = {"source_lang": "en", "target_lang": "zh", "domain": "general"}


def _or(name: str, default: str) -> Column:
    return F.coalesce(not_empty(F.col(name)), F.lit(default))


def _new_id(*key: str) -> Column:
    return F.concat(F.lit("t-"), F.left(F.md5(F.concat_ws("\x1f", *key)), F.lit(16)))


def merge_terms(existing: DataFrame, incoming: DataFrame, now: str = "2024-01-01 00:00:00") -> DataFrame:
    """The merged termbase with a column ``change``: kept, updated or imported.

    The key is (source in lower case, languages, domain) with defaults for the incoming side.
    A hit raises the frequency by the number of incoming rows and takes the last one's texts;
    its flag is the last one given, else the old one. New keys enter once, with the rest of
    their rows as updates. If existing rows share a key, the first (by id) is the one updated.
    """
    own = Window.partitionBy("k_source", "k_sl", "k_tl", "k_domain").orderBy("id")
    old = existing.select(
        "*", F.lower(normalize_term(F.col("source"))).alias("k_source"), F.coalesce("source_lang", F.lit("")).alias("k_sl"),
        F.coalesce("target_lang", F.lit("")).alias("k_tl"), F.coalesce("domain", F.lit("")).alias("k_domain"),
    )
    old = old.withColumn("first", F.row_number().over(own) == 1)
    # Equal rows become one first: counts and largest seq fit a hash aggregate, what is left is a vocabulary.
    same = incoming.groupBy("source", "target", "source_lang", "target_lang", "domain", "confirmed").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("seq"))
    new = valid_terms(same, "n").select(
        "seq", "n", "source", "target", "confirmed", F.lower("source").alias("k_source"), _or("source_lang", DEFAULTS["source_lang"]).alias("k_sl"),
        _or("target_lang", DEFAULTS["target_lang"]).alias("k_tl"), _or("domain", DEFAULTS["domain"]).alias("k_domain"),
    )
    keys = ["k_source", "k_sl", "k_tl", "k_domain"]
    new = new.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.max_by(F.struct("source", "target"), "seq").alias("last"),
        F.max_by("confirmed", F.when(F.col("confirmed").isNotNull(), F.col("seq"))).alias("flag"),
    ).withColumn("first", F.lit(True))
    both = old.join(new, [*keys, "first"], "full_outer")
    hit, known = F.col("n").isNotNull(), F.col("id").isNotNull()
    stamp = F.lit(now).cast("timestamp")
    return both.select(
        F.coalesce("id", _new_id(*keys)).alias("id"),
        F.when(hit, F.col("last.source")).otherwise(F.col("source")).alias("source"),
        F.when(hit, F.col("last.target")).otherwise(F.col("target")).alias("target"),
        F.when(hit, F.col("k_sl")).otherwise(F.col("source_lang")).alias("source_lang"),
        F.when(hit, F.col("k_tl")).otherwise(F.col("target_lang")).alias("target_lang"),
        F.when(hit, F.col("k_domain")).otherwise(F.col("domain")).alias("domain"),
        (F.coalesce("frequency", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("long").alias("frequency"),
        F.when(hit, F.coalesce("flag", "confirmed", F.lit(False))).otherwise(F.col("confirmed")).alias("confirmed"),
        F.coalesce("created_at", stamp).alias("created_at"),
        F.when(hit, stamp).otherwise(F.col("updated_at")).alias("updated_at"),
        F.when(~hit, "kept").when(known, "updated").otherwise("imported").alias("change"),
        F.coalesce("n", F.lit(0)).cast("long").alias("rows_in"),
    )


def valid_terms(incoming: DataFrame, count: str | None = None) -> DataFrame:
    """Incoming rows with normalised texts, without empty and self-mapping ones.

    ``count``: a positive number of rows that became one. It stands in the condition, so that
    the test stays behind their aggregate and is made once for them all.
    """
    rows = incoming.withColumns({"source": normalize_term(F.col("source")), "target": normalize_term(F.col("target"))})
    good = (F.col("source") != "") & (F.col("target") != "") & (F.col("source") != F.col("target"))
    return rows.where(good if count is None else F.least(count, good.cast("int").cast("long")) > 0)


def merge_counts(merged: DataFrame, incoming: DataFrame) -> DataFrame:
    """imported, updated, skipped of one merge."""
    done = merged.agg(F.coalesce(F.sum("rows_in"), F.lit(0)).alias("valid"), F.count_if(F.col("change") == "imported").alias("imported"))
    total = incoming.agg(F.count(F.lit(1)).alias("total"))
    # two single rows
    return done.join(F.broadcast(total)).select("imported", (F.col("valid") - F.col("imported")).alias("updated"), (F.col("total") - F.col("valid")).alias("skipped"))


def import_terms_json(existing: DataFrame, entries: DataFrame, merge: bool = True) -> DataFrame:
    """Import of exported entries: the merged termbase with ``change`` and ``rows_in``.

    The key also holds the target, and uses the raw languages and domain, so an entry without
    languages never meets its own stored row again. A hit counts as skipped: with ``merge`` it
    raises the frequency and may confirm. Entries have ``seq`` besides the term columns.
    """
    key = ["k_source", "k_target", "k_sl", "k_tl", "k_domain"]

    def keyed(df: DataFrame) -> DataFrame:
        raw = {"k_sl": "source_lang", "k_tl": "target_lang", "k_domain": "domain"}
        return df.withColumns({"k_source": F.lower("source"), "k_target": F.lower("target"), **{k: F.coalesce(F.col(c), F.lit("")) for k, c in raw.items()}})

    # Equal entries become one first, by a hash aggregate.
    same = entries.groupBy("id", "source", "target", "source_lang", "target_lang", "domain", "frequency", "confirmed").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("seq"))
    new = keyed(same.where("coalesce(source, '') <> '' AND coalesce(target, '') <> ''"))
    new = new.groupBy(*key).agg(
        F.sum("n").alias("n"), F.min_by(F.struct("id", "source", "target", "frequency", "confirmed"), "seq").alias("e"),
        F.max(F.coalesce("confirmed", F.lit(False))).alias("any_confirmed"),
    )
    first = Window.partitionBy(*key).orderBy("id")
    old = keyed(existing).withColumn("first", F.row_number().over(first) == 1)
    both = old.join(new.withColumn("first", F.lit(True)), [*key, "first"], "full_outer")
    known = F.col("source").isNotNull()
    # A new key is stored with defaults; its later rows in the same file only meet it when it had none to fill in.
    complete = (F.col("k_sl") != "") & (F.col("k_tl") != "") & (F.col("k_domain") != "")
    again = F.when(known, F.coalesce("n", F.lit(0))).when(complete, F.col("n") - 1).otherwise(0)
    copies = F.when(known, 1).when(complete, 1).otherwise(F.col("n"))
    raised = again if merge else F.lit(0)
    flag = F.coalesce("any_confirmed", F.lit(False)) if merge else F.lit(False)
    out = both.select(
        F.coalesce(F.col("existing_id") if "existing_id" in both.columns else F.col("id"), not_empty(F.col("e.id")), _new_id(*key)).alias("id"),
        F.coalesce("source", "e.source").alias("source"), F.coalesce("target", "e.target").alias("target"),
        F.when(known, F.col("source_lang")).otherwise(F.coalesce(not_empty(F.col("k_sl")), F.lit(IMPORT_DEFAULTS["source_lang"]))).alias("source_lang"),
        F.when(known, F.col("target_lang")).otherwise(F.coalesce(not_empty(F.col("k_tl")), F.lit(IMPORT_DEFAULTS["target_lang"]))).alias("target_lang"),
        F.when(known, F.col("domain")).otherwise(F.coalesce(not_empty(F.col("k_domain")), F.lit(IMPORT_DEFAULTS["domain"]))).alias("domain"),
        (F.coalesce("frequency", "e.frequency", F.lit(1)) + raised).cast("long").alias("frequency"),
        (F.coalesce("confirmed", "e.confirmed", F.lit(False)) | flag).alias("confirmed"),
        F.when(known, "kept").otherwise("imported").alias("change"), F.explode(F.sequence(F.lit(1), copies.cast("int"))).alias("copy"),
        again.cast("long").alias("rows_skipped"),
    )
    return out.withColumn("id", F.when(F.col("copy") > 1, F.concat_ws("-", "id", F.col("copy").cast("string"))).otherwise(F.col("id"))).drop("copy")


def termbase_stats(terms: DataFrame) -> DataFrame:
    """total, confirmed, number of domains and of language pairs, and their sorted lists."""
    pair = F.concat("source_lang", F.lit("→"), "target_lang")
    domains, pairs = F.array_sort(F.collect_set(not_empty(F.col("domain")))), F.array_sort(F.collect_set(pair))
    return terms.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("confirmed").alias("confirmed"), F.array_join(domains, ",").alias("domains"), F.array_join(pairs, ",").alias("lang_pairs")
    )


def update_term(terms: DataFrame, term_id: str, **changes: object) -> DataFrame:
    """``terms`` with the given columns of one row changed."""
    return terms.withColumns({c: F.when(F.col("id") == term_id, F.lit(v)).otherwise(F.col(c)) for c, v in changes.items()})


def delete_terms(terms: DataFrame, ids: DataFrame) -> DataFrame:
    return terms.join(ids.select("id").distinct(), "id", "left_anti")


def mine_frequent_terms(blocks: DataFrame, stop_words: DataFrame, min_freq: int = 3, text: str = "text") -> DataFrame:
    """term, frequency of words that are frequent and no stop-words (a column ``term``)."""
    words = blocks.select(F.explode(F.split(F.lower(text), r"[^\p{L}]+")).alias("term")).where("term <> ''")
    counts = words.groupBy("term").agg(F.count(F.lit(1)).alias("frequency")).where(F.col("frequency") >= min_freq)
    return counts.join(stop_words, "term", "left_anti")


def _places(words: DataFrame, head: int, most: int) -> DataFrame:
    """head, tail, words: from every word of ``w`` on up to ``head`` words and those after them up to ``most``, and how many in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            flat, ends = lists.flatten(), np.cumsum(np.asarray(pc.list_value_length(lists)), dtype=np.int64)
            after = np.repeat(ends, np.diff(ends, prepend=0))
            for at in range(0, len(flat), PLACES):
                own = np.arange(at, min(at + PLACES, len(flat)))
                n = np.minimum(after[own] - own, most)
                # Beyond the end of a segment words are null and leave blanks at the end.
                nth = [flat.take(pa.array(own + k, mask=n <= k)) for k in range(most)]
                join = lambda x: pc.ascii_rtrim(pc.binary_join_element_wise(*x, " ", null_handling="replace", null_replacement=""), " ") if x else pa.repeat("", len(own))
                out = pa.RecordBatch.from_arrays([join(nth[:head]), join(nth[head:]), pa.array(n, pa.int32())], names=["head", "tail", "words"])
                yield out.sort_by([("head", "ascending"), ("tail", "ascending")])  # like ones together: the shuffle's blocks are smaller by it

    return words.select("w").mapInArrow(run, "head string, tail string, words int")


def _first_words(k: int, head: int) -> Column:
    if k <= head:
        return F.substring_index("head", " ", k) if k < head else F.col("head")
    return F.concat_ws(" ", "head", F.substring_index("tail", " ", k - head))


#: Places that leave Python at once.
PLACES = 1 << 18
#: Words by which places are dealt out: those of the filter's longest sequences.
DEALT = 3


def _close(gram: Column) -> Column:
    """Without the blanks between letters that are words by themselves."""
    return F.when(has_unspaced(gram), F.regexp_replace(gram, rf"(?<=[{UNSPACED}]\p{{M}}{{0,3}}) (?=[{UNSPACED}])", "")).otherwise(gram)


def mine_frequent_phrases(blocks: DataFrame, stop_words: DataFrame, min_freq: int = 3, max_words: int = 5, text: str = "text", maximal: bool = True) -> DataFrame:
    """term, words, frequency of sequences of 1 to ``max_words`` words that come ``min_freq`` times or more.

    Words follow each other with blanks alone between them; in scripts without blanks each
    letter is a word, and the term has none between. No term starts or ends with a stop-word (a
    column ``term``). With ``maximal``, terms inside a longer one that is found go.

    Two or three words that come less often by their hash are dropped first, by a filter of
    bounded size. What is left is added up inside tasks and dealt out once, by its first
    ``DEALT`` words, with those after them; all longer sequences that start there are then
    counted without another shuffle.
    """
    texts = materialize(blocks.where(F.col(text).isNotNull()).select(segmented(F.col(text)).alias("t")), "segmented")
    known = write_filter(texts, min_freq, min(max_words, DEALT) - 1) if max_words > 1 else None
    same = sequences(texts, known, max_words).repartition("head").groupBy("head", "tail", "words").agg(F.sum("n").alias("n"))
    size = F.col("words")
    one = lambda k: F.when(size == k if k < DEALT else size >= k, F.struct(F.lit(k).alias("words"), _first_words(k, DEALT).alias("gram")))
    found = same.where((size >= DEALT) | (F.col("n") >= min_freq)).select("head", "n", F.explode(F.array(*map(one, range(1, max_words + 1)))).alias("g")).where("g IS NOT NULL")
    # The head is part of the key, so equal sequences are in one place already.
    every = found.select("head", "n", "g.*").groupBy("head", "gram", "words").agg(F.sum("n").alias("frequency")).where(F.col("frequency") >= min_freq).drop("head")
    every = materialize(every, "frequent")
    stop = materialize(stop_words.select(F.col("term").alias("word")).distinct(), "stop")
    ends = every.withColumns({"first": F.substring_index("gram", " ", 1), "last": F.substring_index("gram", " ", -1)})
    good = ends.join(stop.withColumnRenamed("word", "first"), "first", "left_anti").join(stop.withColumnRenamed("word", "last"), "last", "left_anti").drop("first", "last")
    if maximal and max_words > 1:
        good = materialize(good, "phrases")
        parts = good.where("words > 1").select("words", F.split("gram", " ").alias("p"))
        part = lambda k, n: F.when(F.col("words") >= max(k + n, n + 1), F.concat_ws(" ", *(F.get("p", F.lit(i)) for i in range(k, k + n))))
        inner = parts.select(F.explode(F.array(*(part(k, n) for n in range(1, max_words) for k in range(max_words - n + 1)))).alias("gram")).where("gram IS NOT NULL")
        good = good.join(inner.distinct(), "gram", "left_anti")
    return good.select(_close(F.col("gram")).alias("term"), "words", "frequency")


def learn_from_edits(candidates: DataFrame, termbase: DataFrame, min_confidence: float = 0.5, per_edit: int = 3) -> DataFrame:
    """Merge the best candidates of each edit (doc_id, block_id, pos, source, target, confidence) as unconfirmed terms."""
    own = Window.partitionBy("doc_id", "block_id").orderBy("pos")
    good = candidates.where(F.col("confidence") >= min_confidence).withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= per_edit)
    rows = good.select(
        F.concat_ws(":", F.lpad(F.col("doc_id").cast("string"), 20, "0"), "block_id", F.lpad(F.col("pos").cast("string"), 6, "0")).alias("seq"), "source", "target",
        F.lit(None).cast("string").alias("source_lang"), F.lit(None).cast("string").alias("target_lang"), F.lit("proofread").alias("domain"), F.lit(False).alias("confirmed"),
    )
    return merge_terms(termbase, rows)
