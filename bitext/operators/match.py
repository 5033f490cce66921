"""Terms in texts: the contains join, in two physical forms, and glossary filters."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitext.ranks import with_rank
from bitext.storage import materialize

#: Glossary rows, and bytes of their texts, up to which all terms go along with every text.
SMALL_GLOSSARY, SMALL_BYTES = 2000, 1 << 20
#: Bytes of terms up to which every worker holds them as an automaton, of about 20 times that size.
AUTOMATON_BYTES = 8 << 20
#: Characters of a gram; shorter terms are grams themselves.
GRAM = 3


def relevant_glossary(blocks: DataFrame, glossary: DataFrame, keys: tuple[str, ...] = ("doc_id", "seq"), text: str = "text", small: int = SMALL_GLOSSARY, automaton: int = AUTOMATON_BYTES) -> DataFrame:
    """keys, source, target: every glossary row whose source occurs in the text, in any case; equal rows each count.

    Up to ``small`` rows of ``SMALL_BYTES``, counted first, the glossary is one array next to
    each text; up to ``automaton`` bytes it is an automaton in every worker. Beyond, terms are
    found by their rarest gram.
    """
    terms = glossary.where(F.col("source") != "").select("source", "target")
    rows, size = terms.agg(F.count(F.lit(1)), F.coalesce(F.sum(_bytes("source", "target")), F.lit(0))).first()
    if rows <= small and size <= SMALL_BYTES:
        return _by_array(blocks, terms, keys, text)
    return (_by_automaton if size <= automaton else _by_gram)(blocks, terms, keys, text)


def _bytes(*columns: str) -> Column:
    """About what a row of these texts takes in memory."""
    return sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in columns), F.lit(16 * len(columns)))


def _by_array(blocks: DataFrame, terms: DataFrame, keys: tuple[str, ...], text: str) -> DataFrame:
    # One row, bounded by the caller's count.
    row = terms.agg(F.collect_list(F.struct("source", "target")).alias("terms"))
    texts = blocks.select(*keys, F.lower(text).alias("low")).join(F.broadcast(row))
    hits = texts.select(*keys, F.explode(F.filter("terms", lambda t: F.col("low").contains(F.lower(t["source"])))).alias("t"))
    return hits.select(*keys, "t.source", "t.target")


def grams(c: Column, sizes: tuple[int, ...] = (GRAM,)) -> Column:
    """Distinct character n-grams of a text; overlapping ones come from matches of no length."""
    parts = [F.regexp_extract_all(c, F.lit(rf"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in sizes]
    return F.array_distinct(F.concat(*parts))


def _by_automaton(blocks: DataFrame, terms: DataFrame, keys: tuple[str, ...], text: str) -> DataFrame:
    """One pass over each text finds all terms in it (Aho and Corasick, 1975).

    The automaton holds every distinct source once; its words, bounded by ``AUTOMATON_BYTES``,
    go to the workers, which build it once each. A text gives the numbers of the words found;
    texts are neither copied nor shuffled.
    """
    known = terms.groupBy(F.lower("source").alias("key"), "source", "target").agg(F.count(F.lit(1)).alias("copies"))
    words = sorted(r[0] for r in known.select("key").distinct().collect())
    number = {w: n for n, w in enumerate(words)}
    of_word = {}
    for r in known.collect():
        of_word.setdefault(number[r.key], []).append((r.source, r.target, r.copies))
    rows = [(n, s, t, c) for n, found in of_word.items() for s, t, c in found]
    table = blocks.sparkSession.createDataFrame(rows, "number int, source string, target string, copies long")

    @F.arrow_udf("array<int>")
    def find(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = ahocorasick.Automaton()
        for n, w in enumerate(words):
            machine.add_word(w, n)
        machine.make_automaton()
        for some in texts:
            yield pa.array([sorted({n for _, n in machine.iter(t)}) if t else [] for t in some.to_pylist()], pa.list_(pa.int32()))

    hits = blocks.select(*keys, find(F.lower(text)).alias("numbers")).select(*keys, F.explode("numbers").alias("number"))
    # As many rows as the glossary, which is bounded above.
    return _each_copy(hits.join(F.broadcast(table), "number").select(*keys, "source", "target", "copies"), keys)


def _each_copy(hits: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return hits.select(*keys, "source", "target", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("col")


def _by_gram(blocks: DataFrame, terms: DataFrame, keys: tuple[str, ...], text: str) -> DataFrame:
    """Equi-join on one gram per term; then verify.

    Terms shorter than a gram are their own gram, so no list of terms meets every text. Each
    term goes by the gram that fewest texts have; the texts' grams go to them without the
    texts, and only the texts of candidates are joined again, by their keys.
    """
    key = F.lower("source")
    terms = terms.groupBy("source", "target").agg(F.count(F.lit(1)).alias("copies"))
    of_terms = terms.select("source", "target", "copies", key.alias("key"), F.explode(F.when(F.length(key) < GRAM, F.array(key)).otherwise(grams(key))).alias("gram"))
    # A handful of rows: the lengths that grams have, up to GRAM.
    sizes = tuple(sorted(r[0] for r in of_terms.select(F.length("gram")).distinct().collect()))
    texts = blocks.select(*keys, F.lower(text).alias("low"))
    found = texts.select(*keys, F.explode(grams(F.col("low"), sizes)).alias("gram"))
    known = materialize(of_terms.select("gram").distinct(), "grams")
    counts = found.join(known, "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # A term with a gram that no text has matches nothing.
    rare = of_terms.join(counts, "gram", "left").groupBy("source", "target", "copies", "key").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("m"))
    anchors = materialize(rare.where("m.n > 0").select("source", "target", "copies", "key", F.col("m.gram").alias("gram")), "anchors")
    candidates = found.distinct().join(anchors, "gram").drop("gram")
    hits = texts.join(candidates, list(keys)).where(F.col("low").contains(F.col("key")))
    return _each_copy(hits, keys)


def terms_by_lang_pair(terms: DataFrame, source_lang: str, target_lang: str) -> DataFrame:
    return terms.where((F.col("source_lang") == source_lang) & (F.col("target_lang") == target_lang))


def terms_by_domain(terms: DataFrame, domain: str) -> DataFrame:
    return terms.where(F.col("domain") == domain)


def active_terms(terms: DataFrame, source_lang: str, target_lang: str, enabled: bool = True) -> DataFrame:
    """Terms usable for a language pair; none while the termbase is off."""
    s, t = F.coalesce("source_lang", F.lit("")), F.coalesce("target_lang", F.lit(""))
    source_ok = (s == "") | (s == source_lang) | F.lit(source_lang == "Auto")
    return terms.where(F.lit(enabled) & source_ok & ((t == "") | (t == target_lang)))


def ranked(terms: DataFrame, limit: int) -> DataFrame:
    """Confirmed terms first, then by falling frequency; ids break ties. A top-k, not a full sort."""
    return terms.orderBy(F.desc("confirmed"), F.desc("frequency"), "id").limit(limit)


def prompt_glossary(terms: DataFrame, source_lang: str, target_lang: str, limit: int = 80) -> DataFrame:
    return ranked(terms_by_lang_pair(terms, source_lang, target_lang), limit)


def active_glossary(terms: DataFrame, source_lang: str, target_lang: str, enabled: bool = True, limit: int = 120) -> DataFrame:
    return ranked(active_terms(terms, source_lang, target_lang, enabled), limit)


def search_terms(terms: DataFrame, query: str, limit: int = 300) -> DataFrame:
    """Terms with the query in source, target or domain, in any case."""
    joined = F.lower(F.concat_ws(" ", "source", "target", "domain"))
    return terms.where(joined.contains(query.lower())).orderBy("id").limit(limit)


def search_pairs(bitext: DataFrame, query: str) -> DataFrame:
    q = query.lower()
    return bitext.where(F.lower("original").contains(q) | F.lower("translated").contains(q))


def glossary_rows(terms: DataFrame, source_lang: str, target_lang: str) -> DataFrame:
    """rank (from 0), source, target of the exact pair's terms, longest source first; of equal sources the last (by id) wins.

    The order goes over ranges of the whole table, so no task holds a language pair.
    """
    last = terms_by_lang_pair(terms, source_lang, target_lang).groupBy("source").agg(F.max_by("target", "id").alias("target"))
    return with_rank(last, [F.length("source").desc(), F.col("source")]).select("rank", "source", "target")


def glossary_map(terms: DataFrame, source_lang: str, target_lang: str) -> DataFrame:
    """One row: JSON map of the exact pair's terms, longest source first; of equal sources the last wins.

    For glossaries that fit a request; ``glossary_rows`` has the same for any size.
    """
    own = terms_by_lang_pair(terms, source_lang, target_lang)
    last = own.groupBy("source").agg(F.max_by("target", "id").alias("target"))
    entries = F.array_sort(
        F.collect_list(F.struct((-F.length("source")).alias("n"), "source", "target"))
    )
    return last.agg(F.to_json(F.map_from_entries(F.transform(entries, lambda e: F.struct(e["source"], e["target"])))).alias("glossary"))
