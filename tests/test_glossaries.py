"""Frequent phrases, large glossaries and SQL functions against plain forms."""

from __future__ import annotations

import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bitext import inputs, queries
from bitext.functions import register, text
from bitext.operators import sequences, terms
from bitext.plans import glossary_pass, requests

SF = "/root/testdata/sf0.001"
HAN = "[一-鿿ぁ-ヿ]"


def phrases(texts, stop, low, high, maximal):
    counts = Counter()
    for t in texts:
        for segment in re.findall(r"(?:[^\W\d_]|\s)+", (t or "").lower()):
            words = re.findall(rf"{HAN}|(?:(?!{HAN})[^\W\d_])+", segment)
            counts.update(tuple(words[i : i + n]) for n in range(1, high + 1) for i in range(len(words) - n + 1))
    found = {g: n for g, n in counts.items() if n >= low and g[0] not in stop and g[-1] not in stop}
    inner = {g[i : i + n] for g in found for n in range(1, len(g)) for i in range(len(g) - n + 1)}
    show = lambda g: re.sub(rf"(?<={HAN}) (?={HAN})", "", " ".join(g))
    return sorted((show(g), len(g), n) for g, n in found.items() if not maximal or g not in inner)


@pytest.mark.parametrize(("high", "maximal"), [(5, True), (3, False)])
def test_phrases_equal_brute_force(spark, high, maximal):
    r = random.Random(8)
    words = ["bank", "account", "of", "the", "state", "Über", "art"]
    texts = [r.choice([" ", ", ", "\n"]).join(r.choices(words, k=r.randint(0, 9))) for _ in range(60)]
    texts += ["你好世界今天天气很好", "你好世界, 天气很好 bank account", "今天天气很好 你好世界", "state of the art"] * 2 + [None, "", "1 2 3", "a1b a1b a1b"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    stop = spark.createDataFrame([("of",), ("the",)], "term string")
    got = terms.mine_frequent_phrases(df, stop, 3, high, maximal=maximal)
    assert sorted((x.term, x.words, x.frequency) for x in got.collect()) == phrases(texts, {"of", "the"}, 3, high, maximal)
    assert terms.mine_frequent_phrases(df.limit(0), stop).collect() == []


def test_large_glossaries_equal_the_sequential_form(spark):
    r = random.Random(9)
    word = lambda n: "".join(r.choices("abAB éÉ$.\\", k=r.randint(1, n)))
    pairs = [(word(4), word(4)) for _ in range(60)] + [("", "x"), ("y", ""), ("ab", "ba"), ("AB", "q"), ("ß", "SS"), ("İ", "i")]
    lines = [word(30) + r.choice(["", "İß", "ſ"]) for _ in range(200)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(lines)), "id int, text string")
    glossary = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "ord int, source string, target string")
    got = {x.id: x.translated for x in glossary_pass.apply_glossary(df, glossary).collect()}
    want = {x.id: x.t for x in df.select("id", text.apply_terms(F.col("text"), pairs).alias("t")).collect()}
    assert got == want
    assert glossary_pass.apply_glossary(df, glossary.limit(0)).where("translated <> coalesce(text, '')").count() == 0
    with pytest.raises(ValueError):
        glossary_pass.apply_glossary(df, glossary.withColumn("source", F.repeat("target", F.lit(10**6))).where("target <> ''"))


def test_the_work_does_not_grow_with_the_glossary():
    import time

    r = random.Random(10)
    words = ["".join(r.choices("abcdefghij", k=8)) for _ in range(2000)]
    texts = [" ".join(r.choices(words[:20], k=4) + ["".join(r.choices("klmnop", k=6)) for _ in range(200)]) for _ in range(300)]

    def seconds(n):
        known = glossary_pass.Glossary([(w, w[::-1]) for w in words[:n]])
        start = time.process_time()
        out = [known.apply(t) for t in texts]
        return time.process_time() - start, out

    (few, a), (many, b) = seconds(20), seconds(2000)
    assert a == b and many <= 2 * few + 0.2


def test_the_work_does_not_grow_with_the_square_of_the_terms_in_a_text():
    import time

    r = random.Random(11)
    words = ["".join(r.choices("abcdefghij", k=r.randint(4, 8))) for _ in range(2000)]
    known = glossary_pass.Glossary([(w, w[::-1]) for w in words])

    def seconds(n):
        text = " ".join(words[:n] + [w + w for w in words[:n]])
        start = time.process_time()
        return known.apply(text), time.process_time() - start

    (_, few), (_, many) = seconds(200), seconds(2000)
    assert many <= 25 * few + 0.2


@pytest.mark.parametrize("letters", ["ab", "abcA", "aßẞİiIſs b", "ab.[]^-\\ "])
def test_glossary_in_turn_equals_plain_python(letters):
    r = random.Random(letters)
    for _ in range(2000):
        terms = [("".join(r.choices(letters, k=r.randint(1, 4))), "".join(r.choices(letters + ",", k=r.randint(1, 5)))) for _ in range(r.randint(0, 6))]
        text = "".join(r.choices(letters + ",", k=r.randint(0, 25)))
        want = text
        for source, target in glossary_pass.longest_first(terms):
            parts, at = [], 0
            while (k := glossary_pass.fold(want).find(glossary_pass.fold(source), at)) >= 0:
                parts += [want[at:k], target]
                at = k + len(source)
            want = "".join([*parts, want[at:]])
        assert glossary_pass.Glossary(terms).apply(text) == want, (terms, text)


def test_table_function_equals_the_operator(spark):
    key = lambda rows: sorted(tuple(x) for x in rows)
    assert key(queries.x6_lateral_term_candidates(spark, SF).collect()) == key(queries.x5_term_candidates(spark, SF).collect()) != []


def test_functions_are_columns_too(spark):
    register.register_functions(spark)
    row = spark.createDataFrame([("the `x` and <b>y</b>", "ab")], "t string, u string").select(register.column("strip_html", F.col("t")).alias("a"), register.column("find_replace", F.col("u"), F.lit("a"), F.lit("$1")).alias("b")).first()
    assert tuple(row) == ("the `x` and y", "$1b")
    odd = spark.createDataFrame([(x, y) for x in (None, "", " \u3000", "```js\nx\n```", "[1] Source: a\n Translation: 好", "（此段落已翻译）", "特工代理 API", "It is. important", "1.5%") for y in (None, "", "zh", "Please provide")], "t string, u string")
    both = queries._both_forms()
    for name, (form, call) in both.items():
        assert odd.where(~F.expr(call).eqNullSafe(form)).count() == 0, name
    assert set(both) | {"strip_meta_notes", "drift_severity", "overflow_severity"} == {f[0] for f in register.FUNCTIONS}


def test_batches_take_a_bounded_glossary(spark):
    blocks = spark.createDataFrame([(1, k, f"t{k}") for k in range(3)], "doc_id long, seq int, text string")
    glossary = spark.createDataFrame([(k, f"s{k}", f"t{k}") for k in range(300)], "ord long, source string, target string")
    lines = requests.batch_requests(blocks, glossary, terms=5).first().glossary.split("\n")
    assert lines == [f"s{k} → t{k}" for k in range(5)]
    assert len(requests.batch_requests(blocks, glossary).first().glossary.split("\n")) == 120


def test_places_of_phrases_go_over_no_border(spark, monkeypatch):
    monkeypatch.setattr(terms, "PLACES", 3)
    lists = [["a"], ["b", "c"], [], ["d", "e", "f", "g", "h", "i"], ["é", "中"]]
    df = spark.createDataFrame([(x,) for x in lists], "w array<string>").coalesce(1)
    for head, most in ((3, 5), (1, 1), (2, 2), (2, 6)):
        got = sorted(map(tuple, terms._places(df, head, most).collect()))
        want = sorted((" ".join(w[i : i + head]), " ".join(w[i + head : i + most]), len(w[i : i + most])) for w in lists for i in range(len(w)))
        assert got == want


@pytest.mark.parametrize("most", [1, 2, 3, 6])
def test_phrases_of_any_length_equal_plain_counts(spark, most):
    texts = ["a b c d e f g", "x a b c d e f", "a b a b a b a b", "b c d"] * 2
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    none = spark.createDataFrame([], "term string")
    counts = Counter(" ".join(w[i : i + n]) for t in texts for w in [t.split()] for n in range(1, most + 1) for i in range(len(w) - n + 1))
    got = {(r.term, r.words): r.frequency for r in terms.mine_frequent_phrases(df, none, max_words=most, maximal=False).collect()}
    assert got == {(g, g.count(" ") + 1): n for g, n in counts.items() if n >= 3}


def test_phrases_deal_out_only_what_may_be_frequent(spark, monkeypatch):
    seen = []
    deal = terms.sequences
    monkeypatch.setattr(terms, "sequences", lambda *a: seen.append(deal(*a)) or seen[-1])
    once = [" ".join(f"{w}{chr(97 + k)}{chr(97 + j)}" for w in ("un", "du", "tri", "quad")) for k in range(20) for j in range(20)]
    df = spark.createDataFrame([(t,) for t in [*once, *["to be or not to be"] * 3]], "text string")
    none = spark.createDataFrame([], "term string")
    got = terms.mine_frequent_phrases(df, none, 3, 6)
    assert [tuple(r) for r in got.collect()] == [("to be or not to be", 6, 3)]
    dealt = seen[0].where("words > 1").collect()
    # Of some 2,800 sequences by chance one or other might pass, not more.
    assert {(r["head"], r["tail"]) for r in dealt} >= {("to be", ""), ("to be or", "not to be"), ("not to be", "")} and len({r["head"] for r in dealt}) < 20


def test_phrases_of_odd_texts_equal_brute_force(spark):
    r = random.Random(10)
    words = ["a", "of", "été", "ñu", "的", "straße", "ไทย", "x́"]
    texts = [r.choice([" ", "  ", ", ", "\t", " – ", "𝟙"]).join(r.choices(words[:6], k=r.randint(0, 12))) for _ in range(80)] + [None, "", " ", "…", "a"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    stop = spark.createDataFrame([("of",)], "term string")
    for maximal in (True, False):
        got = terms.mine_frequent_phrases(df, stop, 3, 5, maximal=maximal)
        assert sorted((x.term, x.words, x.frequency) for x in got.collect()) == phrases(texts, {"of"}, 3, 5, maximal)


class Here:
    """Stands for texts: what is mapped over them runs in this process."""

    def __init__(self, texts):
        self.batches = [pa.RecordBatch.from_arrays([pa.array(texts[k : k + 3], pa.string())], names=["t"]) for k in range(0, len(texts), 3)]

    def mapInArrow(self, run, schema):  # noqa: N802
        return [r for b in run(iter(self.batches)) for r in b.to_pylist()]


@pytest.mark.parametrize("size", [1, 30, 1 << 20])
def test_sequences_of_chunks_of_any_size(monkeypatch, size):
    for name in ("CHUNK", "MERGED", "ROWS"):
        monkeypatch.setattr(sequences, name, size)
    monkeypatch.setattr(sequences, "_read_filter", lambda path, log: np.full(1 << 17, 255, np.uint8))
    texts = ["a b c d e f g", "b c d, a b", "", "é", "é é é é a", ".", "a b c d e f g", " b  c\td "]
    segments = [s.split() for t in texts for s in re.findall(r"[^,.]+", t)]
    want = Counter()
    for w in segments:
        for i in range(len(w)):
            want.update((" ".join(w[i : i + n]), "", n) for n in (1, 2) if i + n <= len(w))
            if i + 3 <= len(w):
                want[" ".join(w[i : i + 3]), " ".join(w[i + 3 : i + 5]), len(w[i : i + 5])] += 1
    got = Counter()
    for r in sequences.sequences(Here([sequences.BREAK + t for t in texts]), ("", 0), 5):
        got[r["head"], r["tail"], r["words"]] += r["n"]
    assert got == want


@pytest.mark.parametrize("log", [0, 3, 9])
def test_the_filter_passes_what_is_in_it(monkeypatch, log):
    h = np.random.default_rng(11).integers(0, 1 << 44, 200_000, np.uint64)
    known, bits = h[: (1 << sequences.SLICE + log) // sequences.EACH][:100_000], np.zeros(1 << sequences.SLICE + log, bool)
    for at in sequences._bits(known, log):
        assert (at >> np.uint64(sequences.SLICE) == known >> np.uint64(44 - log)).all()
        bits[at] = True
    monkeypatch.setattr(sequences, "_read_filter", lambda path, log: np.packbits(bits))
    got = sequences._passing("", log, h, np.arange(len(h)) != 5)
    assert got[: len(known)].sum() == len(known) - 1 and not got[5]
    assert got[100_000:].sum() < 2_000


def test_kinds_of_characters(spark):
    codes = [*range(1, 0x3000), *range(0xFB00, 0x10400), *range(0x1D400, 0x1D7FF), *range(0x20000, 0x20100), 0x10FFFF]
    text = "".join(map(chr, codes)).encode()
    kinds = sequences._kinds(np.frombuffer(text, np.uint8))
    sizes = [len(chr(c).encode()) for c in codes]
    want = [0 if unicodedata.category(chr(c))[0] in "LM" else 1 if chr(c) in " \t\n\f\r" else 2 for c in codes]
    assert kinds.tolist() == [k for k, n in zip(want, sizes, strict=True) for _ in range(n)]
    # Java knows fewer characters as letters, none that is no letter here.
    df = spark.createDataFrame([(c, chr(c)) for c in codes if c < 0x800], "code int, c string")
    assert {r.code for r in df.where(F.col("c").rlike(r"[\p{L}\p{M}]")).collect()} == {c for c, k in zip(codes, want, strict=True) if k == 0 and c < 0x800}


def test_patterns_meet_each_form_of_a_word_once(spark):
    got = inputs.distinct_words(spark, SF)
    assert sorted(got.collect()) == sorted(inputs.words(spark, SF).select("word").distinct().collect())
    first = got._jdf.queryExecution().optimizedPlan().toString().rsplit("Aggregate", 1)[1].split("\n", 1)[1]
    assert "regexp_replace" not in first and "RLIKE" not in first
