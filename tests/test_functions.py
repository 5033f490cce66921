"""Golden and boundary cases of the scalar functions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from bitext.functions import predicates, python_text, register, text
from bitext.plans.inference import replace_terms


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def one(spark, value, f):
    return values(spark, [(value,)], "t string", f(F.col("t")).alias("x"))[0][0]


@pytest.mark.parametrize(("given", "expected"), [("  hello world  ", "hello world"), ("hello   world", "hello world"), ("", ""), (None, ""), ("hello\nworld\tfoo", "hello world foo"), ("a 　b", "a b")])
def test_normalize_term(spark, given, expected):
    assert one(spark, given, text.normalize_term) == expected


def test_detect_term_lang(spark):
    cases = {"你好世界": "zh-CN", "Hello World": "en", "こんにちは": "ja", "안녕하세요": "ko", "Привет": "ru", "مرحبا": "ar", "": "Auto", "你好 World": "zh-CN", "123": "Auto"}
    got = values(spark, [(k,) for k in cases], "t string", "t", text.detect_term_lang(F.col("t")))
    assert dict(got) == cases


def test_detect_text_lang_keeps_the_order_of_the_classes(spark):
    cases = {"Hello World": "fr", "Hello, World": "Auto", "été": "fr", "漢字": "zh-CN", "かな": "ja", "  ": "Auto", "größe": "fr"}
    assert dict(values(spark, [(k,) for k in cases], "t string", "t", text.detect_text_lang(F.col("t")))) == cases


def test_normalize_lang(spark):
    rows = [("Chinese (Simplified)",), (" JAPANESE ",), (" Auto",), ("",), ("Klingon",), (None,)]
    got = values(spark, rows, "t string", text.normalize_lang(F.col("t")), text.normalize_lang(F.col("t"), lower_unknown=False))
    assert got == [("zh", "zh"), ("ja", "ja"), ("en", "en"), ("en", ""), ("klingon", "Klingon"), ("en", None)]


TERMS = [
    ("Model Context Protocol", [("Protocol", "协议"), ("Model Context Protocol", "模型上下文协议")], "模型上下文协议"),
    ("hello world", [("", "x"), ("hello", ""), ("world", "地球")], "hello 地球"),
    ("The AI Strategy Framework guides AI governance.", [("AI governance", "AI治理"), ("guides", "指导"), ("AI Strategy Framework", "AI战略框架")], "The AI战略框架 指导 AI治理."),
    ("a.b A.B axb", [("a.b", "$1\\")], "$1\\ $1\\ axb"),
    ("one", [("one", "two"), ("two", "three")], None),
]


@pytest.mark.parametrize(("given", "terms", "expected"), TERMS)
def test_apply_terms_in_both_forms(spark, given, terms, expected):
    expected = replace_terms(given, terms) if expected is None else expected
    assert one(spark, given, lambda c: text.apply_terms(c, terms)) == expected
    ordered = F.array(*(F.struct(F.lit(s).alias("source"), F.lit(t).alias("target")) for s, t in text.longest_first(terms)))
    assert one(spark, given, lambda c: text.apply_terms(c, ordered)) == expected
    assert replace_terms(given, terms) == expected


def test_han_terms(spark):
    terms = [("AI", "人工智能"), ("Agent", "代理"), ("Deep Agent", "深度代理")]
    assert one(spark, "Deep Agent AI 测试", lambda c: text.fix_han_terms(c, terms)) == "深度智能体 AI 测试"
    assert one(spark, "Deep Agent", lambda c: text.fix_han_terms(c, terms)) == "Deep Agent"
    assert one(spark, " Agent 特工代理 ", lambda c: text.fix_full_terms(c, terms)) == "智能体 智能体"


def test_strip_meta(spark):
    cases = {"译文（此段落已准确翻译，无需修改）": "译文", "无需修改": "无需修改", "[3] Source: a\nb\n Translation: 译\n文": "译\n文", "plain": "plain"}
    assert dict(values(spark, [(k,) for k in cases], "t string", "t", text.strip_meta(F.col("t")))) == cases


def test_fences_and_refusals(spark):
    assert one(spark, '```json\n"x"\n```', lambda c: text.strip_fences(c, quotes=True)) == "x"
    rows = [(None, "s"), ("  ", "s"), ("Please provide more", "s"), (" ok ", "s")]
    assert [r[0] for r in values(spark, rows, "r string, s string", text.refusal_fallback(F.col("r"), F.col("s")))] == ["s", "s", "s", "ok"]


def test_preserved_tags(spark):
    got = one(spark, 'a <b>x</b> <b>y</b> **z** `c` [l](u) {$m$} {{v}} <span data-jo-id="1">q</span>', text.preserved_tags)
    assert got[:2] == ["<b>", "</b>"]
    assert {'<span data-jo-id="1">q</span>', "**z**", "`c`", "[l](u)", "{$m$}", "{{v}}"} <= set(got)
    assert len(got) == len(set(got))


def test_markup(spark):
    assert one(spark, " <p>a<br/>b</p> ", text.strip_html) == "ab"
    assert one(spark, "<a & 'b' \">", text.escape_xml) == "&lt;a &amp; &apos;b&apos; &quot;&gt;"
    assert one(spark, "&lt;a &amp;amp; b&gt;", text.unescape_xml) == "<a &amp; b>"


def test_width_and_font(spark):
    assert one(spark, "汉im,x", lambda c: text.text_width(c, F.lit(10.0))) == pytest.approx(10 + 3 + 7 + 3 + 5.2)
    fit = lambda size, width: one(spark, "xxxxxxxxxx", lambda c: text.fit_font(c, F.lit(size), F.lit(width)))
    assert fit(10.0, 100.0) == 10.0
    assert fit(10.0, 40.0) == pytest.approx(10 * 40 / 52)
    assert fit(10.0, 1.0) == pytest.approx(6.0)
    assert fit(2.0, 0.0) == 6.0


CONFIDENCE = [
    ("", "x", "Concise", 0.5), ("a", "a", "Concise", 0.6), ("abcdefghij", "x" * 12, "Concise", 0.85), ("abcdefghij", "x" * 14, "Concise", 0.75), ("abcdefghij", "x" * 40, "Concise", 0.3),
    ("a\nb", "c\nd", "PreserveLayout", 0.85), ("a\nb", "cd", "PreserveLayout", 0.5), ("abcdefghij", "xx", "ExpandAllowed", 0.8), ("abcdefghij", "x" * 20, None, 0.8), ("abcdefghij", "x", None, 0.4),
]


def test_confidence(spark):
    rows = [(o, t, c, e) for o, t, c, e in CONFIDENCE]
    got = values(spark, rows, "o string, t string, c string, e double", text.estimate_confidence(F.col("o"), F.col("t"), F.col("c")), "e")
    assert [round(float(a), 9) for a, _ in got] == [e for _, e in got]


def test_classify_constraint(spark):
    rows = [("code", 500.0, None), ("label", 500.0, "ExpandAllowed"), ("paragraph", 199.0, None), ("paragraph", 200.0, "Concise"), ("paragraph", None, "nonsense"), ("paragraph", None, None)]
    got = values(spark, rows, "n string, w double, h string", text.classify_constraint(F.col("n"), F.col("w"), F.col("h")))
    assert [g[0] for g in got] == ["PreserveLayout", "Concise", "Concise", "Concise", "ExpandAllowed", "ExpandAllowed"]


def test_small_helpers(spark):
    assert one(spark, "这个很好。其他", text.trim_tail) == "这个很好"
    assert one(spark, "协议很重要", text.trim_tail) == "协议"
    assert one(spark, "important", text.trim_tail) == "important"
    assert one(spark, "abcdef", lambda c: text.truncate(c, 3)) == "abc"
    assert one(spark, "ab", lambda c: text.merge_short(c, F.array(F.lit("ab"), F.lit(" "), F.lit("cd")))) == "ab cd"
    assert one(spark, "ab", lambda c: text.merge_short(c, F.array(F.lit("ab")))) == "ab"
    new, changed = text.find_replace(F.col("t"), "a", "b")
    assert values(spark, [("aa",), ("x",)], "t string", new, changed) == [("bb", True), ("x", False)]


PREDICATES = {
    "": (True, False, True, False), "a": (True, False, True, False), "12": (True, True, True, False), "12.5%": (True, False, True, False), "123-45 6": (True, True, True, False), "1234567": (True, False, True, False),
    "12345678901": (True, False, False, False), "abc": (False, False, False, False), "汉字": (False, False, True, True),
}


def test_predicates(spark):
    names = (predicates.skip_text, predicates.skip_numeric_short, predicates.skip_short_number, predicates.has_han)
    got = values(spark, [(k,) for k in PREDICATES], "t string", "t", *(f(F.col("t")) for f in names))
    assert {r[0]: r[1:] for r in got} == PREDICATES


def test_clean_text():
    assert python_text.clean_text("季\n度报告\r\nABC\nDEF\n\n\n\nx (Jìdù)") == "季度报告\nABC DEF\n\nx"
    assert python_text.clean_text(None) == ""
    assert python_text.clean_text("ＡＢ①") == "AB1"


def test_reapply_tags():
    assert python_text.reapply_tags("<b>ab</b>cd", "wxyz") == "<b>wx</b>yz"
    assert python_text.reapply_tags("ab<i>cd", "wx<b>yz") == "wx<i>yz</i>"
    assert python_text.reapply_tags("a<b></b>b", "xy") == "x<b></b>y"
    assert python_text.reapply_tags("plain", "x<b>y") == "xy"


def test_sql_functions(spark):
    register.register_functions(spark)
    row = spark.sql("SELECT normalize_term(' a  b '), strip_html('<p> x </p>'), escape_xml('<&'), skip_text('12%'), has_han('汉'), text_width('汉i', 10D), length_ratio('ab', 'abc')").first()
    assert tuple(row) == ("a b", "x", "&lt;&amp;", True, True, 13.0, 1.5)
    row = spark.sql(
        "SELECT detect_term_lang('かな'), normalize_lang(' Korean'), skip_numeric_short('12-3'), contains_cjk('x'), strip_fences('```a\nb\n```'), classify_constraint('p', 10D, NULL), drift_severity('abcd', 'abcdefgh'), overflow_severity('a', 'ab'), estimate_confidence('a\nb', 'c\nd', 'PreserveLayout')"
    ).first()
    assert tuple(row) == ("ja", "ko", True, False, "b", "Concise", "low", "high", 0.85)


def test_strip_looks_at_the_ends_alone(spark):
    import re

    from bitext.functions import compat

    blank = "".join(chr(i) for i in range(0x10000) if not 0xD800 <= i < 0xE000 and re.match("[ \\t-\\r\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]", chr(i)))
    assert sorted(blank) == sorted(compat.BLANKS)
    texts = [None, "", " ", blank, *(f"{b}a{b}b{b}" for b in blank), "a\u200b ", "\u0085x\u0085", "𝒳 \n", "\n 中 文\r\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    old = F.regexp_replace("t", f"^{compat.WS}+|{compat.WS}+$", "")
    done = df.select(compat.strip(F.col("t")).alias("new"), old.alias("old"))
    assert done.where("NOT new <=> old").count() == 0
    assert "regexp" not in df.select(compat.strip(F.col("t")))._jdf.queryExecution().analyzed().toString().lower()


def test_all_sql_functions_compare_in_generated_code(spark):
    from bitext import queries

    plan = queries.x6_all_sql_functions(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(array(" not in plan and "concat_ws(" in plan.split("ArrowEvalPython")[0]
