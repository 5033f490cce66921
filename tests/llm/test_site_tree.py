"""Main text on pages where markup and sizes mislead, and the importances of a site against plain Python."""

from __future__ import annotations

import math
import random
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from bitext.llm import sitetree

LONG = " ".join(f"<p>I think that {k} is right, and you?</p>" for k in range(40))
STORY = "<p>The story of the day.</p><p>It goes on.</p>"
TEXT = "The story of the day.\nIt goes on."

PAGES = {
    f"<body><div class='post'>{STORY}</div><div class='comments'>{LONG}</div></body>": TEXT,
    f"<body><article>{STORY}<section class='comments'>{LONG}</section></article></body>": TEXT,
    f"<body><main><article>{STORY}</article><section id='comments'>{LONG}</section></main></body>": TEXT,
    f"<body><div>{STORY}</div><div class='cookie-consent'>{LONG}</div></body>": TEXT,
    f"<body><div>{STORY}</div><ul>{''.join(f'<li><article><b>Name {k}</b><p>My long comment number {k}, with many words.</p></article></li>' for k in range(9))}</ul></body>": TEXT,
    f"<body><article>{STORY}<article><p>A reply to it, longer than the story itself, by a reader.</p></article></article></body>": TEXT,
    "<p>Let <math><mi>x</mi></math> be.</p>": "Let x be.",
    "<p>Shown <span aria-hidden='true'>to all</span></p>": "Shown to all",
    f"<body><ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li><li><a href='/c'>Contact</a></li></ul><div>{STORY}</div></body>": TEXT,
    f"<article>{STORY}<ul><li><a href='/1'>one</a></li><li><a href='/2'>two</a></li><li><a href='/3'>three</a></li></ul></article>": TEXT + "\none\ntwo\nthree",
    f"<body><div class='post comments-open has-sidebar'>{STORY}</div></body>": TEXT,
    f"<body><form action='/'><h1>T</h1>{STORY}<input></form></body>": "T\n" + TEXT,
    f"<body><div>{STORY}</div><form>{LONG}<input><button>Send</button></form></body>": TEXT,
    "<ul><li><article><p>first post</p></article></li><li><article><p>second post</p></article></li></ul>": "first post\nsecond post",
}


@pytest.mark.parametrize("html", PAGES)
def test_furniture_goes_whatever_its_size(html):
    assert sitetree.main_text(html) == PAGES[html]


@pytest.mark.parametrize("html", list(PAGES)[:4])
def test_on_modelled_hosts_too(html):
    high = frozenset(n[0] for n in sitetree.page_nodes(html))
    assert sitetree.main_text(html, modelled=True, high=high) == PAGES[html]


def plain_importances(pages):
    """importance of (path) by recursion over the merged tree of one host."""
    style, content, parent = defaultdict(Counter), defaultdict(Counter), {}
    for html in pages:
        for path, up, level, _, s, c in sitetree.page_nodes(html):
            style[path][s] += 1
            content[path][s, c] += c != 0
            parent[path] = up if level else None
    kept = {p for p, s in style.items() if sum(s.values()) >= sitetree.MIN_PAGES}

    def entropy(counts):
        n = sum(counts)
        return 1.0 if n <= 1 else -sum(c / n * math.log(c / n) for c in counts if c) / math.log(n)

    def importance(p):
        kids = [importance(k) for k in kept if parent[k] == p]
        inner = any(s for s in style[p])
        texts = [sum(v for (t, c), v in content[p].items() if t == s and c) for s in style[p]]
        own = None
        if sum(texts):
            n = sum(texts)
            nln = sum(v * math.log(v) for v in content[p].values() if v)
            own = 1.0 if n <= 1 else (math.log(n) - nln / n) / math.log(n)
        parts = [*kids, *([own] if own is not None else [])]
        presentation = entropy(style[p].values()) if inner else None
        part = max(parts) if parts else presentation or 0.0
        if presentation is None:
            return part
        decay = sitetree.GAMMA ** max(1, len(kids))
        return (1 - decay) * presentation + decay * part

    return {p: importance(p) for p in kept}


def random_page(r, depth):
    def node(d):
        if d == 0 or r.random() < 0.2:
            return r.choice(["same text", f"text {r.randint(0, 3)}", f"text {r.random()}", ""])
        tag = r.choice(["div", "section", "div class='a'", "nav", "p"])
        return "".join(f"<{tag}>{node(d - 1)}</{tag.split()[0]}>" for _ in range(r.randint(1, 3)))

    return f"<html><body>{node(depth)}</body></html>"


def test_importances_equal_plain_python(spark):
    r = random.Random(4)
    hosts = {f"h{k}.org": [random_page(r, 5) for _ in range(30)] for k in range(3)}
    hosts["deep.org"] = ["<div>" * 37 + f"<p>{i % 3}</p>" + "</div>" * 37 for i in range(12)]
    rows = spark.createDataFrame([(h, i, path, up, level, s, c, m) for h, pages in hosts.items() for i, html in enumerate(pages) for path, up, level, m, s, c in sitetree.page_nodes(html)],
                                 "host string, page int, path long, parent long, level long, style long, content long, marked long")
    pages = spark.createDataFrame([(k, f"http://{h}/", html) for h, ps in hosts.items() for k, html in enumerate(ps)], "page_id long, url string, html string")
    assert rows.count() > 0
    seen = {}
    original = sitetree.importances

    def spy(stats, deepest):
        out = original(stats, deepest)
        seen["rows"] = out.collect()
        return out

    sitetree.importances = spy
    try:
        sitetree.site_model(sitetree.with_host(pages))
    finally:
        sitetree.importances = original
    want = {(h, p): x for h, ps in hosts.items() for p, x in plain_importances(ps).items()}
    got = {(x.host, x.path): x.importance for x in seen["rows"]}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_deep_pages_take_few_rounds(spark):
    html = "<div>" * 1000 + "<p>deep text</p>" + "</div>" * 1000
    pages = spark.createDataFrame([(i, "http://h.org/", html.replace("deep", f"deep {i}")) for i in range(6)], "page_id long, url string, html string")
    start = time.time()
    assert sorted(r.text for r in sitetree.extract(pages).collect()) == [f"deep {i} text" for i in range(6)]
    assert time.time() - start < 120


def test_the_model_takes_out_unnamed_branches(spark):
    def page(i):
        return f"<html><body><nav><a>Home</a></nav><div class='x1'>Every page says this</div><article><h1>H {i * 7919}</h1><p>Body {i * 104729}</p><div>Follow us</div></article></body></html>"

    pages = spark.createDataFrame([(i, "http://h.org/", page(i)) for i in range(20)], "page_id long, url string, html string")
    got = sitetree.extract(pages, report=True)
    assert got.select(F.min("low_branches"), F.max("low_branches")).first() == (3, 3)
    assert {r.page_id: r.text for r in got.collect()} == {i: f"H {i * 7919}\nBody {i * 104729}" for i in range(20)}
