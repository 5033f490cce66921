"""Mixing, source divergence and spelling variants against plain-Python versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
import xxhash
from pyspark.sql import functions as F

from bitext.llm import divergence, mixing, spelling
from bitext.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row string, size int, part string, place long, n long, word string, term string, rank int, target string"
EDGE = [
    (1, "colour colours Colour", "en", "a"), (2, None, "en", None), (3, "", None, "a"), (None, "one two  three\tfour", "en", ""), (5, "x " * 5000, "de", "b"), (5, "x " * 5000, "de", "b"),
    (6, " \x0b\x0c ", "de", "c"), (7, "straße Straßen ÀÉ \U0001f600emoji 日本", "de", "b"), (8, "Colour colour", "en", "a"), (None, None, None, None), (9, "y z", "fr", "zz"), (10, "y z", "fr", "zé"),
]


def with_clashes(spark, rows):
    return spark.createDataFrame([(*r, 1, "r", 2, "p", 3, 4, "w", "t", 5, "g") for r in rows], COLUMNS)


def same(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def random_docs(n, seed, langs=("en", "de", None), sources=("a", "b", "c", "", None)):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdeéñ", k=r.randint(1, 10))) for _ in range(60)]
    out = []
    for k in range(n):
        text = " ".join(r.choice(words) if r.random() < 0.9 else r.choice(words).upper() + "1" for _ in range(r.randint(0, 80)))
        out.append((k, text, r.choice(langs), r.choices(sources, [9, 3, 3, 1, 1][: len(sources)])[0]))
    return out + out[:5] + [(0, out[0][1], *out[0][2:])] * 30


# Mixing

def h64(*values):
    seed = 42
    for v in values:
        data = v if isinstance(v, bytes) else v[0].to_bytes(4, "little", signed=True) if isinstance(v, tuple) else v.to_bytes(8, "little", signed=True)
        seed = xxhash.xxh64(data, seed=seed).intdigest()
    return seed - (1 << 64) if seed >> 63 else seed


def plain_row_key(doc_id, text, source):
    known = ",".join(str(x is None).lower() for x in (doc_id, source, text))
    parts = [known, *([str(doc_id)] if doc_id is not None else []), hashlib.md5((source or "").encode()).hexdigest(), *([text] if text is not None else [])]
    return hashlib.md5(":".join(parts).encode()).digest()


def plain_targets(sizes, weights=(5, 2, 1), copies=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, free, target = sum(sizes.values()), set(order), {}
    while True:
        per = Fraction(left, max(1, sum(weight[s] for s in free)))
        above = {s for s in free if per * weight[s] > copies * sizes[s]}
        if not above:
            return order, target | {s: per * weight[s] for s in free}
        for s in above:
            target[s] = Fraction(copies * sizes[s])
            left -= copies * sizes[s]
        free -= above


def plain_hypergeometric(good, bad, drawn, u):
    total = good + bad
    mean = float(drawn) * good / max(total, 1)
    spread = 12 * (mean * bad / max(total, 1) * (total - drawn) / max(total - 1, 1)) ** 0.5 + 40
    low, high = max(0, drawn - bad, int((mean - spread) // 1)), min(drawn, good, -int((-(mean + spread)) // 1))
    up = lambda w, k: w * ((float(good - k) * (drawn - k)) / (float(k + 1) * (bad - drawn + k + 1)))
    w, mass = 1.0, 0.0
    for k in range(low, high + 1):
        mass, w = mass + w, up(w, k)
    w, left = 1.0, mass * u
    for k in range(low, high + 1):
        if 0 <= left < w:
            return k
        left, w = left - w, up(w, k)
    return high


def plain_draws(kinds, drawn, *key):
    out, left = [], sum(kinds)
    for n in kinds:
        u = (h64(mixing.SEED, *key, (len(out),)) % (1 << 64) >> 11) * 2.0**-53
        k = plain_hypergeometric(n, left - n, drawn, u)
        out.append(k)
        drawn, left = drawn - k, left - n
    return out


def plain_tree(quotas, shards, fan, chunk):
    """Blocks of each source in each shard."""
    total, nodes, width = sum(quotas), {0: list(quotas)}, 1
    while width < shards:
        width *= fan
    while width > 1:
        width //= fan
        after = {}
        for node, own in nodes.items():
            cap = lambda b: min(node + b * width, shards) * total // shards  # noqa: B023, E731
            chunks = [own[i : i + chunk] for i in range(0, len(own), chunk)]
            left, cells = [sum(c) for c in chunks], [list(c) for c in chunks]
            for b in range(fan):
                to = plain_draws(left, cap(b + 1) - cap(b), width, node, -1, (b,))
                got = []
                for c, m in enumerate(to):
                    d = plain_draws(cells[c], m, width, node, c, (b,))
                    cells[c] = [x - y for x, y in zip(cells[c], d, strict=True)]
                    got += d
                left = [x - y for x, y in zip(left, to, strict=True)]
                if node + b * width < shards:
                    after[node + b * width] = got
        nodes = after
    return [nodes[k] for k in range(shards)]


def plain_place(b, blocks, rank, copy):
    for r in range(1, mixing.ROUNDS + 1):
        other = (h64(mixing.SEED, rank, copy, r) % blocks - b) % blocks
        if h64(mixing.SEED, rank, copy, r, max(b, other)) % 2:
            b = other
    return b


def plain_mix(rows, shards, block, chunk):
    """(doc_id, source, size, target, taken, words per shard) of every row, and each shard's number of blocks."""
    size = lambda t: len(re.findall(mixing.WORD, t or ""))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    order, target = plain_targets(sizes)
    plan = {}
    for s in order:
        step = max(1, min(block, sizes[s] // mixing.BLOCKS))
        words = int(target[s] + Fraction(1, 2))
        copies, rest = divmod(words, sizes[s]) if sizes[s] else (0, 0)
        blocks = -(-sizes[s] // step)
        plan[s] = (step, sizes[s] // step, copies, rest, copies * blocks + -(-rest // step), blocks)
    tree = plain_tree([plan[s][4] for s in order], shards, mixing.FAN, chunk)
    ends = {s: [sum(t[k] for t in tree[: i + 1]) for i in range(shards)] for k, s in enumerate(order)}
    out = []
    for rank, s in enumerate(order):
        step, full, copies, rest, quota, blocks = plan[s]
        mine = [(plain_row_key(i, t, x), i, size(t)) for i, t, x in rows if x == s]
        mine.sort(key=lambda r: (h64(mixing.SEED, r[0]) % mixing.PARTS, h64(mixing.SEED + 1, r[0]), r[0]))
        at = 0
        for _, i, n in mine:
            per_shard = Counter()
            for c in range(copies + 1):
                for b in range(at // step, (at + n - 1) // step + 1) if n else ():
                    place = plain_place(b, full, rank, c) if b < full else full
                    more = -(-rest // step)
                    length = step if c < copies or place < more - 1 else rest - place * step if place == more - 1 else 0
                    words = min(at + n, b * step + length) - max(at, b * step)
                    if words > 0:
                        j = c * blocks + place
                        per_shard[sum(e <= j for e in ends[s])] += words
            out.append((i, s, n, float(target[s]), sum(per_shard.values()), tuple(sorted(per_shard.items()))))
            at += n
    return out, [sum(t) for t in tree]


@pytest.mark.parametrize(("shards", "block", "chunk", "rows"), [(8, 4, 2, EDGE), (5, 16, 256, random_docs(80, 3)), (64, 1024, 256, random_docs(120, 4))])
def test_mix_equals_plain_python(spark, shards, block, chunk, rows):
    docs = with_clashes(spark, rows).repartition(3)
    want, blocks = plain_mix([(i, t, s) for i, t, _, s in rows], shards, block, chunk)
    got = []
    for r in mixing.mix(docs, shards=shards, block=block, chunk=chunk).collect():
        per_shard = Counter()
        for p in r.pieces:
            assert 0 <= p.first and p.first + p.words <= r.size
            per_shard[p.shard] += p.words
        got.append((r.doc_id, r.source, r.size, r.target, sum(per_shard.values()), tuple(sorted(per_shard.items()))))
    close = lambda rows: sorted(((*r[:3], round(r[3], 6), *r[4:]) for r in rows), key=repr)
    assert close(got) == close(want)
    assert blocks == [(k + 1) * sum(blocks) // shards - k * sum(blocks) // shards for k in range(shards)]
    taken, target = Counter(), {}
    for _, s, n, t, k, _ in got:
        assert k <= 3 * n
        taken[s] += k
        target[s] = t
    assert all(abs(taken[s] - t) <= 0.5 + 1e-6 for s, t in target.items())


def test_mix_unfolds_many_equal_rows_and_takes_an_empty_table(spark, monkeypatch):
    monkeypatch.setattr(mixing, "UNFOLD", 7)
    docs = with_clashes(spark, [(1, "a b c", "en", "s")] * 50 + [(2, "d e", "en", "t")] * 3)
    got = mixing.mix_report(docs).collect()
    assert Counter((r.doc_id, r.size, r.source_size) for r in got) == {(1, 3, 150): 50, (2, 2, 6): 3}
    assert sum(r.taken for r in got) == 156 and {r.taken for r in got if r.doc_id == 2} == {6}
    assert mixing.mix_report(docs.limit(0)).collect() == []


def test_mixed_texts_are_the_words_of_the_pieces(spark):
    rows = [(k, " ".join(f"w{k}x{j}" for j in range(50)), "en", "ab"[k % 3 > 0]) for k in range(30)]
    docs = with_clashes(spark, rows)
    words = Counter()
    for r in mixing.mixed_texts(docs, shards=4, block=8).collect():
        words.update(r.text.split(" "))
    report = mixing.mix_report(docs).collect()
    assert sum(words.values()) == sum(r.taken for r in report) == 1500
    assert max(words.values()) <= 3
    orders = [[tuple(r) for r in mixing.mixed_texts(docs.repartition(n), shards=4, block=8).orderBy("shard", "place", "doc_id", "text").collect()] for n in (1, 5)]
    assert orders[0] == orders[1]


def test_hypergeometric_has_its_distribution(spark):
    good, bad, drawn, n = 30, 50, 20, 40000
    e = mixing.hypergeometric(f"{good}L", f"{bad}L", f"{drawn}L", "(id + 0.5D) / 40000D")
    got = {r.k: r["count"] / n for r in spark.range(n).select(F.expr(e).alias("k")).groupBy("k").count().collect()}
    from math import comb

    for k in range(21):
        assert abs(got.get(k, 0) - comb(good, k) * comb(bad, drawn - k) / comb(good + bad, drawn)) < 1e-3


# Source divergence

def plain_audit(rows, min_docs, top):
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        found = Counter(term.findall((text or "").translate(lower)))
        n[lang, source].update(found)
        docs[lang].update(found.keys())
    out = []
    for lang, names in groups.items():
        kept = [t for t, d in docs[lang].items() if d >= min_docs]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}  # noqa: B023, E731
        q = share(sum((n[lang, s] for s in names), Counter()))
        p = {s: share(n[lang, s]) for s in names}
        for s in names:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in names - {s}]
            terms = [(p[s][t] - q[t], t) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, items, limit in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, t, v, k + 1) for k, (v, t) in enumerate(items[:limit])]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("rows", "min_docs", "top", "segment", "block"), [(EDGE, 2, 3, 2, 1), (random_docs(300, 5), 30, 50, 4096, 32), (random_docs(300, 6), 5, 4, 7, 2), (EDGE, 30, 50, 4096, 32)])
def test_audit_equals_plain_python(spark, rows, min_docs, top, segment, block):
    got = divergence.audit(with_clashes(spark, rows), min_docs, top, segment, block)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert same(got, *got.columns) == plain_audit(rows, min_docs, top)


def test_pairs_are_one_row_whatever_the_order_of_sources_in_a_segment(spark):
    run = lambda source, number, segment, value: ("en", source, number, segment, [10], [value])
    rows = [run("a", 0, 0, 5), run("b", 1, 0, 7), run("c", 2, 0, 1), run("c", 2, 1, 4), run("b", 1, 1, 4), run("a", 0, 1, 1)]
    runs = spark.createDataFrame(rows, "lang string, source string, number long, segment long, ends array<int>, values array<long>").coalesce(1)
    groups = spark.createDataFrame([("en", s, k, 20) for k, s in enumerate("abc")], "lang string, source string, number long, terms long")
    found = {("a", "b"): 50, ("a", "c"): 70, ("b", "c"): 60}
    expected = sorted([("en", *x, v) for (a, b), v in found.items() for x in ((a, b), (b, a))])
    assert same(divergence.pair_values(runs, groups), "lang", "source", "item", "value") == expected


def test_audit_of_an_empty_table(spark):
    assert divergence.audit(with_clashes(spark, EDGE).limit(0)).collect() == []


# Spelling variants

def plain_forms(rows):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1:]
            counts[word] += len(word) >= 7
    counts = {w: n for w, n in counts.items() if n >= 2}
    letters = {c for w in counts for c in w}

    def near(w):
        gone = {w[:i] + w[i + 1:] for i in range(len(w))}
        more = {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        other = {w[:i] + c + w[i + 1:] for i in range(len(w)) for c in letters}
        return [x for x in gone | more | other if x != w and x in counts]

    form = {}
    for w, n in counts.items():
        best = min(near(w), key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 10 * n else None
    root = lambda w: root(form[w]) if form[w] else w
    return sorted(((w, form[w], root(w), n, len(near(w)), counts[form[w]] if form[w] else None) for w, n in counts.items()), key=repr)


def typos(seed, words=25, docs=300):
    r = random.Random(seed)
    base = ["".join(r.choices("abé", k=r.randint(7, 10))) for _ in range(words)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "z" * 300]

    def spoilt(w):
        i, kind = r.randrange(len(w)), r.random()
        return w[:i] + (r.choice("abÿ") + w[i:] if kind < 0.3 else r.choice("abc") + w[i + 1:] if kind < 0.6 else w[i + 1:])

    common = base[0]
    chain = [(0, " ".join([common] * 2000), "en", "s"), (1, " ".join([common + "x"] * 150 + [common + "xy"] * 12), "en", "s")]
    return chain + [(k, " ".join(spoilt(w) if r.random() < 0.1 else w.upper() for w in r.choices(base, k=40)), "en", "s") for k in range(2, docs)] + [(None, base[1] + "÷×", None, None)] * 3


@pytest.mark.parametrize("block", [4096, 5])
@pytest.mark.parametrize("rows", [EDGE * 3, typos(1), typos(2)])
def test_forms_equal_plain_python(spark, rows, block):
    got = spelling.spelling_forms(with_clashes(spark, rows), block)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert same(got, *got.columns) == plain_forms(rows)


def test_forms_of_an_empty_table(spark):
    assert spelling.spelling_forms(with_clashes(spark, EDGE).limit(0)).collect() == []


def test_queries_on_the_given_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.select("doc_id", "text", "lang", "source").collect()]
    forms = QUERIES["op13_spelling_variants"](spark, SF)
    assert same(forms, "word", "form", "root", "n", "n_near", "form_n") == plain_forms(rows)
    want, _ = plain_mix([(i, t, s) for i, t, _, s in rows], mixing.SHARDS, mixing.BLOCK, mixing.CHUNK)
    got = QUERIES["op11_mix_sources"](spark, SF)
    assert sorted((r.doc_id, r.size, round(r.target, 6), r.taken) for r in got.collect()) == sorted((i, n, round(t, 6), k) for i, _, n, t, k, _ in want)
