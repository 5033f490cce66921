"""HTML extraction with site style trees (after Yi, Liu and Li, 2003).

The DOMs of a host are merged: a node of the merged tree is a path of tags with their classes
and ids. Over the host's pages, the variants of its child sequence give a node's presentation
importance, and the variants of its text give its content importance, both as entropies with
the number of pages as base; children's importances are folded into their parents'. Branches
of low importance are removed from every page, and the rest of the main content is emitted
block by block.

Navigation, headers, footers, asides and the like are branches of the tree as any others, and go
by their importance, for which what the markup suspects needs less evidence. What a merged tree cannot tell is fixed by the markup itself, whatever
its size: such elements go on every host; an element whose class, id or role names such a part is
suspected. Words that only furniture has (``HARD``: comments, cookies, adverts, menus) decide;
other words (``SOFT``) decide where the branch is not of high importance inside an article or
main element, and words that authors also use for sections (``SECTION``) not inside such an
element on hosts without a model, if the section has paragraphs. An article inside a list item
or another article is a card (a reader comment, a teaser) and goes if the page has other
paragraphs; so does, on hosts without a model and outside an article, a list of links alone.
html, body, what holds the main article, and what holds the page's title and paragraphs are
never suspected. Otherwise an article or main element only protects what holds it from removal
on a modelled host; on other hosts it is the main content where it has half of the text.

Defined results: null or empty html gives an empty text; broken or cut markup is read as far
as it goes; hosts with fewer than ``MIN_PAGES`` pages have no low branches; repeated pages
count as often as they come and give a row each; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: Pages that a path needs to be modelled; a host is modelled where its root is.
MIN_PAGES = 5
#: Branches whose importance is below this are removed; suspected ones need less evidence.
LOW, LOW_SUSPECTED = 0.2, 0.8
GAMMA = 0.9
#: Bytes up to which the model of all hosts is broadcast; beyond, it is joined by host.
BROADCAST_BYTES = 32 << 20

# Element kinds of HTML, and words that name page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder mstyle semantics annotation".split())
OMIT = frozenset("script style noscript template iframe object embed svg canvas audio video head button select option textarea input noembed noframes xmp title map".split())
BY_TAG = frozenset("nav footer aside dialog menu".split())
CLOSES_P = frozenset(
    "address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dd dt".split()
)
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "thead", "tbody", "tfoot"), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
MAIN = ("article", "main")
HARD = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs footer sidebar cookie cookies consent gdpr popup modal newsletter subscribe signup login "
    "comment comments respond reply replies disqus share sharing social pagination pager contentinfo".split()
)
SOFT = frozenset("promo promotion banner masthead notice alert overlay widget toolbar skip complementary dialog".split())
SECTION = frozenset("header side search form related recommended".split())
#: A name that tells whether a page has such a part, not that this is one.
STATE = re.compile(r"(?:^|\s)(?:(?:no|with|without|has|have|is)[_-]\S+|\S+[_-](?:open|closed|enabled|disabled|on|off|left|right))(?=\s|$)", re.I)
#: Parts of the page that only a form around the whole of it has.
PAGE_PARTS = frozenset("h1 h2 article main nav header footer form".split())

# Comments and declarations, and how a tag starts. Nothing here is tried in two ways.
_START = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)", re.S)
_REST = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>")
_UNQUOTED = re.compile(r"([^>]*+)>")
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_DIGITS = re.compile(r"\d+")


class Node:
    __slots__ = ("tag", "label", "parent", "children", "omit", "marked", "by_tag", "path", "depth", "para", "size", "within", "plain", "main", "holds", "tags", "links", "items", "card")

    def __init__(self, tag: str, label: str, parent: Node | None, omit: bool, marked: str = "", by_tag: bool = False):
        self.tag, self.label, self.parent, self.omit, self.marked, self.by_tag = tag, label, parent, omit, marked, by_tag
        self.children: list[Node | str] = []
        self.depth = parent.depth + 1 if parent else 0
        # The open paragraph that a block below this node ends.
        self.para: Node | None = self if tag == "p" else parent.para if parent and tag in INLINE else None
        self.path = xxhash.xxh3_64_intdigest(label, parent.path if parent else 0) >> 1


def _suspicion(names: list[str]) -> str:
    words = {w for x in names for w in re.split(r"[\s_-]+", STATE.sub(" ", x).lower())}
    return "hard" if words & HARD else "section" if words & SECTION else "soft" if words & SOFT else ""


def _describe(tag: str, attributes: str) -> tuple[str, bool, str]:
    """Label of the node (tag, class, id without digits), whether it is hidden, and of what its names are suspected."""
    if not attributes or attributes.isspace():
        return tag, False, ""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    names = [found.get(k, "") for k in ("class", "id", "role")]
    hidden = "hidden" in found or re.search(r"display\s*:\s*none", found.get("style", ""), re.I) is not None
    return _DIGITS.sub("0", " ".join([tag, *names]).strip()), hidden, _suspicion(names)


def parse(html: str | None) -> Node:
    """Tree of a page, with the implied end tags of paragraphs, list items and table cells.

    A page that ends inside a tag loses that tag; where quotes leave a tag without an end,
    they no longer count from there on. The time is linear in the page.
    """
    root = Node("", "", None, False)
    if not html:
        return root
    at, node, end, rest = 0, root, len(html), _REST
    opened: defaultdict[str, list[Node]] = defaultdict(list)  # by tag, outermost first

    def leave(last: Node) -> Node:
        x = node
        while x is not last.parent:
            opened[x.tag].pop()
            x = x.parent
        return x

    while at < end:
        m = _START.search(html, at)
        if m is None:
            node.children.append(html[at:])
            break
        if m.start() > at:
            node.children.append(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        inner = rest.match(html, at)
        if inner is None and rest is _REST:
            rest = _UNQUOTED
            inner = rest.match(html, at)
        if inner is None:
            break
        at = inner.end()
        tag, attributes = m[2].lower(), inner[1]
        if m[1]:
            if opened[tag]:
                node = leave(opened[tag][-1])
            continue
        if tag in CLOSES_P and node.para is not None:
            node = leave(node.para)
        if tag in SIBLINGS:
            near = max((opened[x][-1] for x in (*SIBLINGS[tag], *SCOPE[tag]) if opened[x]), key=lambda x: x.depth, default=None)
            if near is not None and near.tag in SIBLINGS[tag]:
                node = leave(near)
        label, out, marked = _describe(tag, attributes)
        lone_header = tag == "header" and not any(opened[x] for x in MAIN)
        marked = "" if tag in ("html", "body") else "hard" if tag == "form" else marked
        new = Node(tag, label, node, out or tag in OMIT, marked, tag in BY_TAG or lone_header)
        node.children.append(new)
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            at = close.end() if close else end
        elif tag not in VOID and not attributes.endswith("/"):
            opened[tag].append(new)
            node = new
    return root


def _walk(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        x = stack.pop()
        yield x
        stack.extend(c for c in reversed(x.children) if isinstance(c, Node))


def _weigh(root: Node) -> bool:
    """Characters of every node; whether the page has an article or main with half of its plain text.

    size: all that is not left out by its tag; within: in article or main elements; plain: outside
    suspected elements; main: both; holds: whether there is such an element with most of that
    text. Decides too which elements are cards, and takes suspicion from what holds the page.
    """
    nodes = list(_walk(root))[::-1]  # children before parents
    titles = sum(x.tag == "h1" and not x.omit for x in nodes)
    for x in nodes:
        x.size = x.within = x.links = x.items = 0
        x.holds, x.tags = False, {}
        if x.omit or x.by_tag:
            continue
        for c in x.children:
            if isinstance(c, str):
                x.size += len(c.strip())
            else:
                x.size, x.within, x.holds, x.links, x.items = x.size + c.size, x.within + c.within, x.holds or c.holds, x.links + c.links, x.items + (c.tag == "li")
                for t in (c.tags, {c.tag: 1} if c.tag in PAGE_PARTS or c.tag == "p" and c.size else {}):
                    for tag, n in t.items():
                        x.tags[tag] = x.tags.get(tag, 0) + n
        if x.tag == "a":
            x.links = x.size
        if x.tag in MAIN and not _is_card(x):
            x.within, x.holds = x.size, True
    for x in nodes:
        x.holds = x.holds and 2 * x.within >= root.within
        if x.marked and not x.omit:
            whole = x.tags.get("h1", 0) == titles > 0 and "p" in x.tags and x.tag != "header"
            page = bool(PAGE_PARTS & x.tags.keys()) if x.tag == "form" else whole
            x.marked = "" if x.holds or page else x.marked
    # Only beside other text is a card a card, and a suspected element suspected.
    prose = _has_prose(root)
    if not prose:
        for x in nodes:
            x.marked = "" if x.marked in ("soft", "section") else x.marked
    for x in nodes:
        x.card = prose and x.tag == "article" and _is_card(x)
        x.plain = x.main = 0
        if not (x.omit or x.by_tag or x.marked or x.card):
            for c in x.children:
                if isinstance(c, str):
                    x.plain += len(c.strip())
                else:
                    x.plain, x.main = x.plain + c.plain, x.main + c.main
            if x.tag in MAIN:
                x.main = x.plain
    return root.holds and 2 * root.main >= root.plain


def _has_prose(root: Node) -> bool:
    """Whether there is text in blocks outside cards and suspected elements."""
    stack = [root]
    while stack:
        x = stack.pop()
        if x.omit or x.by_tag or x.marked or _is_card(x):
            continue
        if x.tag != "a" and any(isinstance(c, str) and not c.isspace() for c in x.children):
            return True
        stack.extend(c for c in x.children if isinstance(c, Node))
    return False


def _is_card(x: Node) -> bool:
    """An article inside a list item, or inside another article."""
    up = x.parent
    while x.tag == "article" and up is not None:
        if up.tag in ("li", "article"):
            return True
        up = up.parent
    return False


def main_text(html: str | None, low: frozenset[int] = frozenset(), modelled: bool = False, high: frozenset[int] = frozenset()) -> str:
    return main_content(html, low, modelled, high)[0]


def main_content(html: str | None, low: frozenset[int] = frozenset(), modelled: bool = False, high: frozenset[int] = frozenset()) -> tuple[str, int]:
    """Blocks of the main content, one per line, without the branches in ``low``; how many of these the page had.

    ``modelled``: branches decide; otherwise an article or main with half of the text does.
    ``high``: suspected paths of high importance, which stay inside an article or main.
    """
    root = parse(html)
    agreed = _weigh(root)
    chosen = agreed and not modelled
    blocks: list[list[str]] = [[]]
    cut = 0
    # (node, whether its text counts, whether in an article or main); None ends an element: a block boundary
    stack: list[tuple[Node | str | None, bool, bool]] = [(root, not chosen, False)]
    while stack:
        x, on, inside = stack.pop()
        if x is None:
            blocks.append([])
        elif isinstance(x, str):
            if on:
                blocks[-1].append(entities.unescape(x))
        elif x.tag == "br":
            blocks[-1].append(" ")
        elif not x.omit:
            block = x.tag not in INLINE
            if (block or x.marked) and x.path in low and not (agreed and x.holds):
                cut += 1
                continue
            menu = not modelled and not inside and x.tag in ("ul", "ol") and x.items >= 3 and x.links == x.size
            if x.by_tag or x.card or menu and root.plain > x.plain:
                continue
            if x.marked == "hard" or x.marked and not (inside and (x.path in high or not modelled and x.marked == "section" and "p" in x.tags)):
                continue
            inside = inside or x.tag in MAIN
            on = on or inside
            if block:
                blocks.append([])
                stack.append((None, False, False))
            stack.extend((c, on, inside) for c in reversed(x.children))
    lines = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(line for line in lines if line), cut


def page_nodes(html: str | None) -> list[tuple[int, int, int, int, int, int]]:
    """path, parent path, level, whether marked, style and content hash of every merged node of a page."""
    root = parse(html)
    merged: dict[int, tuple[int, int, int, list, list]] = {}
    for x in _walk(root):
        if x.omit or (x.parent is not None and x.parent.path not in merged):
            continue
        up = x.parent
        *_, styles, texts = merged.setdefault(x.path, (up.path if up else 0, merged[up.path][1] + 1 if up else 0, int(x.marked != "" or x.by_tag), [], []))
        previous = None
        for c in x.children:
            if isinstance(c, Node):
                if c.label != previous:
                    styles.append(c.label)
                previous = c.label
            elif not c.isspace():
                texts.append(" ".join(c.split()))
    return [
        (path, parent, level, marked, xxhash.xxh3_64_intdigest("\x1f".join(styles)) >> 1 if styles else 0, xxhash.xxh3_64_intdigest("\x1f".join(texts)) >> 1 if texts else 0)
        for path, (parent, level, marked, styles, texts) in merged.items()
    ]


HOST = r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


def with_host(pages: DataFrame) -> DataFrame:
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"),
        F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), HOST, 1)).alias("host"),
    )


NODE = ["path", "parent", "level", "marked", "style", "content"]


def site_model(rows: DataFrame) -> DataFrame:
    """host, path, low: each modelled host's low branches, its marked paths that are not low, and its root.

    Two aggregations with map-side halves turn page nodes into one row per (host, path).
    Importances are folded upwards by joins on (host, path), so no host is in one task, whatever
    number of pages and paths it has (see ``importances``).
    """

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            host, out = [], []
            for h, t in zip(batch.column(0), batch.column(1), strict=True):
                found = page_nodes(t.as_py())
                out += found
                host += [h.as_py()] * len(found)
            columns = np.array(out, np.int64).reshape(-1, len(NODE))
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), *(pa.array(columns[:, k].copy()) for k in range(len(NODE)))], names=["host", *NODE])

    found = rows.select("host", "html").mapInArrow(nodes, "host string, " + ", ".join(f"{x} long" for x in NODE))
    key = ["host", "path", "parent", "level", "marked"]
    variants = found.groupBy(*key, "style", "content").agg(F.count(F.lit(1)).alias("n"))
    by_style = variants.groupBy(*key, "style").agg(F.sum("n").alias("s"), F.sum(F.when(F.col("content") != 0, F.col("n"))).alias("with_text"), F.sum(F.when(F.col("content") != 0, F.col("n") * F.log("n"))).alias("content_nln"))
    # Contents are told apart within a style; a path's styles are few.
    stats = by_style.groupBy(*key).agg(
        F.sum("s").alias("m"), F.sum(F.col("s") * F.log("s")).alias("style_nln"), F.max(F.col("style") != 0).alias("inner"),
        F.sum("with_text").alias("with_text"), F.sum("content_nln").alias("content_nln"),
    )
    # A path is on no more pages than its parent, so what is kept is a tree.
    stats = stats.where(F.col("m") >= MIN_PAGES).select(
        *key, F.when(F.col("inner"), _entropy("m", "style_nln")).alias("style"), F.when(F.col("with_text") > 0, _entropy("with_text", "content_nln")).alias("content")
    )
    stats = shared.materialize(stats, "site-stats")
    deepest = stats.agg(F.max("level")).first()[0]
    if deepest is None:
        return stats.select("host", "path", F.lit(False).alias("low"))
    every = importances(stats, deepest)
    # Below a branch whose text is itself repeated, pages are copies, not furniture.
    ups = every.select("host", F.col("path").alias("parent"), F.col("importance").alias("above"))
    low = (F.col("importance") < F.when(F.col("marked") == 1, LOW_SUSPECTED).otherwise(LOW)) & (F.coalesce("above", F.lit(0.0)) >= LOW)
    told = every.join(ups, ["host", "parent"], "left").select("host", "path", "level", "marked", low.alias("low"))
    return shared.materialize(told.where("low OR marked = 1 OR level = 0").select("host", "path", "low"), "site-model")


def importances(stats: DataFrame, deepest: int) -> DataFrame:
    """``stats`` (host, path, parent, level, marked, style, content) with the importance of every branch.

    A node's importance is ``a + b * x``: a is its share of the presentation, x the largest of its
    content and its children's importances. Such steps compose, so that a node needs to look
    only 1, 2, 4, ... levels down: each round takes the best of the nodes that far below and
    doubles their reach, and a tree of n levels needs log2(n) rounds, each one job.
    """
    kids = stats.where("level > 0").groupBy("host", F.col("parent").alias("path")).agg(F.count(F.lit(1)).alias("kids"))
    rows = stats.join(kids, ["host", "path"], "left").withColumn("decay", F.pow(F.lit(GAMMA), F.coalesce("kids", F.lit(1))))
    a, b = F.coalesce((1 - F.col("decay")) * F.col("style"), F.lit(0.0)), F.when(F.col("style").isNull(), 1.0).otherwise(F.col("decay"))
    own = F.coalesce("content", F.when(F.col("kids").isNull(), F.coalesce("style", F.lit(0.0))))
    rows = rows.withColumns({"a": a, "b": b, "best": a + b * own})
    up = rows.select("host", F.col("path").alias("up"), F.col("a").alias("up_a"), F.col("b").alias("up_b"))
    rows = rows.withColumn("up", F.when(F.col("level") > 0, F.col("parent"))).drop("a", "b", "decay").join(up, ["host", "up"], "left")
    rows = shared.materialize(rows, "site-fold")
    reach = 1
    while True:
        below = rows.where("up IS NOT NULL").groupBy("host", F.col("up").alias("path")).agg(F.max(F.col("up_a") + F.col("up_b") * F.col("best")).alias("from_below"))
        rows = rows.join(below, ["host", "path"], "left").withColumn("new_best", F.greatest("best", "from_below"))
        reach *= 2
        if reach > deepest:
            return rows.select("host", "path", "parent", "level", "marked", F.coalesce("new_best", F.lit(0.0)).alias("importance"))
        further = rows.select("host", F.col("path").alias("up"), F.col("up").alias("next"), F.col("up_a").alias("next_a"), F.col("up_b").alias("next_b"))
        rows = rows.join(further, ["host", "up"], "left").select(
            "host", "path", "parent", "level", "marked", F.col("new_best").alias("best"), F.col("next").alias("up"),
            (F.col("next_a") + F.col("next_b") * F.col("up_a")).alias("up_a"), (F.col("next_b") * F.col("up_b")).alias("up_b"),
        )
        rows = shared.materialize(rows, "site-fold")


def _entropy(total: str, nln: str) -> Column:
    t = F.col(total)
    return F.when(t > 1, (F.log(t) - F.col(nln) / t) / F.log(t)).otherwise(1.0)


def _told(model: DataFrame, *keys: str) -> DataFrame:
    """keys, low, high: the model's paths as two lists."""
    return model.groupBy(*keys).agg(F.collect_set(F.when(F.col("low"), F.col("path"))).alias("low"), F.collect_set(F.when(~F.col("low"), F.col("path"))).alias("high"))


def _by_page(rows: DataFrame, model: DataFrame) -> DataFrame:
    """``rows`` with the model's paths that occur on each page: no host's list is gathered."""

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for h, k, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out += [(h, k, n[0]) for n in page_nodes(t)]
            host, page, path = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(page, pa.string()), pa.array(path, pa.int64())], names=["host", "page", "path"])

    rows = rows.withColumn("page", F.md5(F.coalesce("html", F.lit(""))))
    found = rows.select("host", "page", "html").mapInArrow(paths, "host string, page string, path long").distinct()
    return rows.join(_told(found.join(model, ["host", "path"]), "host", "page"), ["host", "page"], "left")


def extract(pages: DataFrame, report: bool = False) -> DataFrame:
    """page_id, url, text, n_chars of every page; with ``report`` also low_branches, which the site's model took out."""
    rows = with_host(pages)
    model = site_model(rows)
    size = model.agg(F.sum(F.length("host") + 8)).first()[0] or 0
    joined = rows.join(F.broadcast(_told(model, "host")), "host", "left") if size <= BROADCAST_BYTES else _by_page(rows, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            told = zip(at["html"], at["low"], at["high"], strict=True)
            found = [main_content(h.as_py(), frozenset(x.as_py() or ()), x.is_valid, frozenset(y.as_py() or ())) for h, x, y in told]
            texts, cut = [t for t, _ in found], [c for _, c in found]
            yield pa.RecordBatch.from_arrays([at["page_id"], at["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(cut, pa.int64())], names=["page_id", "url", "text", "n_chars", "low_branches"])

    out = joined.select("page_id", "url", "html", "low", "high").mapInArrow(run, "page_id long, url string, text string, n_chars long, low_branches long")
    return out if report else out.drop("low_branches")
