"""Main text of web pages: boosted trees over DOM nodes, decoded down the tree.

A page becomes a tree of its block elements, and of inline ones that carry a class, id or role. Trees boosted by
Spark score each node from its subtree's density, attribute tokens, depth, siblings and ancestors. Decoding keeps the
best-scoring set of nodes in which no node is kept beneath a dropped one.

There are no labels, so the training pages are made from the table: a bounded sample of pages that mark their
article; and their texts laid out anew, with the other parts of a page around them in many shapes.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts, written

SAMPLE = 600  # pages that training takes, at most; those with the smallest hashes of their id
LAYOUTS = 5  # new layouts of each
ROUNDS, DEPTH = 24, 5
SEED = 11

# fixed values of HTML
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SILENT = frozenset("head title script style template noscript textarea select button svg iframe object canvas audio video math noframes".split())
RAW = frozenset("script style template noscript textarea title iframe noframes".split())
HEAD = frozenset("html head base basefont bgsound link meta title script style template noscript noframes".split())  # what doesn't end an open head
CLOSES = {  # start tags that end an open element, up to the container that stops it
    **{t: ({"p"}, frozenset()) for t in "address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()},
    "li": ({"p", "li"}, frozenset({"ul", "ol", "menu"})), "dt": ({"p", "dt", "dd"}, frozenset({"dl"})), "dd": ({"p", "dt", "dd"}, frozenset({"dl"})),
    "tr": ({"p", "td", "th", "tr"}, frozenset({"table"})), "td": ({"p", "td", "th"}, frozenset({"tr", "table"})), "th": ({"p", "td", "th"}, frozenset({"tr", "table"})),
}
ITEM = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|data-y)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
BLANK = re.compile(r"[\x20\x09-\x0D]+")

# kinds of names that attributes carry
TOKENS = [
    ("nav", r"nav|menu|breadcrumb|crumbs|pagination|pager|toc"), ("head", r"header|masthead|topbar|logo|brand"), ("foot", r"footer|copyright|colophon|legal"),
    ("side", r"sidebar|aside|widget|rail|related|recommend|popular|trending|complementary"), ("ad", r"(?:^|[\s_-])ads?(?:$|[\s_-])|advert|sponsor|promo|banner"),
    ("note", r"cookie|consent|notice|gdpr|alert|popup|modal|overlay|paywall"), ("form", r"form|login|signup|subscribe|newsletter|search"),
    ("comment", r"comment|repl(?:y|ies)|disqus|discussion|respon(?:d|se)|feedback"), ("share", r"share|social|follow"),
    ("main", r"article|content|main|post|entry|story|prose|body"),
]
TOKEN_RES = [re.compile(r, re.I) for _, r in TOKENS]
TAGS = ["p", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "ul", "li", "table", "h", "blockquote", "body", "pre", "figure", "dl"]


class Node:
    __slots__ = ("tag", "parent", "depth", "names", "label", "children", "text", "links", "tags", "commas", "paragraphs", "begin", "index")

    def __init__(self, tag, parent, names="", label=None):
        self.tag, self.parent, self.label = tag, parent, label
        self.depth = 0 if parent is None else parent.depth + 1
        self.names = tuple(bool(r.search(names)) for r in TOKEN_RES) if names else (False,) * len(TOKENS)
        self.children, self.text, self.links, self.tags, self.commas, self.paragraphs, self.begin = [], 0, 0, 1, 0, int(tag == "p"), 0
        if parent is not None:
            parent.children.append(self)


def parse(page: str) -> tuple[list[Node], list[tuple[int, int, str]]]:
    """The nodes of a page in document order, and its text as (block, index of the node, decoded run).

    Elements end as browsers end them: by their end tag, or by what can't stand inside; an end tag without
    an open element is passed over. Anything that never shows text is left out.
    """
    root = Node("body", None)
    root.index = 0
    nodes, runs, block, at, silent = [root], [], 0, 0, None
    stack: list[tuple[str, Node]] = []  # open elements with the node that holds them
    here, links, end = root, 0, len(page)

    def text(raw: str) -> None:
        nonlocal silent
        if silent is not None and silent[0] == "head" and raw.strip(" \t\n\f\r"):
            silent = None  # text can't stand in a head
        if raw and silent is None:
            own = html.unescape(raw) if "&" in raw else raw
            runs.append((block, here.index, own))
            n = len(own) - own.count(" ")
            here.text += n
            here.commas += own.count(",") + own.count(".")
            if links:
                here.links += n

    while at < end:
        m = ITEM.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        closing, opening = m[1], m[2]
        if opening:
            tag = opening.lower()
            if not m[4]:
                break  # the page ends within the tag
            if silent is not None and silent[0] == "head":
                if tag not in HEAD:
                    silent = None
                elif tag not in RAW:
                    continue
            elif silent is not None:
                if tag == silent[0]:
                    silent[1] += 1
                continue
            if tag in SILENT:
                if tag in RAW:
                    stop = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
                    if stop is None:
                        break
                    at = page.find(">", stop.start()) + 1 or end
                elif not m[3].rstrip().endswith("/"):
                    silent = [tag, 1]
                continue
            if tag in ("html", "body"):
                if tag == "body" and m[3]:
                    given = _attributes(m[3])
                    root.names = tuple(bool(r.search(given[0])) for r in TOKEN_RES)
                continue
            ended, stops = CLOSES.get(tag, ((), ()))
            if ended:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in ended:
                        here = stack[i][1].parent if stack[i][1].tag == stack[i][0] else here
                        links -= sum(t == "a" for t, _ in stack[i:])
                        del stack[i:]
                    elif stack[i][0] in stops:
                        break
                    elif tag != "li" and stack[i][0] not in INLINE:
                        if not stops:
                            break
            inline = tag in INLINE
            block += not inline
            if tag == "br":
                text(" ")
            if tag in VOID:
                continue
            names, label = _attributes(m[3]) if m[3] else ("", None)
            if not inline or (names and tag != "a"):
                here = Node(tag, here, names, label)
                here.index, here.begin = len(nodes), m.start()
                nodes.append(here)
            else:
                here.tags += 1
            links += tag == "a"
            stack.append((tag, here))
        elif closing:
            tag = closing.lower()
            if silent is not None:
                if tag == silent[0]:
                    silent[1] -= 1
                    silent = silent if silent[1] else None
                continue
            block += tag not in INLINE
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    links -= sum(t == "a" for t, _ in stack[i:])
                    del stack[i:]
                    here = stack[-1][1] if stack else root
                    break
                if tag in INLINE and stack[i][0] not in INLINE:
                    break
    for n in reversed(nodes[1:]):
        p = n.parent
        p.text += n.text
        p.links += n.links
        p.tags += n.tags
        p.commas += n.commas
        p.paragraphs += n.paragraphs
    return nodes, runs


def _attributes(raw: str) -> tuple[str, int | None]:
    names, label = [], None
    for name, a, b, c in ATTRIBUTE.findall(raw):
        if name.lower() == "data-y":
            label = int((a or b or c) == "1")
        else:
            names.append(a or b or c)
    return " ".join(names), label


SIZE = 14 + len(TAGS) + 2 * len(TOKENS) + 8


def features(nodes: list[Node]) -> np.ndarray:
    """One row per node of a page."""
    root, rows = nodes[0], []
    above = {}  # by node: the names and tags of its ancestors
    total, length = max(1, root.text), max(1, nodes[-1].begin)
    alike = Counter((n.parent.index, n.tag) for n in nodes[1:])
    for n in nodes:
        p = n.parent
        inherited = above[p.index] if p else (False,) * (len(TOKENS) + 8)
        sect = (n.tag == "nav", n.tag == "header", n.tag == "footer", n.tag == "aside", n.tag == "form", n.tag in ("article", "main"), n.tag in ("ul", "ol"), n.tag == "table")
        above[n.index] = tuple(map(max, inherited, (*n.names, *sect)))
        siblings = p.children if p else [n]
        place = n.index - siblings[0].index
        same = alike[p.index, n.tag] if p else 1
        rows.append((
            n.depth, np.log1p(n.text), n.links / max(1, n.text), np.log1p(n.text / n.tags), n.commas / max(1, n.text) * 10, np.log1p(n.paragraphs),
            n.text / total, n.begin / length, np.log1p(len(siblings)), np.log1p(same), np.log1p(place), np.log1p(len(n.children)),
            n.text / max(1, p.text) if p else 1.0, p.links / max(1, p.text) if p else 0.0,
            *(n.tag == t or (t == "h" and len(n.tag) == 2 and n.tag[0] == "h" and n.tag[1].isdigit()) for t in TAGS), *n.names, *inherited,
        ))
    return np.array(rows, np.float64)


def decode(nodes: list[Node], scores: np.ndarray) -> np.ndarray:
    """The best-scoring choice of kept nodes in which whatever lies beneath a dropped node is dropped."""
    best = scores.tolist()
    for n in reversed(nodes[1:]):
        if best[n.index] > 0:
            best[n.parent.index] += best[n.index]
    kept = np.zeros(len(nodes), bool)
    for n in nodes:
        kept[n.index] = n.parent is None or (kept[n.parent.index] and best[n.index] > 0)
    return kept


def joined(runs: list[tuple[int, int, str]], kept: np.ndarray) -> str:
    """The kept text: a line per block, its white space single and trimmed."""
    lines, now, parts = [], None, []
    for block, node, text in [*runs, (None, 0, "")]:
        if block != now:
            line = BLANK.sub(" ", "".join(parts)).strip(" ")
            if line:
                lines.append(line)
            now, parts = block, []
        if kept[node]:
            parts.append(text)
    return "\n".join(lines)


# training pages


def article_labels(nodes: list[Node]) -> np.ndarray | None:
    """1 for nodes of the page's one article and those around it, 0 for the rest; None without such an article."""
    marked = [n for n in nodes if n.tag == "article"]
    if len(marked) != 1 or not marked[0].text:
        return None
    y = np.zeros(len(nodes))
    n = marked[0]
    while n is not None:
        y[n.index] = 1
        n = n.parent
    for n in nodes[marked[0].index :]:
        p = n.parent
        y[n.index] = max(y[n.index], p is not None and y[p.index] and p.index >= marked[0].index and not any(n.names[:9]) and n.tag not in ("nav", "aside", "footer", "form"))
    return y


def layout(blocks: list[str], rng: random.Random) -> str:
    """The blocks of an article in a new page; data-y marks what is article and what isn't."""
    pick, e, words = rng.choice, html.escape, " ".join(blocks).split() or ["word"]
    say = lambda a, b: e(" ".join(pick(words) for _ in range(rng.randint(a, b))))
    link = lambda: f'<a href="/{rng.randint(1, 99)}">{say(1, 3)}</a>'
    listed = lambda n: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(n)) + "</ul>"
    no = lambda tag, names, inner: f'<{tag}{f" {pick(["class", "id"])}=" + chr(34) + pick(names) + chr(34) if names else ""} data-y="0">{inner}</{tag}>'
    wrap = lambda s: pick([s, f"<p>{s}</p>", f"<div>{s}</div>"])
    talk = lambda: "".join(f'<{t} class="{pick(["comment", "reply", "comment-body", "item"])}">{wrap(say(3, 60))}</{t}>' for t in [pick(["div", "li", "article", "p"])] for _ in range(rng.randint(1, 5)))
    parts = {
        "nav": lambda: pick([no("nav", None, listed(rng.randint(3, 8))), no("div", ["menu", "navbar", "breadcrumbs", "main-nav"], pick([listed(4), " ".join(link() for _ in range(5))])), no("ul", ["nav", "menu"], "".join(f"<li>{link()}</li>" for _ in range(4)))]),
        "head": lambda: pick([no("header", pick([None, ["site-header", "top"]]), wrap(say(1, 8)) + pick(["", no("nav", None, listed(4))])), no("div", ["header", "masthead", "topbar", "logo"], wrap(say(1, 8)))]),
        "foot": lambda: pick([no("footer", pick([None, ["site-footer"]]), wrap("&copy; " + say(2, 30))), no("div", ["footer", "copyright", "legal"], wrap("&copy; " + say(2, 30)))]),
        "side": lambda: pick([no("aside", pick([None, ["sidebar"]]), wrap(say(3, 40)) + pick(["", listed(4)])), no("div", ["sidebar", "widget", "related", "right-rail"], wrap(say(3, 40)) + listed(rng.randint(1, 6)))]),
        "ad": lambda: no(pick(["div", "aside", "section", "p"]), ["ad", "ads", "advert", "sponsored", "promo", "ad-slot", "banner"], pick([say(2, 40), wrap(say(2, 25))])),
        "note": lambda: no(pick(["div", "section", "p", "aside"]), ["cookie-notice", "notice", "consent", "alert", "gdpr-popup"], wrap(say(4, 40))),
        "form": lambda: pick([no("form", pick([None, ["newsletter", "login", "search-form"]]), f"<label>{say(1, 4)}</label><input>{wrap(say(1, 12))}<button>{say(1, 2)}</button>"), no("div", ["newsletter", "subscribe", "login-form"], wrap(say(3, 20)) + f"<form><input>{say(1, 3)}</form>")]),
        "comments": lambda: no(pick(["div", "section", "ol", "ul"]), ["comments", "comment-list", "replies", "disqus_thread", "discussion"], pick(["", "<h3>" + say(1, 4) + "</h3>"]) + talk()),
        "teasers": lambda: "".join(no("article", pick([None, ["teaser", "card"]]), f"<{t}>{link()}</{t}>" + pick(["", wrap(say(3, 25))])) for t in [pick(["h2", "h3", "h4"])] for _ in range(rng.randint(1, 4))),
        "share": lambda: no("div", ["share", "social", "follow-us"], " ".join(link() for _ in range(4))),
    }
    inner = []
    yes = lambda tags, own: "".join(f'<{t} data-y="1">' for t in tags) + own + "".join(f"</{t}>" for t in reversed(tags))
    nested = {"li": ["ul", "li"], "dl": ["dl", "dd"], "figure": ["figure", "figcaption"], "table": ["table", "tr", "td"], "head": ["header", "h1"], "lead": ["div", "h1"]}
    for i, b in enumerate(blocks):
        tag = pick(["h1", "h1", "h2", "p", "head", "lead"]) if i == 0 else pick(["p"] * 12 + ["div", "div", "h2", "h2", "blockquote", "li", "li", "pre", "figure", "dl", "table"])
        own = e(b) if rng.random() < 0.8 else f"<b>{e(b)}</b>"
        inner.append(f'<p data-y="1">{own}' if tag == "p" and rng.random() < 0.2 else yes(nested.get(tag, [tag]), own))
        if rng.random() < 0.1:
            inner.append(parts[pick(["ad", "ad", "side", "side", "note", "form", "share"])]())
    tag, names = pick([("article", None), ("main", None), ("div", ["content", "post", "entry-content", "article-body", "story"]), ("section", ["post-content", "main"]), ("article", ["post", "h-entry"]), ("div", None), ("td", None)])
    named = f' class="{pick(names)}"' if names else ""
    after = [parts["comments"]()] if rng.random() < 0.5 else []
    body = f'<{tag}{named} data-y="1">{"".join(inner)}{"".join(after) if rng.random() < 0.5 else ""}</{tag}>'
    if tag == "td":
        body = f'<table data-y="1"><tr data-y="1">{no("td", None, listed(5))}{body}</tr></table>'
    before = [parts[k]() for k in ("head", "nav", "ad", "note", "side", "form") if rng.random() < 0.5]
    behind = [*after, *(parts[k]() for k in ("side", "ad", "form", "share", "teasers", "comments", "note", "foot", "foot") if rng.random() < 0.4)]
    rng.shuffle(before)
    page = "".join([*before, body, *behind])
    for _ in range(rng.randint(0, 2)):
        page = f'<div{pick(["", " class=wrapper", " id=page", " class=container"])} data-y="1">{page}</div>'
    return f"<html><head><title>{say(1, 5)}</title></head><body>{page}</body></html>"


def labelled(nodes: list[Node]) -> np.ndarray:
    """The labels of a laid-out page: a node without its own takes its parent's."""
    y = np.ones(len(nodes))
    for n in nodes[1:]:
        y[n.index] = y[n.parent.index] and (n.label is None or n.label)
    return y


def training_rows(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(x, label) of the nodes of sampled pages and of their new layouts."""

    def batch(nodes: list[Node], y: np.ndarray) -> pa.RecordBatch:
        x = pa.array(features(nodes).ravel())
        lists = pa.FixedSizeListArray.from_arrays(x, SIZE).cast(pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([lists, pa.array(y)], ["x", "label"])

    def run(batches):
        for b in slices(batches, 20):
            for page, number in zip(texts(b.column(0)), b.column(1).to_pylist(), strict=True):
                nodes, runs = parse(page)
                y = article_labels(nodes)
                if y is None:
                    continue
                yield batch(nodes, y)
                rng = random.Random(SEED * 1_000_003 + number)
                blocks = joined(runs, y > 0).split("\n")
                for _ in range(LAYOUTS):
                    new, _ = parse(layout(blocks[: rng.randint(1, len(blocks))], rng))
                    yield batch(new, labelled(new))

    number = F.pmod(F.xxhash64("url", "page_id"), F.lit(1 << 40))
    one = F.regexp_count("html", F.lit(r"(?i)<article[\s>]")) == 1  # the others can't teach, so they aren't drawn
    own = pages.filter(one).select("html", number.alias("number"))
    # the sample's numbers come first, and alone; then only its pages leave their tasks
    numbers = own.select("number").orderBy("number").limit(sample).collect()
    last = max((r["number"] for r in numbers), default=-1)
    some = own.filter(F.col("number") <= last).limit(sample)
    return written(some.repartition(8).mapInArrow(run, "x array<double>, label double"), "nodes")


class Trees:
    """Boosted trees as arrays: in each step every row goes to a child, all rows and trees at once."""

    def __init__(self, trees: list[list[tuple]], weights: list[float]):
        size = max(map(len, trees), default=0)
        shape = (len(trees), size)
        self.feature, self.left, self.right = (np.zeros(shape, np.int32) for _ in range(3))
        self.threshold, self.value, self.weights = np.zeros(shape), np.zeros(shape), np.array(weights)
        for t, nodes in enumerate(trees):
            for i, (feature, threshold, left, right, value) in enumerate(nodes):
                self.feature[t, i], self.threshold[t, i], self.left[t, i], self.right[t, i], self.value[t, i] = feature, threshold, left, right, value

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds that a node belongs to the main text."""
        out = np.zeros(len(x))
        for t, w in enumerate(self.weights):
            at = np.zeros(len(x), np.int32)
            for _ in range(DEPTH):
                go = x[np.arange(len(x)), self.feature[t, at]] <= self.threshold[t, at]
                at = np.where(go, self.left[t, at], self.right[t, at])
            out += w * self.value[t, at]
        return 2 * out


def _flat(java_node) -> list[tuple]:
    """The nodes of one of Spark's trees; a leaf is its own child."""
    out = []

    def add(n) -> int:
        at = len(out)
        out.append(None)
        if n.subtreeDepth() == 0:
            out[at] = (0, 0.0, at, at, n.prediction())
        else:
            split = n.split()
            out[at] = (split.featureIndex(), split.threshold(), add(n.leftChild()), add(n.rightChild()), n.prediction())
        return at

    add(java_node)
    return out


def fit(pages: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees from at most ``sample`` pages. Where no page marks an article, they are fitted on layouts of filler."""
    rows = training_rows(pages, sample)
    if not rows.filter("label = 0").take(1):
        spark = pages.sparkSession
        filler = "".join(f"<p>{' '.join(['lorem', 'ipsum', 'dolor', 'sit', 'amet,'] * (1 + i % 9))}.</p>" for i in range(12))
        own = spark.range(60).select(F.col("id").alias("page_id"), F.lit("").alias("url"), F.lit(f"<article>{filler}</article>").alias("html"))
        rows = training_rows(own, 60)
    own = rows.select(array_to_vector("x").alias("features"), "label")
    model = GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, stepSize=0.3, seed=SEED, cacheNodeIds=False).fit(own)
    return Trees([_flat(t._call_java("rootNode")) for t in model.trees], list(model.treeWeights))


def extract(pages: DataFrame, trees: Trees, out: str = "text") -> DataFrame:
    """``pages`` with the main text of each whole html in ``out``; null and empty pages have the empty text."""
    pages = pages.drop(out)

    def run(batches):
        for b in slices(batches, 200):
            own = [parse(t) for t in texts(b.column("html"))]
            x = np.concatenate([features(nodes) for nodes, _ in own]) if own else np.zeros((0, SIZE))
            scores, at, found = trees.score(x), 0, []
            for nodes, runs in own:
                found.append(joined(runs, decode(nodes, scores[at : at + len(nodes)])))
                at += len(nodes)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], [*b.schema.names, out])

    return pages.mapInArrow(run, pages.withColumn(out, F.lit(None).cast("string")).schema)


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``."""
    own = pages.select("page_id", "url", "html")
    found = extract(own, fit(own))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
