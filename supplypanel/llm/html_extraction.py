"""Main text of HTML pages: boosted trees over features of DOM nodes, decoded along the tree.

A page becomes a tree of elements with text; scripts, styles and comments are
never text. Every element gets features: its tag group, whether its class, id
or role holds words of a known kind, the same of its nearest ancestors, depth,
share of the page's text, density of its subtree, links, and its place among
its siblings. Gradient-boosted trees (``pyspark.ml``) give each element the log
odds of lying in the article.

Decoding gives each element one of three states, *frame* (around the article),
*article* and *boilerplate*, so that below boilerplate all is boilerplate and
below article all is article or boilerplate. The assignment of the largest
total is found by dynamic programming over the tree, so an ancestor and a
descendant never contradict each other.

The model learns from pages that are laid out here, with known labels, around
text blocks from a bounded sample of the given pages; nothing else is labelled.

A page is scanned once from its start to its end, in time in proportion to its
length whatever it holds. A quote opens a value only after an equals sign; markup
that is cut off at the page's end is no text.

Defined cases: null, empty and text-free pages give an empty text; tags that are
not closed end with their parent; repeated rows are taken each by itself; trees
may be of any depth, which as a feature counts up to ``DEEPEST``.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from supplypanel.llm.common import sampled, ship_package

#: Pages whose text blocks fill the training pages, and how many of those are laid out.
SAMPLE_PAGES, TRAINING_PAGES = 200, 800
TREES, DEPTH = 16, 5
DEEPEST = 200

#: What begins markup; any other ``<`` is text.
MARKUP = re.compile(r"<(?=[a-zA-Z!?/])")
NAME = re.compile(r"[^\s/>]+")
#: White space and slashes between attributes; an attribute's name with what leads to its value; a value without quotes.
BETWEEN, ATTRIBUTE, UNQUOTED = re.compile(r"[\s/]*"), re.compile(r"([^\s/>][^\s/>=]*)(\s*=\s*)?"), re.compile(r"[^\s>]*")
NAMED = ("class", "id", "role")
BLANKS = re.compile(r"\s+")
RAW = ("script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "xmp")
#: ASCII letters alone match in either case; a lowered copy of the page would not keep its places.
RAW_ENDS = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Void elements that stand in a line of text and end no block.
IN_LINE_VOID = {"area", "embed", "img", "input", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd",
          "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
#: What an opening tag ends: elements of these kinds, up to the nearest of the second group.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
ENDS_PARAGRAPH = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1",
                  "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
TAG_GROUPS = (
    ("article", "main"), ("nav", "menu"), ("header",), ("footer",), ("aside",),
    ("form", "button", "select", "fieldset", "dialog", "input", "option"),
    ("p", "blockquote", "pre"), ("h1", "h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "dl"), ("li", "dt", "dd"),
    ("div", "section"), ("table", "tr", "td", "th", "tbody"), ("figure", "figcaption"),
)
WORDS = (
    "article content main post entry story body text prose",
    "nav menu breadcrumb breadcrumbs navbar navigation toc pagination pager",
    "header masthead banner topbar branding logo", "footer colophon copyright legal bottom",
    "sidebar aside widget rail related recommended popular trending more",
    "ad ads advert advertisement sponsor sponsored promo promotion banner",
    "cookie consent notice alert gdpr popup modal overlay paywall warning disclaimer privacy",
    "comment comments reply replies discussion disqus respondent respond",
    "form subscribe newsletter signup login search share social contact toolbar",
)
KINDS = [frozenset(w.split()) for w in WORDS]
SPLIT = re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])")


def tags(page: str) -> Iterator[tuple[int, int, str, bool, list[str], bool]]:
    """Where each tag begins and ends, its name, whether it closes, its class, id and role values, and whether it ends in a slash.

    Comments and declarations have no name. What is cut off reaches to the page's
    end. The caller sends the place to go on from, or None for the tag's end.
    """
    at, size = 0, len(page)
    while (m := MARKUP.search(page, at)) is not None:
        begin = m.start()
        closing = page.startswith("/", begin + 1)
        first = page[begin + 1 + closing : begin + 2 + closing]
        if not (first.isascii() and first.isalpha()):  # a comment, a declaration, or what counts as one
            comment = page.startswith("<!--", begin)
            end = page.find("-->", begin + 4) if comment else page.find(">", begin + 1)
            at = size if end < 0 else end + (3 if comment else 1)
            yield begin, at, "", False, [], False
            continue
        name = NAME.match(page, begin + 1 + closing)
        at, values, slash, whole = name.end(), [], False, False
        while True:
            gap = BETWEEN.match(page, at)
            at = gap.end()
            if at >= size:
                break
            if page[at] == ">":
                slash, whole = gap.group().endswith("/"), True
                at += 1
                break
            attribute = ATTRIBUTE.match(page, at)
            at = attribute.end()
            if attribute[2]:
                quote = page[at : at + 1]
                if quote in ('"', "'") and quote:
                    end = page.find(quote, at + 1)
                    value, at = (page[at + 1 : end], end + 1) if end >= 0 else ("", size)
                else:
                    value = UNQUOTED.match(page, at)
                    value, at = value.group(), value.end()
                if attribute[1].lower() in NAMED:
                    values.append(value)
        if not whole:  # cut off: markup, but no element
            yield begin, size, "", False, [], False
            return
        go_on = yield begin, at, name.group().lower(), closing, values, slash
        at = at if go_on is None else go_on


class Tree:
    """Elements in page order: parent, tag, attribute kinds; and the page's text runs with their element."""

    def __init__(self, page: str):
        self.parent, self.tag, self.kinds, self.depth = [-1], ["#root"], [0], [0]
        self.runs: list[tuple[int, str, bool]] = []  # the element of a run of text, the run, whether it is a link's
        self.breaks: list[int] = []  # the number of runs before each block boundary
        self.link = False
        self.open = {"#root": 1}  # how many elements of a name are on the stack
        stack, at = [0], 0
        scan, go_on = tags(page), None
        while True:
            try:
                begin, end, tag, closing, values, slash = scan.send(go_on)
            except StopIteration:
                break
            if begin > at:
                self._text(stack[-1], page[at:begin])
            at, go_on = end, None
            if not tag:
                continue
            if closing:
                self._close(stack, tag)
            elif tag in RAW:
                ending = RAW_ENDS[tag].search(page, at)
                end = page.find(">", ending.start()) if ending else -1
                at = go_on = len(page) if end < 0 else end + 1
            else:
                self._open(stack, tag, values, slash)
        self._text(stack[-1], page[at:])
        self.breaks.append(len(self.runs))

    def _text(self, node: int, run: str) -> None:
        if run and not run.isspace():
            self.runs.append((node, run, self.link))
        elif run and self.runs:
            self.runs.append((node, " ", False))

    def _open(self, stack: list[int], tag: str, values: list[str], slash: bool) -> None:
        if tag in ENDS_PARAGRAPH:
            self._end(stack, {"p"}, {"article", "aside", "div", "section", "li", "td", "blockquote", "main", "#root"})
        if tag in CLOSES:
            self._end(stack, *CLOSES[tag])
        if tag not in INLINE and tag not in IN_LINE_VOID:
            self.breaks.append(len(self.runs))
        if tag == "a":
            self.link = True
        if tag in VOID:
            return
        kinds = 0
        for value in values:
            words = set(SPLIT.split(value)) | set(SPLIT.split(value.lower()))
            kinds |= sum(1 << k for k, known in enumerate(KINDS) if words & known)
        if tag in INLINE and not kinds:
            return  # belongs to the block that it stands in
        self.parent.append(stack[-1])
        self.tag.append(tag)
        self.kinds.append(kinds)
        self.depth.append(len(stack))
        if not slash:
            stack.append(len(self.parent) - 1)
            self.open[tag] = self.open.get(tag, 0) + 1

    def _cut(self, stack: list[int], k: int) -> None:
        """Takes the elements from place ``k`` on off the stack."""
        for node in stack[k:]:
            self.open[self.tag[node]] -= 1
        del stack[k:]

    def _end(self, stack: list[int], kinds: set[str], limits: set[str]) -> None:
        if not any(self.open.get(kind) for kind in kinds):
            return
        for k in range(len(stack) - 1, 0, -1):
            if self.tag[stack[k]] in kinds:
                self._cut(stack, k)
                return
            if self.tag[stack[k]] in limits:
                return

    def _close(self, stack: list[int], tag: str) -> None:
        if tag not in INLINE:
            self.breaks.append(len(self.runs))
        if tag not in INLINE or tag == "a":
            self.link = False
        if not self.open.get(tag):
            return
        for k in range(len(stack) - 1, 0, -1):
            if tag in INLINE and self.tag[stack[k]] not in INLINE:
                return  # an inline tag ends no block
            if self.tag[stack[k]] == tag:
                self._cut(stack, k)
                return

    def text(self, keep: np.ndarray) -> str:
        """The text of the runs whose element is kept: white space as one space in a block, blocks joined by one."""
        blocks, at = [], 0
        for end in self.breaks:
            if end > at:
                blocks.append("".join(run for node, run, _ in self.runs[at:end] if keep[node]))
                at = end
        return " ".join(filter(None, (BLANKS.sub(" ", html.unescape(b)).strip() for b in blocks)))


FEATURES = len(TAG_GROUPS) + 1 + 3 * len(KINDS) + 12


def features(tree: Tree) -> np.ndarray:
    """A row for each element."""
    n = len(tree.parent)
    parent, depth = np.array(tree.parent), np.minimum(np.array(tree.depth, np.float64), DEEPEST)
    own, links, runs = np.zeros(n), np.zeros(n), np.zeros(n)
    for node, run, link in tree.runs:
        own[node] += len(run)
        runs[node] += 1
        links[node] += len(run) * link
    chars, linked, pieces, inside, paragraphs = own.copy(), links.copy(), runs.copy(), np.ones(n), np.zeros(n)
    paragraphs[[k for k in range(n) if tree.tag[k] == "p"]] = 1
    for k in range(n - 1, 0, -1):  # children stand after their parents
        p = parent[k]
        chars[p] += chars[k]
        linked[p] += linked[k]
        pieces[p] += pieces[k]
        inside[p] += inside[k]
        paragraphs[p] += paragraphs[k]
    total = max(1.0, chars[0])
    group = np.zeros((n, len(TAG_GROUPS) + 1))
    of_tag = {t: g for g, tags in enumerate(TAG_GROUPS) for t in tags}
    group[np.arange(n), [of_tag.get(t, len(TAG_GROUPS)) for t in tree.tag]] = 1
    kinds = (np.array(tree.kinds)[:, None] >> np.arange(len(KINDS))) & 1
    by_tag = {"nav": 1, "header": 2, "footer": 3, "aside": 4, "form": 8, "article": 0, "main": 0}
    named = kinds.copy()
    for k, t in enumerate(tree.tag):
        if t in by_tag:
            named[k, by_tag[t]] = 1
    up, above, before, width, order = named[parent], named.copy(), np.zeros(n), np.ones(n), np.zeros(n)
    children = np.bincount(parent[1:], minlength=n).astype(np.float64)
    filled, placed = np.zeros(n), np.zeros(n)
    for k in range(1, n):
        p = parent[k]
        above[k] |= above[p]
        before[k], order[k] = filled[p], placed[p]
        filled[p] += chars[k]
        placed[p] += 1
    width[1:] = children[parent[1:]]
    siblings = np.maximum(1.0, chars[parent] - chars)
    ahead = np.cumsum(own) - own
    return np.column_stack([
        group, kinds, up, above, depth, np.log1p(chars), chars / total, linked / np.maximum(1.0, chars),
        chars / inside, np.log1p(pieces), np.log1p(paragraphs), np.minimum(order, 20), np.log1p(width),
        np.log((1 + chars) / siblings), ahead / total, np.log1p(own),
    ])


def decode(tree: Tree, odds: np.ndarray) -> np.ndarray:
    """Which elements are article text: the best assignment without contradictions, by dynamic programming.

    Weights are the log odds of the text that stands in the element itself.
    """
    n = len(tree.parent)
    own = np.zeros(n)
    for node, run, _ in tree.runs:
        own[node] += len(run)
    gain = odds * np.sqrt(own + 1.0)
    frame, article = np.zeros(n), gain.copy()  # boilerplate scores 0 everywhere; a frame's own text counts as such
    for k in range(n - 1, 0, -1):
        p = tree.parent[k]
        frame[p] += max(frame[k], article[k], 0.0)
        article[p] += max(article[k], 0.0)
    state = np.zeros(n, np.int8)  # 0 boilerplate, 1 frame, 2 article
    state[0] = 2 if article[0] > frame[0] else 1
    for k in range(1, n):
        above = state[tree.parent[k]]
        if above == 2:
            state[k] = 2 if article[k] >= 0 else 0
        elif above == 1 and max(frame[k], article[k]) > 0:
            state[k] = 2 if article[k] >= frame[k] else 1
    return state == 2


#: Marks article text in training pages; a private-use character that stands for one place.
MARK = "\ue000"
# Class names of the laid-out pages.
ARTICLE_NAMES = ("post-content", "entry-content", "article-body", "content", "main-content", "story", "text", "entry", "")
BOILERPLATE = (
    ("nav", ("nav", "menu", "main-menu", "breadcrumb", "navigation", "")), ("header", ("header", "masthead", "topbar", "")),
    ("footer", ("footer", "site-footer", "copyright", "")), ("aside", ("sidebar", "related", "widget", "recommended", "")),
    ("div", ("ad", "ads", "advert", "sponsored", "ad-banner", "promo")),
    ("div", ("cookie-notice", "notice", "consent", "alert", "gdpr-banner", "popup")),
    ("section", ("comments", "comment-list", "discussion", "replies")), ("form", ("newsletter", "subscribe", "search", "")),
    ("div", ("share", "social", "related-posts", "sidebar", "comments", "footer", "header", "menu", "toolbar")),
)


def layout(seed: int, texts: list[str]) -> str:
    """A page around sampled texts; runs of the article start with ``MARK``."""
    rng = random.Random(seed)

    def words(least: int, most: int) -> str:
        part = rng.choice(texts).split() or ["text"]
        size = rng.randint(least, most)
        while len(part) < size:
            part = part + (rng.choice(texts).split() or ["text"])
        at = rng.randrange(len(part) - size + 1)
        return html.escape(" ".join(part[at : at + size]), quote=False)

    def named(tag: str, name: str, inner: str) -> str:
        key = rng.choice(("class", "class", "id"))
        return f'<{tag} {key}="{name}">{inner}</{tag}>' if name else f"<{tag}>{inner}</{tag}>"

    def links() -> str:
        items = [f'<a href="/x">{words(1, 4)}</a>' for _ in range(rng.randint(2, 9))]
        if rng.random() < 0.7:
            return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        return " | ".join(items)

    def small() -> str:
        tag, names = rng.choice(BOILERPLATE)
        name = rng.choice(names)
        if tag == "div" and not name:
            name = "ad"
        tag = rng.choice((tag, tag, "div")) if name else tag
        if "comment" in name or name in ("discussion", "replies"):
            replies = "".join(
                named(rng.choice(("div", "li", "article")), rng.choice(("comment", "reply", "comment-body")),
                      f"<p>{words(3, 60)}</p>") for _ in range(rng.randint(1, 5)))
            return named(tag, name, f"<h3>{words(1, 3)}</h3>{replies}")
        inner = rng.choice((
            links, lambda: words(3, 25), lambda: f"<p>{words(3, 40)}</p>", lambda: f"<h3>{words(1, 4)}</h3>" + links(),
            lambda: f"<h4>{words(1, 4)}</h4><p>{words(5, 30)}</p>",
            lambda: f"&copy; {words(1, 3)} &middot; {words(2, 12)}",
            lambda: f"<label>{words(1, 4)}</label><input><button>{words(1, 2)}</button>",
        ))()
        return named(tag, name, inner)

    def body_block() -> str:
        kind = rng.random()
        if kind < 0.72:
            text = words(1, 8) if rng.random() < 0.25 else words(8, 120)
            if rng.random() < 0.15:
                text = text.replace(" ", f' <a href="/y">{words(1, 2)}</a> ', 1)
            return f"<p>{MARK}{text}" + ("</p>" if rng.random() < 0.9 else "")
        if kind < 0.8:
            return f"<h2>{MARK}{words(1, 8)}</h2>"
        if kind < 0.86:
            return "<ul>" + "".join(f"<li>{MARK}{words(2, 20)}</li>" for _ in range(rng.randint(2, 6))) + "</ul>"
        if kind < 0.9:
            return f"<blockquote><p>{MARK}{words(5, 40)}</p></blockquote>"
        if kind < 0.93:
            return f"<figure><img src=x><figcaption>{MARK}{words(2, 12)}</figcaption></figure>"
        if kind < 0.95:
            cells = "".join(f"<tr><td>{MARK}{words(1, 4)}</td><td>{MARK}{words(1, 6)}</td></tr>" for _ in range(3))
            return f"<table>{cells}</table>"
        return small()

    title = f"<h1>{MARK}{words(2, 12)}</h1>"
    if rng.random() < 0.2:
        title = f"<header>{title}</header>"
    inner = title + "".join(body_block() for _ in range(rng.choice((1, 1, 2, rng.randint(1, 16), rng.randint(3, 16)))))
    wrap = rng.random()
    if wrap < 0.5:
        inner = named("article", rng.choice(("", "", "post")), inner)
    elif wrap < 0.65:
        inner = named("main", "", named(rng.choice(("div", "article")), rng.choice(ARTICLE_NAMES), inner))
    elif wrap < 0.75:
        inner = named("main", "", inner)
    else:
        inner = named(rng.choice(("div", "section")), rng.choice(ARTICLE_NAMES), inner)
    head = [named("nav", "", links()) if rng.random() < 0.7 else "", *[small() for _ in range(rng.randint(0, 4))]]
    tail = [*[small() for _ in range(rng.randint(0, 4))], named("footer", "", words(3, 16)) if rng.random() < 0.7 else ""]
    rng.shuffle(head)
    if rng.random() < 0.4:
        inner = named("div", rng.choice(("row", "layout", "container")), inner + (small() if rng.random() < 0.5 else ""))
    page = "".join(head) + inner + "".join(tail)
    if rng.random() < 0.5:
        page = named("div", rng.choice(("page", "wrapper", "site")), page)
    return f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title></head><body>{page}</body></html>"


def labelled_rows(page: str) -> list[tuple[list[float], float]]:
    """Features and label of the elements of a training page: 1 where all text below is marked, 0 where none is."""
    tree = Tree(page)
    n = len(tree.parent)
    marked, runs = np.zeros(n), np.zeros(n)
    for node, run, link in tree.runs:
        if not run.isspace():
            runs[node] += 1
            marked[node] += run.lstrip().startswith(MARK) or (link and marked[node] > 0)
    block = {}
    for node, run, _ in tree.runs:  # a run that goes on after a link belongs to the block that the mark opened
        block[node] = block.get(node, False) or MARK in run
    for node, yes in block.items():
        marked[node] = runs[node] if yes else 0
    for k in range(n - 1, 0, -1):
        marked[tree.parent[k]] += marked[k]
        runs[tree.parent[k]] += runs[k]
    table = features(tree)
    pure = [k for k in range(1, n) if runs[k] and marked[k] in (0, runs[k])]
    return [(table[k].tolist(), float(marked[k] > 0)) for k in pure]


def sample_texts(pages: DataFrame, rows: int = SAMPLE_PAGES) -> list[str]:
    """Runs of text from about ``rows`` pages chosen by hash; at most 40 of 400 characters from each."""
    ship_package(pages.sparkSession)
    share = min(1.0, rows / max(1, pages.count()))
    chosen = pages.where(sampled(F.col("html"), share)).select("html")

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [r for h in batch["html"] for r in sorted(Tree(h or "").runs, key=lambda r: -len(r[1]))[:40]]
            yield pd.DataFrame({"text": [html.unescape(r[1])[:400] for r in found if len(r[1]) >= 20]})

    return sorted(r.text for r in chosen.mapInPandas(runs, "text string").limit(80 * rows).collect()) or ["text"]


def train(spark: SparkSession, texts: list[str], pages: int = TRAINING_PAGES, first_seed: int = 0) -> str:
    """Boosted trees over laid-out pages, as the model's printed form."""
    return GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, minInstancesPerNode=5).fit(
        training_rows(spark, texts, pages, first_seed)).toDebugString


def training_rows(spark: SparkSession, texts: list[str], pages: int, first_seed: int) -> DataFrame:
    ship_package(spark)

    def laid_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for k in batch["id"] for r in labelled_rows(layout(int(k), texts))]
            yield pd.DataFrame({"row": [x for x, _ in rows], "label": [y for _, y in rows]})

    table = spark.range(first_seed, first_seed + pages, 1, 4).mapInPandas(laid_out, "row array<double>, label double")
    return table.select(array_to_vector("row").alias("features"), "label")


class Boosted:
    """A printed model as arrays: for each tree its features, thresholds, children and leaf values."""

    def __init__(self, printed: str):
        self.trees, weight = [], 1.0
        lines = [line.strip() for line in printed.splitlines()[1:]]
        starts = [k for k, line in enumerate(lines) if line.startswith("Tree ")]
        for a, b in zip(starts, [*starts[1:], len(lines)]):
            weight = float(re.search(r"weight ([-\d.eE]+)", lines[a])[1])
            nodes: list[list[float]] = []
            self._grow(iter([x for x in lines[a + 1 : b] if x]), nodes)
            table = np.array(nodes)
            self.trees.append((table[:, 0].astype(int), table[:, 1], table[:, 2:4].astype(int), weight * table[:, 4]))

    def _grow(self, lines, nodes: list) -> int:
        line, at = next(lines), len(nodes)
        nodes.append([0, 0.0, at, at, 0.0])
        if line.startswith("Predict"):
            nodes[at][1], nodes[at][4] = np.inf, float(line.split(":")[1])
            return at
        test = re.match(r"If \(feature (\d+) <= ([-\d.eE]+)\)", line)
        left = self._grow(lines, nodes)
        next(lines)  # the Else line says the same again
        right = self._grow(lines, nodes)
        nodes[at][:4] = [int(test[1]), float(test[2]), left, right]
        return at

    def log_odds(self, table: np.ndarray) -> np.ndarray:
        total, rows = np.zeros(len(table)), np.arange(len(table))
        for feature, threshold, child, value in self.trees:
            at = np.zeros(len(table), int)
            for _ in range(DEPTH):
                at = child[at, (table[rows, feature[at]] > threshold[at]).astype(int)]
            total += value[at]
        return 2 * total


def main_texts(pages: DataFrame, model: str | None = None) -> DataFrame:
    """``pages`` (with ``html`` and any other columns) with ``text``, which replaces a column of that name."""
    spark = pages.sparkSession
    ship_package(spark)
    model = model or train(spark, sample_texts(pages.select("html")))
    rest = [c for c in pages.columns if c != "text"]
    source = pages.select(*rest, F.coalesce("html", F.lit("")).alias("_html"))
    schema = T.StructType([*[pages.schema[c] for c in rest], T.StructField("text", T.StringType())])

    def extracted(batches):
        boosted = Boosted(model)
        for batch in batches:
            texts: list[str] = []
            for at in range(0, batch.num_rows, 32):
                trees = [Tree(h) for h in batch.column("_html").slice(at, 32).to_pylist()]
                odds = boosted.log_odds(np.concatenate([features(t) for t in trees]))
                ends = np.cumsum([len(t.parent) for t in trees])
                texts += [t.text(decode(t, o)) for t, o in zip(trees, np.split(odds, ends[:-1]))]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in rest], pa.array(texts, pa.string())], names=[*rest, "text"])

    return source.mapInArrow(extracted, schema)
