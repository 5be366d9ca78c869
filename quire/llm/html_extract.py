"""Main text of web pages by belief propagation over the page's element tree.

Every element is content or not. A node's potential is a weighted sum of features: its tag,
what its class and id call it, and its text length and link share within the named part round
it. An edge's potential says how much a child is like its parent, by what kind of child it is.
Sum-product messages pass from the leaves to the root and back, and an element's text is kept
if its marginal for content is over one half.

All weights, of nodes and edges, are fitted together on labelled pages by their pseudo-likelihood:
each element's label given its features and its neighbours' labels. The labelled pages are those that
mark their article; elements inside it that no menu, notice or the like encloses are content. Each is
fitted as it is and once more without its marks, so that the weights also serve pages that mark nothing.
Names on the lists below are features too, whose weights start from a prior and are learned as all others.
"""

from __future__ import annotations

import copy
import html
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.words import sliced

#: Labelled pages that are fitted to, about; the most frequent patterns of a node and its neighbours, and features, that are kept.
TRAIN_PAGES, TRAIN_PATTERNS, TRAIN_FEATURES = 2000, 20_000, 250
#: Weights before any page is seen, and how many labelled nodes they are worth; a feature not named here starts from 0.
PRIOR = {"named other": -8.0, "named main": 4.0, "text long": 1.0, "links 2": -1.0, "links 3": -4.0, "links 4": -4.0, "edge plain": 3.0, "edge follow": 4.0}
PRIOR_NODES = 10.0

RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "math", "select", "object", "canvas", "video", "audio"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
OTHER_TAGS = {"nav", "header", "footer", "aside", "form", "button", "menu", "dialog", "head", "fieldset", "label"}
OTHER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
OTHER_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "nav", "navbar",
    "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "sidebar", "aside", "notice", "cookie", "cookies", "consent",
    "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "share", "sharing", "social", "related", "recommended", "comment", "comments",
    "disqus", "reply", "replies", "respond", "form", "search", "login", "pagination", "pager", "toolbar", "widget", "copyright",
}
MAIN_TAGS, MAIN_ROLES = {"article", "main"}, {"main", "article"}
MAIN_WORDS = {"article", "content", "main", "post", "entry", "story"}
#: Words that may stand beside those in a name without changing what it names.
PLAIN_WORDS = {
    "area", "bar", "block", "body", "bottom", "box", "col", "container", "global", "group", "holder", "inner", "item", "items", "left", "links",
    "list", "module", "outer", "page", "panel", "posts", "primary", "region", "right", "row", "secondary", "section", "site", "slot", "text", "top",
    "unit", "wrap", "wrapper", "zone",
}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "br", "wbr", "img"}
#: Elements without evidence of their own unless they are named: they go with what is round them.
FOLLOW = INLINE | {"#page", "html", "body"}
#: Elements whose inside is no text up to their end tag, even if they look closed.
NEVER_EMPTY = {"script", "style", "textarea", "title"}
#: An opening tag closes these open elements, up to a container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CONTAINERS = {"ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "menu", "article", "main", "section", "div", "body", "html", "nav", "aside", "header", "footer", "form", "blockquote"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"[ \t\n\r\x0b\f]+")


def _attributes(source: str) -> dict[str, str]:
    """Attributes of a tag by lower-cased name; of a name that repeats, the first."""
    found = {}
    for name, a, b, c in _ATTR.findall(source):
        found.setdefault(name.lower(), a or b or c)
    return found


def _named(name: str) -> int:
    """1 or -1 if a class or id as a whole names content or another part: by a word of the lists, with nothing but plain words beside it."""
    words = {w.lower() for w in _WORD.findall(name)}
    if words <= OTHER_WORDS | MAIN_WORDS | PLAIN_WORDS:
        return -1 if words & OTHER_WORDS else int(bool(words & MAIN_WORDS))
    return 0


def _kind(tag: str, attrs: str) -> tuple[int, list[str]]:
    """1 or -1 if the element names its part as content or as another, else 0; and its classes and id."""
    found = _attributes(attrs) if attrs else {}
    names = [n.lower() for n in f"{found.get('class', '')} {found.get('id', '')}".split()]
    role = found.get("role", "").lower()
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    if tag in RAW or tag in OTHER_TAGS or role in OTHER_ROLES or hidden:
        return -1, names
    if tag in MAIN_TAGS or role in MAIN_ROLES:
        return 1, names
    if tag in ("html", "body"):
        return 0, []
    kinds = {_named(n) for n in f"{found.get('class', '')} {found.get('id', '')}".split()}
    return (-1 if -1 in kinds else int(1 in kinds)), names


class Page:
    """Element tree of a page: tags, parents, kinds and names by node; runs of text with their node, None where a block ends."""

    def __init__(self, source: str):
        self.tags, self.parents, self.kinds, self.names = ["#page"], [-1], [0], [[]]
        self.open = Counter()  # open elements by tag, so that no stack is searched in vain
        self.runs: list[tuple[int, str] | None] = []
        open_nodes = [0]
        at, runs = 0, self.runs
        match = _TOKEN.search(source)
        while match:
            if match.start() > at:
                runs.append((open_nodes[-1], source[at:match.start()]))
            at = match.end()
            closing, tag, attrs = (match[1], match[2], match[3]) if match[2] else (match[4], match[5], match[6])
            if tag:
                tag = tag.lower()
                if tag not in INLINE:
                    runs.append(None)
                elif tag == "br":
                    runs.append((open_nodes[-1], " "))
                if closing:
                    self._close(open_nodes, tag)
                else:
                    self._open(open_nodes, tag, attrs)
                    if tag in RAW:
                        self._cut(open_nodes, len(open_nodes) - 1)
                        if tag in NEVER_EMPTY or not attrs.endswith("/"):
                            end = re.compile(f"</{re.escape(tag)}\\s*>", re.I).search(source, at)
                            at = end.end() if end else len(source)
            match = _TOKEN.search(source, at)
        if at < len(source):
            runs.append((open_nodes[-1], source[at:]))

    def _cut(self, open_nodes, k):
        for node in open_nodes[k:]:
            self.open[self.tags[node]] -= 1
        del open_nodes[k:]

    def _open(self, open_nodes, tag, attrs):
        if tag not in INLINE and self.open["p"]:  # a block ends an open paragraph, unless a container stands between
            for k in range(len(open_nodes) - 1, 0, -1):
                name = self.tags[open_nodes[k]]
                if name == "p":
                    self._cut(open_nodes, k)
                    break
                if name in CONTAINERS:
                    break
        ends = CLOSES.get(tag)
        if ends and any(self.open[t] for t in ends):
            for k in range(len(open_nodes) - 1, 0, -1):
                name = self.tags[open_nodes[k]]
                if name in ends:
                    self._cut(open_nodes, k)
                    if tag != "tr" or name == "tr":
                        break
                elif name in CONTAINERS:
                    break
        if tag in VOID:
            return
        kind, names = _kind(tag, attrs)
        self.tags.append(tag)
        self.parents.append(open_nodes[-1])
        self.kinds.append(kind)
        self.names.append(names)
        self.open[tag] += 1
        open_nodes.append(len(self.tags) - 1)

    def _close(self, open_nodes, tag):
        if self.open[tag]:
            for k in range(len(open_nodes) - 1, 0, -1):
                if self.tags[open_nodes[k]] == tag:
                    self._cut(open_nodes, k)
                    return

    def features(self) -> list[list[str]]:
        """Names of each node's features."""
        n = len(self.tags)
        chars, linked = [0] * n, [0] * n
        for run in self.runs:
            if run:
                chars[run[0]] += len(run[1].strip())
        for i in range(n - 1, 0, -1):
            if self.tags[i] == "a":
                linked[i] = chars[i]
            chars[self.parents[i]] += chars[i]
            linked[self.parents[i]] += linked[i]
        out, within = [], [""] * n  # the nearest named part round a node: what is usual in a menu says little in an article
        for i in range(n):
            if i:
                p = self.parents[i]
                within[i] = within[p] if not self.kinds[p] else " in main" if self.kinds[p] > 0 else " in other"
            tag, kind, names = self.tags[i], self.kinds[i], [f"name {n}" for n in self.names[i][:8]]
            if kind:
                out.append(["named main" if kind > 0 else "named other", f"named {tag}", *names])
            elif tag in FOLLOW:
                out.append(names)
            else:
                size = "none" if not chars[i] else "short" if chars[i] < 40 else "some" if chars[i] < 200 else "long"
                links = 4 * linked[i] // chars[i] if chars[i] else 0
                out.append([f"tag {tag}{within[i]}", f"text {size}{within[i]}", f"links {links}{within[i]}", *names])
        return out

    def edges(self) -> list[str]:
        """The kind of edge from each node to its parent."""
        return ["edge main" if k > 0 else "edge other" if k < 0 else "edge follow" if t in FOLLOW else "edge plain" for t, k in zip(self.tags, self.kinds, strict=True)]

    def labels(self) -> list[int] | None:
        """1 for elements of the marked article that no other part encloses; None if the page marks none."""
        n = len(self.tags)
        inside, other = [False] * n, [False] * n
        for i in range(1, n):
            p = self.parents[i]
            inside[i] = inside[p] or self.tags[i] in MAIN_TAGS
            other[i] = other[p] or self.kinds[i] < 0
        return [int(a and not b) for a, b in zip(inside, other, strict=True)] if any(inside) else None

    def unmarked(self) -> Page:
        """The page as it would be if nothing in it named the content."""
        page = copy.copy(self)
        page.tags = ["div" if t in MAIN_TAGS else t for t in self.tags]
        page.names = [[] if k > 0 else names for k, names in zip(self.kinds, self.names, strict=True)]
        page.kinds = [min(k, 0) for k in self.kinds]
        return page

    def text(self, content: list[bool]) -> str:
        blocks, block = [], []
        for run in [*self.runs, None]:
            if run is None:
                if block:
                    line = _SPACE.sub(" ", html.unescape("".join(block))).strip(" ")
                    if line:
                        blocks.append(line)
                    block = []
            elif content[run[0]]:
                block.append(run[1])
        return "\n".join(blocks)


class Tree:
    """Weights of features and edges; what is not among them has its prior."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.weights = PRIOR | (weights or {})

    def own(self, page: Page) -> list[float]:
        """Log-odds of each element for content without its neighbours."""
        return [sum([self.weights.get(f, 0.0) for f in names]) for names in page.features()]

    def marginals(self, page: Page) -> list[float]:
        """Log-odds of each element for content, by messages upward and downward."""
        n, parents = len(page.tags), page.parents
        alike = [self.weights.get(e, 0.0) for e in page.edges()]
        held, up = self.own(page), [0.0] * n
        for i in range(n - 1, 0, -1):
            up[i] = _message(held[i], alike[i])
            held[parents[i]] += up[i]
        for i in range(1, n):
            held[i] += _message(held[parents[i]] - up[i], alike[i])  # from what the parent knows without this child
        return held

    def extract(self, source: str) -> str:
        page = Page(source)
        return page.text([x > 0 for x in self.marginals(page)])


def _message(odds: float, alike: float) -> float:
    """Log-odds that a neighbour's log-odds pass over an edge on which equal labels are e^alike as likely as unequal ones."""
    odds = max(-30.0, min(30.0, odds))
    return math.log((1 + math.exp(odds + alike)) / (math.exp(alike) + math.exp(odds)))


def _patterns(batches):
    """Distinct (features, sums of the neighbours' labels by kind of edge, label) of labelled nodes, counted."""
    for batch in batches:
        found = Counter()
        for source in batch.column(0).to_pylist():
            page = Page(source or "")
            labels = page.labels()
            if labels is None:
                continue
            for seen in (page, page.unmarked()):
                edges, near = seen.edges(), [Counter() for _ in labels]
                for i in range(1, len(labels)):
                    p = page.parents[i]
                    near[i][edges[i]] += 2 * labels[p] - 1
                    near[p][edges[i]] += 2 * labels[i] - 1
                for i, names in enumerate(seen.features()):
                    if i:
                        sums = [f"{edge}\t{v}" for edge, v in sorted(near[i].items()) if v]
                        found["\n".join(names) + "\r" + "\n".join(sums), labels[i]] += 1
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([y for _, y in found], pa.int32()), pa.array(list(found.values()), pa.int64())], ["pattern", "label", "n"])


def fit(patterns, prior_nodes: float = PRIOR_NODES) -> dict[str, float]:
    """Weights of greatest pseudo-likelihood, by Newton steps, for rows of (pattern, label, n); their prior counts as ``prior_nodes`` nodes."""
    rows = []
    for pattern, label, n in patterns:
        names, _, sums = pattern.partition("\r")
        values = Counter(filter(None, names.split("\n")))
        for part in filter(None, sums.split("\n")):
            edge, v = part.split("\t")
            values[edge] += float(v)
        rows.append((values, label, n))
    seen = Counter()
    for values, _, n in rows:
        for name in values:
            seen[name] += n
    names = sorted(seen, key=lambda f: (-seen[f], f))[:TRAIN_FEATURES]
    if not names:
        return {}
    at = {name: j for j, name in enumerate(names)}
    x = np.zeros((len(rows), len(names)))
    for i, (values, _, _) in enumerate(rows):
        for name, v in values.items():
            if name in at:
                x[i, at[name]] = v
    y, n = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float)
    centre = np.array([PRIOR.get(name, 0.0) for name in names])
    n, keep = n / n.sum(), prior_nodes / n.sum()  # a mean over the nodes
    w = centre.copy()

    def loss(w):
        z = x @ w
        return n @ (np.logaddexp(0, z) - y * z) + keep / 2 * ((w - centre) ** 2).sum()

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (p - y)) + keep * (w - centre)
        step = np.linalg.solve((x.T * (n * p * (1 - p))) @ x + keep * np.eye(len(w)), slope)
        size, here = 1.0, loss(w)
        while size > 1e-6 and loss(w - size * step) > here:
            size /= 2
        w -= size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return {name: float(v) for name, v in zip(names, w, strict=True)}


def train(pages: DataFrame, most: int = TRAIN_PAGES) -> Tree:
    """Weights from about ``most`` pages, those whose url hashes lowest; the prior's without a labelled page."""
    share = most / max(1, pages.count())
    sample = pages.filter(F.pmod(F.xxhash64("url"), F.lit(1 << 30)) < int(share * (1 << 30))).select("html")
    counts = sample.mapInArrow(_patterns, "pattern string, label int, n long").groupBy("pattern", "label").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "pattern", "label").limit(TRAIN_PATTERNS).collect()
    return Tree(fit([(r["pattern"], r["label"], r["n"]) for r in top]))


def _extract(tree):
    def run(batches):
        for batch in sliced(batches, 1):
            texts = [tree.extract(source) if source else "" for source in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["q_row", "text", "n_chars"])

    return run


def extract_text(pages: DataFrame, tree: Tree | None = None) -> DataFrame:
    """The input's columns without ``html``, with text and n_chars (which replace columns of these names).

    Text is that of all content elements in page order: references decoded, white space
    within a block one space, blocks joined by a line break. A null or empty page, or one
    without content, gives "". Rows that repeat give the same text; an empty table gives
    an empty result.
    """
    tree = tree or train(pages)
    rest = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    rows = pages.select(F.struct(*rest).alias("q_row"), "html")
    kind = rows.schema["q_row"].dataType.simpleString()
    return rows.mapInArrow(_extract(tree), f"q_row {kind}, text string, n_chars long").select("q_row.*", "text", "n_chars")
