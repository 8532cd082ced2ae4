"""Main-text extraction with a tree-structured graphical model over the DOM.

Every element with text or children of interest is a node with two states, boilerplate and content. A node's potential is a
linear function of its features (tag, words of class and id, length and link density of its text, place on the page); each
parent-child edge has a 2 x 2 potential that depends on whether the child is a block. Sum-product messages upward and downward
give each node's marginal; text belongs to its nearest node. Parameters are fitted by gradient ascent on the likelihood of
labelled pages (`htmlpages.LABELLED`), whose exact gradient needs the same messages.

The whole page is read. Character references are decoded, white space inside a block becomes one space, blocks are trimmed and
joined by one newline in page order; nothing else is dropped or capped. Scripts, styles, comments, forms' fields and the head
are markup, never text. Null or empty pages, and pages without content, give the empty string.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docketry.llm.common import by_batch
from docketry.llm.htmlpages import LABELLED

# Fixed values of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HIDDEN = frozenset("script style template noscript head svg math iframe object canvas audio video select textarea".split())
_RAW = frozenset("script style textarea title template noscript iframe".split())
_BLOCK = frozenset(
    "address article aside blockquote body button center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup html label legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag closes these open elements, up to the nearest of the listed scopes.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPES = frozenset("ul ol menu dl table tbody thead tfoot select".split())
_SCOPED = _SCOPES | frozenset(_CLOSES) | frozenset(t for closed in _CLOSES.values() for t in closed)
_ENDS_P = _BLOCK - {"button", "label", "option", "td", "th", "tr"}
#: Start tags that leave an open head in place; those that end an open svg or math; the elements of these two that hold HTML.
_IN_HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
_ENDS_SVG = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small "
    "span strong strike sub sup table tt u ul var".split()
)
_HOLDS_HTML = frozenset(("annotation-xml", "desc", "foreignobject", "title"))
#: A quote opens a value only right after an equals sign; elsewhere it belongs to a name or an unquoted value, which > ends.
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|"
    r"<(/?)([a-zA-Z][^\s/>]*)((?:[\s/]+|[^\s/>][^\s/>=]*(?:\s*=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s>\"'][^\s>]*)?)?)*)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s=/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_NAME = re.compile(r"[A-Za-z]+")
_HINT_SPLIT = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: Words of tag names, classes, ids and roles, in groups that share a weight.
_HINTS = {
    "main": "article main content post entry story body text prose articlebody maincontent section-text",
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs crumbs toc pagination pager tabs",
    "head": "header masthead banner topbar logo branding hero",
    "foot": "footer foot copyright legal colophon bottom imprint",
    "side": "aside sidebar side rail widget related recommended more trending popular tags links",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion dfp",
    "notice": "cookie cookies consent gdpr notice alert modal popup overlay newsletter subscribe subscription signup paywall toast warning disclaimer",
    "form": "form search login register input button",
    "talk": "comment comments reply replies discussion disqus respond reviews reader thread",
    "share": "share social sharing follow byline meta author date tools print",
}
_HINT_OF = {w: g for g, words in _HINTS.items() for w in words.split()}
_TAGS = ("p", "div", "li", "a", "h1", "h2", "h3", "section", "article", "main", "span", "td", "nav", "aside", "footer", "header", "form", "ul", "blockquote", "pre", "body", "figcaption", "table", "button", "label")
FEATURES = ("bias", *(f"tag:{t}" for t in _TAGS), *(f"hint:{g}" for g in _HINTS), *(f"above:{g}" for g in _HINTS), "log_own", "log_all", "link_share", "marks", "in_block", "no_text", "upper", "first", "last")
_COLUMN = {f: i for i, f in enumerate(FEATURES)}


@dataclass
class Node:
    """An element: its parent's number, tag, hints, whether it or an ancestor is never text, and whether svg or math rules hold inside it."""

    parent: int
    tag: str
    hints: frozenset[str]
    hidden: bool
    link: bool
    label: int | None = None
    foreign: bool = False
    own: int = 0
    all: int = 0
    linked: int = 0
    marks: int = 0
    upper: int = 0


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=list)
    #: (node, text, block number): runs of text in page order; a new number starts a new block.
    runs: list[tuple[int, str, int]] = field(default_factory=list)


def _hints(tag: str, attrs: str) -> tuple[frozenset[str], bool, int | None]:
    out, hidden, label = set(), False, None
    if g := _HINT_OF.get(tag):
        out.add(g)
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] if m[2] is not None else m[3] if m[3] is not None else m[4]
        if name in ("class", "id", "role", "itemprop"):
            for word in _NAME.findall(_HINT_SPLIT.sub(" ", html.unescape(value))):
                if g := _HINT_OF.get(word.lower()):
                    out.add(g)
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            hidden = True
        elif name == "aria-hidden" and value == "true":
            hidden = True
        elif name == "data-label":
            label = int(value == "content")
    if re.search(r"(?:^|\s)hidden(?:\s|$|=)", _ATTR.sub(" ", attrs)):
        hidden = True
    return frozenset(out), hidden, label


def parse(source: str) -> Page:
    """The tree and text runs of a page; unclosed and stray tags are taken as browsers mostly do."""
    page = Page([Node(-1, "html", frozenset(), False, False)])
    nodes, stack, block, at = page.nodes, [0], 0, 0
    # Places on the stack of block elements, and of those that an opening tag may close or stop at; open elements by tag.
    blocks, scoped, opened = [0], [], Counter()

    def text(raw: str) -> None:
        if raw.strip():
            end_head()
        if raw and not nodes[stack[-1]].hidden:
            page.runs.append((stack[-1], html.unescape(raw), block))

    def close(upto: int) -> None:
        nonlocal block
        while len(stack) > upto:
            gone = nodes[stack.pop()].tag
            opened[gone] -= 1
            if gone in _BLOCK:
                block += 1
                blocks.pop()
            if gone in _SCOPED:
                scoped.pop()

    def end_head() -> None:
        while nodes[stack[-1]].tag == "head":
            close(len(stack) - 1)

    while at < len(source):
        m = _TOKEN.search(source, at)
        if m is None:
            text(source[at:])
            break
        text(source[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag or tag == "html":
            continue
        if m[1]:
            if opened[tag] > 0:
                k = len(stack) - 1
                while nodes[stack[k]].tag != tag:
                    k -= 1
                close(k)
            continue
        if tag not in _IN_HEAD:
            end_head()
        while nodes[stack[-1]].foreign and tag in _ENDS_SVG:
            close(len(stack) - 1)
        if tag == "br":
            text(" ")
            continue
        if tag in _VOID:
            if tag == "hr":
                block += 1
            continue
        if tag in _ENDS_P and nodes[stack[blocks[-1]]].tag == "p":
            close(blocks[-1])
        if tag == "body":
            close(1)
        for k in reversed(scoped) if tag in _CLOSES else ():
            if nodes[stack[k]].tag in _CLOSES[tag]:
                close(k)
                break
            if nodes[stack[k]].tag in _SCOPES:
                break
        above = nodes[stack[-1]]
        hints, hidden, label = _hints(tag, m[3] or "")
        nodes.append(Node(stack[-1], tag, hints, above.hidden or hidden or tag in _HIDDEN, above.link or tag == "a", above.label if label is None else label, tag in ("svg", "math") or above.foreign and tag not in _HOLDS_HTML))
        if tag in _BLOCK:
            block += 1
        if tag in _RAW and not above.foreign:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
            at = end.start() if end else len(source)
        if not (m[3] or "").rstrip().endswith("/") or tag in _BLOCK or tag in ("span", "a", "b", "i", "em", "strong"):
            if tag in _BLOCK:
                blocks.append(len(stack))
            if tag in _SCOPED:
                scoped.append(len(stack))
            opened[tag] += 1
            stack.append(len(nodes) - 1)
    for k, t, _ in page.runs:
        n = len(t.strip())
        node = nodes[k]
        node.own += n
        node.marks += sum(t.count(c) for c in ".,;:!?")
        node.upper += sum(map(str.isupper, t))
    for node in reversed(nodes):
        node.all += node.own
        node.linked += node.own if node.link else 0
        if node.parent >= 0:
            up = nodes[node.parent]
            up.all, up.linked = up.all + node.all, up.linked + node.linked
    return page


def features(page: Page) -> Iterator[list[tuple[int, float]]]:
    """(column, value) of the features that are not 0, node by node."""
    nodes, c = page.nodes, _COLUMN
    over: list[frozenset[str]] = []
    with_text = [i for i, n in enumerate(nodes) if n.all]
    first, last = (with_text[1], with_text[-1]) if len(with_text) > 1 else (-1, -1)
    for i, n in enumerate(nodes):
        above = over[n.parent] | nodes[n.parent].hints if n.parent >= 0 else frozenset()
        over.append(above)
        row = [(0, 1.0), (c["log_own"], math.log1p(n.own) / 4), (c["log_all"], math.log1p(n.all) / 6)]
        if (k := c.get(f"tag:{n.tag}")) is not None:
            row.append((k, 1.0))
        row += [(c[f"hint:{g}"], 1.0) for g in n.hints]
        row += [(c[f"above:{g}"], 1.0) for g in above]
        if n.all:
            row.append((c["link_share"], n.linked / n.all))
        else:
            row.append((c["no_text"], 1.0))
        if n.own:
            row.append((c["marks"], min(n.marks / n.own * 20, 2)))
        row.append((c["upper"], min(n.upper / max(n.own, 1), 1)))
        row += [(c[name], 1.0) for name, on in (("in_block", n.tag in _BLOCK), ("first", i == first), ("last", i == last)) if on]
        yield row


def matrix(page: Page) -> np.ndarray:
    """Features of a page's nodes; for fitting only, as a page to be read gets its potentials one node at a time."""
    x = np.zeros((len(page.nodes), len(FEATURES)))
    for row, of in zip(x, features(page)):
        for k, v in of:
            row[k] = v
    return x


@dataclass
class TreeModel:
    """weights of the node potential (content against boilerplate) and log edge potentials [child is a block][parent, child]."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(FEATURES)))
    edges: np.ndarray = field(default_factory=lambda: np.array([[[1.0, -1.0], [-1.0, 1.0]], [[0.5, -0.5], [-0.5, 0.5]]]))

    def potentials(self, page: Page) -> list[float]:
        """Each node's log potential of content."""
        w = self.weights.tolist()
        return [sum(w[k] * v for k, v in row) for row in features(page)]

    def marginals(self, page: Page, u: list[float] | np.ndarray, edges: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """P(content) of each node with log potentials `u` and, if asked for, P(parent state, child state) of each edge (row of the child)."""
        n = len(page.nodes)
        parent = [v.parent for v in page.nodes]
        kind = [int(v.tag in _BLOCK) for v in page.nodes]
        e = np.exp(self.edges - self.edges.max()).tolist()
        u1 = [1 / (1 + math.exp(-min(max(v, -30), 30))) for v in u]
        # Upward: below[i] is the product at i of its potential and its children's messages, normalised; up[i] its message to the parent.
        b0, b1, m0, m1 = [1 - u for u in u1], u1[:], [1.0] * n, [1.0] * n
        for i in range(n - 1, 0, -1):
            s = b0[i] + b1[i]
            p, q = b0[i] / s, b1[i] / s
            b0[i], b1[i] = p, q
            t = e[kind[i]]
            a, z = t[0][0] * p + t[0][1] * q, t[1][0] * p + t[1][1] * q
            s = a + z
            m0[i], m1[i] = a / s, z / s
            k = parent[i]
            b0[k], b1[k] = b0[k] * m0[i], b1[k] * m1[i]
            s = b0[k] + b1[k]
            b0[k], b1[k] = b0[k] / s, b1[k] / s
        # Downward: r is the belief; a child's share of its parent's belief is divided out before it is passed on.
        r = [0.0] * n
        r[0] = b1[0] / (b0[0] + b1[0])
        pairs = np.zeros((n, 2, 2)) if edges else None
        for i in range(1, n):
            k, t = parent[i], e[kind[i]]
            o0, o1 = (1 - r[k]) / max(m0[i], 1e-300), r[k] / max(m1[i], 1e-300)
            j = (o0 * t[0][0] * b0[i], o0 * t[0][1] * b1[i], o1 * t[1][0] * b0[i], o1 * t[1][1] * b1[i])
            s = sum(j)
            if edges:
                pairs[i] = ((j[0] / s, j[1] / s), (j[2] / s, j[3] / s))
            r[i] = (j[1] + j[3]) / s
        return np.array(r), pairs


def fit(labelled: list[str], steps: int = 150, rate: float = 0.3, decay: float = 2e-3) -> TreeModel:
    """Maximum likelihood on pages whose elements carry data-label="content" or "other" (inherited by what they contain)."""
    model = TreeModel()
    data = []
    for source in labelled:
        page = parse(source)
        y = np.array([v.label or 0 for v in page.nodes], dtype=float)
        pairs = np.zeros((len(y), 2, 2))
        for i, v in enumerate(page.nodes[1:], 1):
            pairs[i, int(y[v.parent]), int(y[i])] = 1
        data.append((page, matrix(page), y, pairs, np.array([int(v.tag in _BLOCK) for v in page.nodes])))
    n = sum(len(d[2]) for d in data)
    gw, ge = np.full_like(model.weights, 1e-6), np.full_like(model.edges, 1e-6)
    for _ in range(steps if n else 0):
        w, e = -decay * model.weights, -decay * model.edges
        for page, x, y, pairs, kind in data:
            p, q = model.marginals(page, x @ model.weights, edges=True)
            w = w + x.T @ (y - p) / n
            for k in (0, 1):
                e[k] = e[k] + (pairs - q)[1:][kind[1:] == k].sum(0) / n
        gw, ge = gw + w * w, ge + e * e
        model.weights, model.edges = model.weights + rate * w / np.sqrt(gw), model.edges + rate * e / np.sqrt(ge)
    return model


def extract(source: str | None, model: TreeModel) -> str:
    """The main text of one page."""
    page = parse(source or "")
    if not page.runs:
        return ""
    content = model.marginals(page, model.potentials(page))[0] > 0.5
    blocks: dict[int, list[str]] = {}
    for node, text, block in page.runs:
        if content[node]:
            blocks.setdefault(block, []).append(text)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(x for x in lines if x)


def main_text(pages: DataFrame, model: TreeModel | None = None) -> DataFrame:
    """page_id, url, text, n_chars for each row of `pages`; the model (some 100 numbers) ships with the task."""
    model = model or fit(LABELLED)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [extract(x, model) for x in batch.column("html").to_pylist()]
        return pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(got, pa.string()), pa.array([len(t) for t in got], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return by_batch(pages.select("page_id", "url", "html"), work, "page_id long, url string, text string, n_chars long", rows=200)
