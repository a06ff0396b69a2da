"""Main text of web pages by a tree-structured graphical model.

Every page becomes a tree of its block elements with the runs of inline text
as leaves. A node is content or not; its own features give a score, and every
parent-child edge prefers equal labels with a strength that was learned for
its kind. Sum-product messages, once upwards and once downwards, give every
node's exact content marginal; leaves above one half are the text.

The weights are fitted by maximum likelihood on labelled pages
(``page_templates`` makes ``TRAINING_PAGES`` of them with varied markup; pass
other labelled pages to ``train`` for one's own sites). The model is a few
hundred numbers; pages are parsed and judged one by one inside tasks, without
any shuffle.

Defined cases: null or empty html gives an empty text; text without markup is
one block; unclosed, crossed and unknown tags are closed as browsers do;
repeated rows give repeated results; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tally.llm.common import ship
from tally.llm.page_templates import TRAINING_PAGES, labelled_pages

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_CAMEL = re.compile(r"([a-z])([A-Z])")
_SPLIT = re.compile(r"[^a-z]+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript iframe textarea title template svg math object xmp noembed noframes".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q ruby rb rp rt s samp "
                    "small span strike strong sub sup time tt u var wbr".split())
_CLOSES_P = frozenset("address article aside blockquote body center details dialog dir div dl dd dt fieldset "
                      "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre "
                      "section summary table tbody td tfoot th thead tr ul".split())
#: What an opening tag closes if it is open above, up to one of the stops.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
           "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
           "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
           "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "body": ({"head"}, {"html"})}

_TAG_KIND = {t: k for k, tags in {
    "article": "article", "main": "main", "section": "section", "box": "div center", "para": "p blockquote pre",
    "head": "h1 h2 h3 h4 h5 h6 hgroup", "list": "ul ol dl dir", "item": "li dt dd", "menu": "nav menu",
    "header": "header", "footer": "footer", "aside": "aside", "address": "address",
    "form": "form fieldset button select option optgroup label legend input textarea output progress meter datalist",
    "table": "table tbody thead tfoot tr", "cell": "td th caption", "figure": "figure figcaption picture",
    "details": "details summary dialog", "root": "html body", "skip": "head"}.items() for t in tags.split()}

#: Words of class, id, role and similar attributes, by what they tell.
_ATTR_KIND = {w: k for k, words in {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs crumb crumbs pagination pager topnav subnav "
            "skip skiplink toc toolbar",
    "header": "header masthead topbar branding logo sitename siteheader pagehead strapline tagline banner hero",
    "footer": "footer foot colophon copyright legal contentinfo imprint siteinfo bottom",
    "side": "sidebar side aside rail related recommended recommendations trending popular widget widgets more "
            "complementary teaser teasers archive archives recent links blogroll tagcloud tags latest further read "
            "also promo promoted",
    "notice": "cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe "
              "subscription paywall toast privacy warning announcement message flash dialog disclaimer",
    "ad": "ad ads advert adverts advertisement advertising adsense adslot adbox sponsor sponsored sponsors promotion "
          "commercial dfp outbrain taboola partner",
    "form": "form search searchbox login signin signup register feedback contact input poll survey",
    "comment": "comment comments commentlist discussion discuss disqus reply replies respond responses thread reader "
               "readers reviews guestbook talkback",
    "social": "share sharing social follow facebook twitter like likes print byline author meta date timestamp "
              "rating votes",
    "content": "article content post entry story body main text articlebody maincontent prose copy news page "
               "paragraph document blogpost hentry"}.items() for w in words.split()}
_READ_ATTRS = frozenset(("class", "id", "role", "itemprop", "aria-label", "data-role", "data-component", "name",
                         "data-testid", "itemtype"))


class Tree:
    """Block tree of a page: parallel lists per node, parents before children."""

    def __init__(self) -> None:
        self.tag: list[str] = []
        self.attrs: list[str] = []
        self.parent: list[int] = []
        self.text: list[str | None] = []  # leaves: the text
        self.linked: list[int] = []  # leaves: characters inside links

    def add(self, tag: str, attrs: str, parent: int, text: str | None = None, linked: int = 0) -> int:
        self.tag.append(tag)
        self.attrs.append(attrs)
        self.parent.append(parent)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.tag) - 1


def _readable(raw: str) -> str:
    return " ".join(unescape(raw).split())


def parse(html: str) -> Tree:
    """The page's block tree. Inline tags are dropped without a trace, ``br``
    is a space; raw elements (scripts and the like) are left out."""
    tree = Tree()
    root = tree.add("html", "", -1)
    stack: list[tuple[str, int]] = [("html", root)]  # open elements; inline ones carry their block's node
    buffer: list[str] = []
    links, linked = 0, 0  # open links; characters in them

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = _readable("".join(buffer))
            if text:
                tree.add("#text", "", stack[-1][1], text, min(linked, len(text)))
            buffer.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            buffer.append(raw)
            if links:
                linked += len(raw.strip())

    def close(at: int) -> None:
        """Close the open elements from ``at`` on."""
        nonlocal links
        if any(t not in _INLINE for t, _ in stack[at:]):
            flush()
        links -= sum(t == "a" for t, _ in stack[at:])
        del stack[at:]

    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            say(html[at:])
            break
        say(html[at:m.start()])
        at = m.end()
        tag = m.group(2) or m.group(5)
        if tag is None:
            if m.group().startswith("<![CDATA["):
                say(m.group()[9:-3])
            continue
        tag, attrs = tag.lower(), m.group(3) or m.group(6) or ""
        if m.group(1) or m.group(4):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
                if tag in _INLINE and stack[i][0] not in _INLINE:
                    break  # a crossed inline end tag closes no block
            continue
        if tag == "br":
            say(" ")
            continue
        if tag == "hr":
            flush()
        if tag in _VOID:
            continue
        if tag in _RAW:
            if not attrs.endswith("/"):
                end = re.compile(r"</" + tag + r"(?=[\s/>])[^>]*>", re.I).search(html, at)
                at = end.end() if end else n
            continue
        if tag in _INLINE:
            if not attrs.endswith("/") or tag == "a":
                stack.append((tag, stack[-1][1]))
                links += tag == "a"
            continue
        if tag == "html":
            continue
        if tag in _CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] not in _INLINE:
                    break
        if tag in _CLOSES:
            shut, stop = _CLOSES[tag]
            found = 0
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in shut:
                    found = i
                if stack[i][0] in stop:
                    break
            if found:
                close(found)
        flush()
        stack.append((tag, tree.add(tag, attrs, stack[-1][1])))
    flush()
    return tree


@lru_cache(maxsize=65536)
def _attr_kinds(attrs: str) -> frozenset[str]:
    kinds = set()
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(
                r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            kinds.add("hidden")
        elif name in _READ_ATTRS:
            for word in _SPLIT.split(_CAMEL.sub(r"\1 \2", value).lower()):
                if word in _ATTR_KIND:
                    kinds.add(_ATTR_KIND[word])
        elif name == "onclick":
            kinds.add("form")
    return frozenset(kinds)


def _bin(x: float, edges: tuple[float, ...]) -> int:
    return sum(x >= e for e in edges)


def features(tree: Tree) -> list[list[str]]:
    """Names of the features of every node."""
    n = len(tree.tag)
    words, chars, linked, stops, blocks = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        text = tree.text[i]
        if text is not None:
            words[i], chars[i], linked[i] = text.count(" ") + 1, len(text), tree.linked[i]
            stops[i] = text.count(". ") + text.count("? ") + text.count("! ") + text.endswith((".", "?", "!", "…"))
            blocks[i] = 1
        if (p := tree.parent[i]) >= 0:
            words[p] += words[i]
            chars[p] += chars[i]
            linked[p] += linked[i]
            stops[p] += stops[i]
            blocks[p] += blocks[i]
    out = []
    for i in range(n):
        text = tree.text[i]
        if text is not None:
            up = _TAG_KIND.get(tree.tag[tree.parent[i]], "other")
            names = ["leaf", "leaf in " + up, f"leaf words {_bin(words[i], (2, 4, 8, 14, 25, 60))}",
                     f"leaf links {_bin(linked[i] / chars[i], (0.01, 0.3, 0.7))}",
                     f"leaf stops {_bin(stops[i] / words[i], (0.001, 0.03, 0.15, 0.4))}",
                     f"leaf in {up} stops {min(stops[i], 2)}"]
            if "©" in text:
                names.append("leaf ©")
            if any(c in text for c in "|»›•·→"):
                names.append("leaf mark")
        else:
            kind = _TAG_KIND.get(tree.tag[i], "other")
            names = ["box", "box " + kind]
            names += [f"attr {a}" for a in _attr_kinds(tree.attrs[i])]
            if words[i]:
                names += [f"box words {_bin(words[i], (4, 10, 30, 80, 200))}",
                          f"box links {_bin(linked[i] / chars[i], (0.05, 0.3, 0.7))}",
                          f"box stops {_bin(stops[i] / words[i], (0.001, 0.03, 0.15, 0.4))}",
                          f"box mean {_bin(words[i] / blocks[i], (3, 8, 20, 50))}"]
        if i:
            names.append(_edge(tree, i))
            up = tree.parent[i]
            names += [f"under {a}" for a in _attr_kinds(tree.attrs[up])]
            names.append("under " + _TAG_KIND.get(tree.tag[up], "other") + " tag")
        out.append(names)
    return out


def _edge(tree: Tree, i: int) -> str:
    """Kind of the edge from node ``i`` to its parent."""
    up = _TAG_KIND.get(tree.tag[tree.parent[i]], "other")
    up = up if up in ("root", "box", "section", "main", "article") else "small"
    return f"edge {up} {'leaf' if tree.text[i] is not None else 'box'}"


def train(pages: list[tuple[str, list[tuple[str, bool]]]], rounds: int = 300, decay: float = 5e-5) -> dict[str, float]:
    """Weights from labelled pages (html, then (block text, content?) in page
    order) by maximum likelihood; the expectations in its gradient are
    sum-product marginals, computed for all pages level by level. A box is
    content when most words in it are."""
    names: dict[str, int] = {}
    entries: list[tuple[int, int]] = []
    parent, depth, kind, label = [], [], [], []
    kinds: dict[str, int] = {}
    for html, blocks in pages:
        tree = parse(html)
        n, base = len(tree.tag), len(parent)
        flag = iter(blocks)
        good, total, level = [0.0] * n, [0.0] * n, [0] * n
        for i in range(n):
            if i:
                level[i] = level[tree.parent[i]] + 1
            if tree.text[i] is not None:
                text, yes = next(flag)
                if text != tree.text[i]:
                    raise ValueError(f"label for {text!r}, found {tree.text[i]!r}")
                total[i] = tree.text[i].count(" ") + 1
                good[i] = total[i] * yes
        for i in range(n - 1, 0, -1):
            good[tree.parent[i]] += good[i]
            total[tree.parent[i]] += total[i]
        for i, fs in enumerate(features(tree)):
            entries += [(base + i, names.setdefault(f, len(names))) for f in fs]
            parent.append(base + tree.parent[i] if i else -1)
            depth.append(level[i])
            kind.append(kinds.setdefault(_edge(tree, i), len(kinds)) if i else 0)
            label.append(1.0 if 2 * good[i] > total[i] else -1.0)
    up_to, at_depth, edge, y = np.array(parent), np.array(depth), np.array(kind), np.array(label)
    x = np.zeros((len(y), len(names)), np.float32)
    for i, f in entries:
        x[i, f] = 1
    levels = [np.flatnonzero(at_depth == d) for d in range(1, at_depth.max() + 1)]
    child = np.flatnonzero(up_to >= 0)
    together = np.bincount(edge[child], y[child] * y[up_to[child]], len(kinds))
    w = np.zeros(len(names) + len(kinds))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        coupling = w[len(names):]
        pull = np.tanh(coupling)[edge]
        field = (x @ w[:len(names)].astype(np.float32)).astype(np.float64)
        up, pair = np.zeros(len(y)), np.zeros(len(y))
        for i in levels[::-1]:
            up[i] = 2 * np.arctanh(pull[i] * np.tanh(np.clip(field[i], -30, 30) / 2))
            np.add.at(field, up_to[i], up[i])
        for i in levels:
            a, b, j = field[i], field[up_to[i]] - up[i], coupling[edge[i]]
            same = j + np.logaddexp((a + b) / 2, -(a + b) / 2)
            other = -j + np.logaddexp((a - b) / 2, (b - a) / 2)
            pair[i] = np.tanh((same - other) / 2)
            field[i] = a + 2 * np.arctanh(pull[i] * np.tanh(np.clip(b, -30, 30) / 2))
        single = x.T @ ((np.tanh(field / 2) - y) / 2).astype(np.float32)
        joint = np.bincount(edge[child], pair[child], len(kinds)) - together
        grad = np.concatenate([single, joint]) / len(y) + decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w = w - 0.15 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
        w[len(names):] = np.clip(w[len(names):], 0, 3)
    return {**{f: float(w[k]) for f, k in names.items()},
            **{"pull " + e: float(w[len(names) + k]) for e, k in kinds.items()}}


@lru_cache(maxsize=1)
def default_model() -> tuple[tuple[str, float], ...]:
    return tuple(train(labelled_pages(TRAINING_PAGES)).items())


def marginals(tree: Tree, model: dict[str, float]) -> list[float]:
    """Content log-odds of every node by sum-product on the tree."""
    n = len(tree.tag)
    own = [sum(model.get(f, 0.0) for f in fs) for fs in features(tree)]
    pull = [0.0] + [math.tanh(model.get("pull " + _edge(tree, i), 0.0)) for i in range(1, n)]

    def message(field: float, t: float) -> float:
        return 2 * math.atanh(t * math.tanh(max(-30.0, min(30.0, field)) / 2))

    up, inward = [0.0] * n, own[:]
    for i in range(n - 1, 0, -1):  # children come after their parents
        up[i] = message(inward[i], pull[i])
        inward[tree.parent[i]] += up[i]
    for i in range(1, n):
        inward[i] += message(inward[tree.parent[i]] - up[i], pull[i])
    return inward


def main_text(html: str | None, model: dict[str, float]) -> str:
    if not html:
        return ""
    tree = parse(html)
    odds = marginals(tree, model)
    return " ".join(t for t, o in zip(tree.text, odds) if t is not None and o > 0)


def extract_main_text(pages: DataFrame, model: dict[str, float] | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page (``page_id, url, html``)."""
    model = dict(default_model()) if model is None else model

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), model) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    ship("tally.llm.page_templates", __name__)
    return pages.select("page_id", "url", "html").mapInArrow(
        read, "page_id long, url string, text string, n_chars long")
