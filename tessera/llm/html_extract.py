"""Main text of web pages by a tree-structured graphical model.

A page's block elements form a tree of binary variables (content or not). A node's potential is a
weighted sum of its features (tag, class, id and role words, lengths, link share); an edge's potential
depends on the labels of parent and child. Sum-product messages go up and down the tree, all pages
of a batch level by level, and give each node's content marginal. Weights are learnt by gradient ascent on
the exact likelihood of labelled pages, which ``labelled_pages`` writes: page layouts with and without
semantic tags, whose boilerplate is marked as it is written.

A text block is the text between two block boundaries; it is kept if its node's marginal is at least one half. A null
html is empty and yields an empty text. Ill-formed markup is read as browsers do in the main (implied end tags, unclosed
and stray tags); unknown tags are inline. Long and deep pages, and pages with unclosed quotes, take time in proportion to their length. A
block whose marginal is exactly one half stays. Repeated rows get equal rows; an empty table gives an empty result. Columns besides page_id,
url and html aren't read, whatever their names.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import ship

#: Fixed values of HTML: elements without content, elements whose content is no text of the page,
#: elements that bound a block of text, and elements that end an open one of the same family.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = frozenset("script style iframe title".split())  # hold no elements: without an end tag they last to the end of the page
DROPPED = frozenset("script style noscript template svg math iframe object head title canvas audio video".split())
BLOCK = frozenset(
    "html body div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th article section main nav aside header footer"
    " figure figcaption blockquote pre address form fieldset legend details summary dialog hr center button select option textarea label menu hgroup search".split()
)
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
IN_P = BLOCK - {"button", "label", "select", "option", "textarea"}

_OPEN = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_STOP = re.compile(r"""[>"']""")
_CLOSED_BY = {"<!--": "-->", "<![CDATA[": "]]>"}
_ATTR = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile(r"[A-Za-z][a-z]*")


@dataclass
class Page:
    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    names: list[tuple[str, ...]] = field(default_factory=list)
    label: list[int | None] = field(default_factory=list)
    chars: list[int] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    blocks: list[tuple[int, str]] = field(default_factory=list)  # node and text, in page order


def _attributes(raw: str) -> tuple[tuple[str, ...], int | None]:
    names, label = [], None
    for m in _ATTR.finditer(raw):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key in ("class", "id", "role", "itemprop"):
            names += [w.lower() for w in _WORD.findall(value)]
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            names.append("@hidden")
        elif key == "data-gold":
            label = int(value)
    return tuple(dict.fromkeys(names)), label


def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}[\s/>]|<body[\s>]" if tag == "head" else rf"</{re.escape(tag)}[\s/>]", re.I)


def _token(text: str, at: int) -> tuple[int, int, str | None, bool, str] | None:
    """The next piece of markup from a place on: start, end, name (none if it isn't a tag), whether it is an end tag, and what follows the name.

    A quote hides ``>`` up to the next one of its kind; if there is none, it is a character like any other. As no later
    quote of that kind can then be met, all tokens of a page take time in proportion to it.
    """
    m = _OPEN.search(text, at)
    if m is None:
        return None
    if m[2] is None:
        by = _CLOSED_BY.get(m[0], ">")
        end = text.find(by, m.end())
        return m.start(), end + len(by) if end >= 0 else len(text), None, False, ""
    p = m.end()
    while (s := _STOP.search(text, p)) and s[0] != ">":
        p = text.find(s[0], s.end()) + 1 or s.end()
    return m.start(), s.end() if s else len(text), m[2].lower(), bool(m[1]), text[m.end() : s.start() if s else len(text)]


def _next_block(text: str, at: int) -> int:
    """Where the next tag of a block element starts, outside of raw text: the end of an element that has no end tag."""
    while found := _token(text, at):
        start, at, tag, closes, raw = found
        if tag in BLOCK:
            return start
        if tag in RAW_TEXT and not closes and not raw.endswith("/"):
            end = _end_of(tag).search(text, at)
            if end is None:
                return len(text)
            at = end.start()
    return len(text)


def parse(text: str) -> Page:
    """The tree of block elements and the text blocks of a page."""
    page = Page()
    stack: list[int] = []
    places: dict[str, list[int]] = {}  # of each open element, where it stands in the stack
    run: list[str] = []
    state = [0, 0]  # inside links, characters in links of this run

    def node(tag: str, raw: str) -> None:
        names, label = _attributes(raw) if raw and not raw.isspace() else ((), None)
        page.tag.append(tag), page.parent.append(stack[-1] if stack else -1), page.names.append(names)
        page.label.append(label), page.chars.append(0), page.linked.append(0)
        places.setdefault(tag, []).append(len(stack))
        stack.append(len(page.tag) - 1)

    def flush() -> None:
        if run:
            words = " ".join(html.unescape("".join(run)).split())
            run.clear()
            if words:
                if not stack:
                    node("body", "")
                page.blocks.append((stack[-1], words))
                page.chars[stack[-1]] += len(words)
                page.linked[stack[-1]] += min(state[1], len(words))
        state[1] = 0

    def top(tags: set[str]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    def cut(k: int) -> None:
        flush()
        while len(stack) > k:
            places[page.tag[stack.pop()]].pop()

    def close(tags: set[str], stop: set[str]) -> None:
        while (k := top(tags)) > top(stop):
            cut(k)

    at, n = 0, len(text)
    endless: set[str] = set()  # no end tag of these follows
    while found := _token(text, at):
        if found[0] > at:
            run.append(text[at : found[0]])
            if state[0]:
                state[1] += found[0] - at
        _, at, tag, closes, raw = found
        if tag is None:
            continue
        if not closes:
            if tag in DROPPED:
                if tag not in ("head",) and raw.endswith("/"):
                    continue
                end = None if tag in endless else _end_of(tag).search(text, at)
                if end is None:
                    endless.add(tag)
                    if tag == "head":  # its end is left out: what can be in it is dropped element by element
                        continue
                    at = n if tag in RAW_TEXT else _next_block(text, at)
                    continue
                at = end.start() if text[end.start() + 1] != "/" else text.find(">", end.start()) + 1 or n
            elif tag in ("br", "hr") or tag in VOID:
                run.append(" ")
                if tag == "hr":
                    flush()
            elif tag in BLOCK:
                if tag in ("html", "body") and places.get(tag):
                    continue
                if tag in IN_P:
                    close({"p"}, {"button", "td", "th", "table", "caption"})
                if tag in ENDS:
                    close(*ENDS[tag])
                if tag[0] == "h" and tag[1:].isdigit() and stack and page.tag[stack[-1]][0] == "h" and page.tag[stack[-1]][1:].isdigit():
                    cut(len(stack) - 1)
                flush()
                node(tag, raw)
            elif tag == "a":
                state[0] = 1
        elif tag == "a":
            state[0] = 0
        elif tag in BLOCK and tag not in ("html", "body") and places.get(tag):
            cut(places[tag][-1])
    if at < n:
        run.append(text[at:])
    flush()
    return page


def _bucket(x: float, edges: tuple[float, ...]) -> int:
    return sum(x >= e for e in edges)


def page_features(page: Page) -> list[list[str]]:
    """Feature names of each node."""
    n = len(page.tag)
    chars, linked, own = page.chars.copy(), page.linked.copy(), page.chars
    for i in range(n - 1, 0, -1):
        if page.parent[i] >= 0:
            chars[page.parent[i]] += chars[i]
            linked[page.parent[i]] += linked[i]
    total = max(1, sum(own))
    out = []
    for i in range(n):
        p = page.parent[i]
        tag = page.tag[i]
        share = linked[i] / chars[i] if chars[i] else 0.0
        size = _bucket(chars[i], (1, 15, 40, 80, 160, 400, 1200))
        out.append(
            ["bias", f"t:{tag}", f"size:{size}", f"link:{_bucket(share, (0.01, 0.3, 0.6, 0.9))}", f"{tag}|size:{min(size, 5)}", f"share:{_bucket(chars[i] / total, (0.02, 0.1, 0.3, 0.6))}", f"up:{page.tag[p] if p >= 0 else '-'}>{tag}"]
            + [f"n:{w}" for w in page.names[i]]
        )
    return out


@dataclass
class Model:
    index: dict[str, int]
    weight: np.ndarray
    pair: np.ndarray  # [parent, child], logarithms


@dataclass
class Forest:
    """Trees of a batch: parents stand before children."""

    parent: np.ndarray
    levels: list[np.ndarray]


def _forest(parents: list[list[int]]) -> Forest:
    flat, depth, base = [], [], 0
    for own in parents:
        d: list[int] = []
        for p in own:
            d.append(0 if p < 0 else d[p] + 1)
            flat.append(-1 if p < 0 else base + p)
        depth += d
        base += len(own)
    order = np.argsort(np.array(depth, dtype=np.int64), kind="stable")
    return Forest(np.array(flat, dtype=np.int64), np.split(order, np.cumsum(np.bincount(depth))[:-1]) if depth else [])


NARROW = 4  # levels of fewer nodes are walked node by node: a chain of nodes costs no array operations


def sum_product(forest: Forest, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Node marginals [node, label] and edge marginals [node, parent's label, label] (zero for roots). unary: log potentials of label 1."""
    n = len(unary)
    local = np.stack([np.ones(n), np.exp(np.clip(unary, -30, 30))], axis=1)
    local /= local.sum(axis=1, keepdims=True)
    edge = np.exp(pair)
    (e00, e01), (e10, e11) = edge.tolist()
    belief = np.log(local)
    message = np.zeros((n, 2))  # to the parent
    parent = forest.parent.tolist()
    for level in forest.levels[:0:-1]:
        if len(level) < NARROW:
            for i in level.tolist():
                x, y = belief[i].tolist()
                x, y = (1.0, math.exp(y - x)) if x > y else (math.exp(x - y), 1.0)
                a, b = e00 * x + e01 * y, e10 * x + e11 * y
                up = math.log(a / (a + b)), math.log(b / (a + b))
                message[i] = up
                belief[parent[i]] += up
            continue
        b = np.exp(belief[level] - belief[level].max(axis=1, keepdims=True))
        up = b @ edge.T
        message[level] = np.log(up / up.sum(axis=1, keepdims=True))
        np.add.at(belief, forest.parent[level], message[level])
    both = np.zeros((n, 2, 2))
    marginal = np.zeros((n, 2))
    for k, level in enumerate(forest.levels):
        if k and len(level) < NARROW:
            for i in level.tolist():
                u, v = marginal[parent[i]].tolist()
                p, q = message[i].tolist()
                u, v = math.log(max(u, 1e-300)) - p, math.log(max(v, 1e-300)) - q  # the parent without this child
                u, v = (1.0, math.exp(v - u)) if u > v else (math.exp(u - v), 1.0)
                x, y = belief[i].tolist()
                x, y = (1.0, math.exp(y - x)) if x > y else (math.exp(x - y), 1.0)
                a, b, c, d = u * e00 * x, u * e01 * y, v * e10 * x, v * e11 * y
                total = a + b + c + d
                both[i] = ((a / total, b / total), (c / total, d / total))
                marginal[i] = ((a + c) / total, (b + d) / total)
            continue
        if k == 0:
            b = belief[level]
        else:
            p = forest.parent[level]
            rest = np.log(np.maximum(marginal[p], 1e-300)) - message[level]  # the parent without this child
            rest = np.exp(rest - rest.max(axis=1, keepdims=True))
            own = np.exp(belief[level] - belief[level].max(axis=1, keepdims=True))
            joint = rest[:, :, None] * edge[None] * own[:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            both[level] = joint
            b = np.log(np.maximum(joint.sum(axis=1), 1e-300))
        m = np.exp(b - b.max(axis=1, keepdims=True))
        marginal[level] = m / m.sum(axis=1, keepdims=True)
    return marginal, both


def fit(pages: list[Page], steps: int = 120, l2: float = 0.003) -> Model:
    """Learns from pages whose nodes are labelled; a node without a label has its parent's, a root is no content."""
    names = [page_features(p) for p in pages]
    index: dict[str, int] = {}
    gold: list[int] = []
    for p, own in zip(pages, names):
        y: list[int] = []
        for i, f in enumerate(own):
            y.append(p.label[i] if p.label[i] is not None else y[p.parent[i]] if p.parent[i] >= 0 else 0)
            for x in f:
                index.setdefault(x, len(index))
        gold += y
    node = np.concatenate([np.full(len(f), i) for i, f in enumerate(f for own in names for f in own)])
    feat = np.array([index[x] for own in names for f in own for x in f])
    y = np.array(gold)
    forest = _forest([p.parent for p in pages])
    child = np.flatnonzero(forest.parent >= 0)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[forest.parent[child]], y[child]), 1)
    theta = np.zeros(len(index) + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        unary = np.bincount(node, weights=theta[feat], minlength=len(y))
        marginal, both = sum_product(forest, unary, theta[-4:].reshape(2, 2))
        grad = np.zeros_like(theta)
        grad[: len(index)] = np.bincount(feat, weights=(y - marginal[:, 1])[node], minlength=len(index))
        grad[-4:] = (seen - both.sum(axis=0)).ravel()
        grad = grad / len(y) ** 0.5 - l2 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(index, theta[:-4].copy(), theta[-4:].reshape(2, 2).copy())


def content_marginals(pages: list[Page], model: Model) -> list[np.ndarray]:
    get = model.index.get
    unary, size = [], []
    for p in pages:
        own = page_features(p)
        size.append(len(own))
        unary += [sum(model.weight[k] for x in f if (k := get(x)) is not None) for f in own]
    if not unary:
        return [np.zeros(0) for _ in pages]
    marginal, _ = sum_product(_forest([p.parent for p in pages]), np.array(unary), model.pair)
    return np.split(marginal[:, 1], np.cumsum(size)[:-1])


def extract(texts: list[str | None], model: Model) -> list[str]:
    pages = [parse(t or "") for t in texts]
    return ["\n\n".join(b for k, b in p.blocks if m[k] >= 0.5) for p, m in zip(pages, content_marginals(pages, model))]


_BOILER = {
    "nav": ("nav menu navbar navigation topnav breadcrumb breadcrumbs toc pagination links", ("nav", "div", "ul", "menu")),
    "header": ("header masthead banner top topbar logo branding site-header", ("header", "div")),
    "footer": ("footer bottom copyright site-footer colophon legal", ("footer", "div")),
    "aside": ("sidebar side aside widget related popular recommended tags trending", ("aside", "div", "section")),
    "notice": ("notice cookie cookies consent gdpr alert popup modal overlay subscribe newsletter message", ("div", "section", "dialog", "aside")),
    "ad": ("ad ads advert advertisement sponsor sponsored promo banner-ad adbox", ("div", "aside", "section")),
    "comments": ("comments comment discussion replies respond reader-comments disqus responses", ("section", "div", "ol")),
    "share": ("share social sharing follow tools", ("div", "ul")),
    "form": ("search login signup contact form subscribe", ("form",)),
}
_CONTENT = "content article post entry main story body text post-content entry-content article-body main-content prose page"


def labelled_pages(n: int = 260, seed: int = 5) -> list[str]:
    """Pages with ``data-gold`` on the elements where the label changes: the training set."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    chance = lambda p: rng.random() < p
    words = ["".join(pick(["ta", "re", "on", "il", "be", "su", "mo", "de", "ka", "nu", "en"]) for _ in range(int(rng.integers(1, 4)))) for _ in range(400)]

    def prose(low: int, high: int) -> str:
        out = " ".join(pick(words) for _ in range(int(rng.integers(low, high))))
        return out.capitalize() + "."

    def link() -> str:
        return f'<a href="/{pick(words)}">{prose(1, 4)[:-1]}</a>'

    def boiler(kind: str) -> str:
        names, tags = _BOILER[kind]
        tag = pick(tags)
        mark = f' {pick(("class", "id"))}="{pick(names.split())}{pick(("", "", "-" + pick(words), " box", "1"))}"' if tag in ("div", "section", "ul", "ol", "dialog") or chance(0.4) else ""
        if kind == "nav" or kind in ("header", "footer", "share") and chance(0.3):
            items = "".join(f"<li>{link()}</li>" for _ in range(int(rng.integers(2, 9))))
            inner = items if tag in ("ul", "menu") else f"<ul>{items}</ul>" if chance(0.7) else " | ".join(link() for _ in range(5))
        elif kind == "comments":
            inner = "".join(f'<{(c := pick(("div", "li", "article", "p")))}{pick(("", " class=comment"))}>{pick(("", "<b>" + pick(words) + "</b> "))}{prose(4, 60)}</{c}>' for _ in range(int(rng.integers(1, 5))))
            inner = (f"<h3>{prose(1, 3)}</h3>" if chance(0.6) else "") + inner
        elif kind == "form":
            inner = f'<label>{prose(1, 4)}</label><input name="q"><button>{pick(words)}</button>' + (f"<select><option>{pick(words)}<option>{pick(words)}</select>" if chance(0.3) else "") + (f"<p>{prose(3, 25)}</p>" if chance(0.4) else "")
        elif kind == "aside":
            inner = f"<h3>{prose(1, 4)}</h3>" * chance(0.6) + ("<ul>" + "".join(f"<li>{link()}</li>" for _ in range(4)) + "</ul>" if chance(0.6) else f"<p>{prose(5, 60)}</p>")
        else:
            inner = pick((prose(3, 15), prose(5, 50), f"<p>{prose(3, 50)}</p>", f"<span>&copy; {pick(words)}</span> &middot; {prose(2, 9)}", f"<p>{prose(3, 20)} {link()}</p>", f"<h1>{prose(1, 4)}</h1>" if kind == "header" else prose(4, 30)))
        return f'<{tag}{mark} data-gold="0">{inner}</{tag}>'

    def paragraph() -> str:
        kind = rng.random()
        text = prose(3, 25) if chance(0.25) else prose(15, 120)
        if chance(0.12):
            text = prose(1, 3)
        if chance(0.3):
            text = f"{text} {link()} {prose(3, 30)}"
        if kind < 0.72:
            return f"<p>{text}</p>" if chance(0.85) else f"<p><b>{text}<br>"
        if kind < 0.82:
            h = pick(("h1", "h2", "h3", "h4"))
            return f"<{h}>{prose(1, 8)}</{h}><p>{text}</p>"
        if kind < 0.87:
            return "<ul>" + "".join(f"<li>{prose(2, 30)}</li>" for _ in range(int(rng.integers(2, 6)))) + "</ul>"
        if kind < 0.9:
            return f"<blockquote><p>{text}</p></blockquote>"
        if kind < 0.92:
            return f"<pre>{text}\n  {prose(3, 10)}</pre>"
        if kind < 0.95:
            return "<table>" + "".join(f"<tr><td>{prose(1, 6)}<td>{prose(1, 8)}" for _ in range(3)) + "</table>"
        if kind < 0.97:
            return f"<figure><img src=x><figcaption>{prose(3, 20)}</figcaption></figure>"
        return f"<div>{text}</div>"

    out = []
    for _ in range(n):
        before = [boiler(k) for k in ("header", "nav", "notice", "ad", "form", "share") if chance(0.5 if k in ("header", "nav") else 0.3)]
        after = [boiler(k) for k in ("aside", "ad", "comments", "share", "notice", "footer", "form") if chance(0.75 if k == "footer" else 0.35)]
        rng.shuffle(before)
        body = [paragraph() for _ in range(int(rng.integers(1, 14)))]
        for k in ("ad", "share", "aside", "notice", "form", "nav", "comments"):
            if chance(0.1):
                body.insert(int(rng.integers(1, len(body) + 1)), boiler(k))
        head = pick(("", f"<h1>{prose(2, 9)}</h1>", f"<h1>{prose(2, 9)}</h1><p><b>{prose(2, 9)}<br>"))
        tag = pick(("article", "article", "main", "div", "section", "td"))
        mark = f' {pick(("class", "id"))}="{pick(_CONTENT.split())}"' if tag in ("div", "section", "td") or chance(0.3) else ""
        main = f'<{tag}{mark} data-gold="1">{head}{"".join(body)}</{tag}>'
        if tag == "td":
            main = f"<table><tr>{boiler('aside').join(('<td data-gold=0>', '</td>')) if chance(0.5) else ''}{main}</tr></table>"
        elif tag == "article" and chance(0.3):
            main = f"<main>{main}</main>"
        if chance(0.35):
            main = f'<div class="{pick(("wrapper", "container", "page", "layout", "row", "site"))}">{main}{"".join(after[:1])}</div>'
            after = after[1:]
        out.append(f"<!DOCTYPE html><html><head><title>{prose(2, 6)}</title><script>var x='<p>';</script></head><body>{''.join(before)}{main}{''.join(after)}</body></html>")
    return out


@lru_cache(1)
def trained() -> Model:
    """The model of the labelled pages; the same each time."""
    return fit([parse(t) for t in labelled_pages()])


def main_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars."""
    ship(pages.sparkSession)
    model = model or trained()
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                part = batch.slice(low, 200)
                texts = extract(part.column("html").to_pylist(), model)
                yield pa.record_batch([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
