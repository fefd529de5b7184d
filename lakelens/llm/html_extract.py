"""Operator 12, extraction of a page's main text by a graphical model over its tree.

A page becomes a tree of its elements: those that start a block, and inline ones that carry a class, id or role. Each node
is content or not. Potentials of a node come from its tag, the words of its class, id and role, and how much of its text is
linked; potentials of an edge come from the tags of parent and child. Sum-product messages go up from the leaves and down
from the root and give each node's marginal probability; the text of nodes of 0.5 or more is the page's. The weights
maximise the likelihood of labelled pages: the gradient is what their labels show less what the marginals expect.

Labelled pages are pages whose elements carry data-main="1" (content from here down) or "0". `labelled_pages` makes some
from a grammar of layouts, whose words are meaningless, so that nothing depends on a language; `fit` takes any, up to
`most` of them. Pages are independent: a task holds one page's tree at a time, in arrays, without recursion.

A block's text has its character references decoded and each run of white space as one space, and is trimmed; blocks stand
in page order, separated by a space. Scripts, styles, titles, controls of forms and embedded media have no text. Tags may
be unclosed, misnested or cut off at the end, as HTML parsers allow.

Defined results: null html is empty and gives an empty text, like a page without content; a null url or page_id comes back
as null; repeated rows give equal results; html of any length or depth is read whole; text without any tag is content; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import html as references
import math
import random
import re
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trimmed

_words = lambda s: frozenset(s.split())
#: Fixed values of HTML: elements that start blocks, have no end tag, hold raw text, or hold nothing to read.
BLOCKS = _words(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr legend li main menu nav ol optgroup option p pre section summary table caption tbody td tfoot th thead tr ul frameset noframes"
)
VOID = _words("area base br col embed hr img input keygen link meta param source track wbr")
RAW = _words("script style textarea title iframe noembed noframes xmp")
SILENT = _words("button select option optgroup datalist svg object canvas audio video template noscript applet map")
#: An end or an implied end doesn't reach beyond these.
SCOPE = _words("table td th caption")
#: What a start tag ends: itself and its like, unless one of the others stands between.
IMPLIED = {
    "li": (_words("li"), _words("ul ol menu dir")),
    "dt": (_words("dt dd"), _words("dl")),
    "dd": (_words("dt dd"), _words("dl")),
    "tr": (_words("tr"), _words("table")),
    "td": (_words("td th"), _words("table tr")),
    "th": (_words("td th"), _words("table tr")),
    "tbody": (_words("thead tbody tfoot"), _words("table")),
    "tfoot": (_words("thead tbody tfoot"), _words("table")),
    "thead": (_words("thead tbody tfoot"), _words("table")),
    "option": (_words("option"), _words("select datalist")),
    "a": (_words("a"), BLOCKS),
}
TABLE = _words("table tbody thead tfoot tr td th caption")

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]|=\s*"[^"]*"|=\s*'[^']*'|=|["'])*+)>""")
_ATTR = re.compile(r"""\b(class|id|role|data-main)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")
WEIGHTS = 1 << 15


@functools.lru_cache(1 << 16)
def _id(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % WEIGHTS


@functools.lru_cache(1 << 14)
def _named(value: str) -> tuple[int, ...]:
    """Features of a class, id or role."""
    words = {w.lower() for w in _PART.findall(value)}
    return tuple(_id(x) for w in sorted(words) for x in (f"word {w}", f"stem {w[:5]}", *([f"short {w[:3]}"] if len(w) > 3 else [])))


@dataclass
class Page:
    """Nodes in page order, the root first: parent, tag, features, label; and blocks of pieces (node, text)."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: ["#root"])
    named: list[tuple[int, ...]] = field(default_factory=lambda: [()])
    label: list[int] = field(default_factory=lambda: [1])  # text without any tag is content
    blocks: list[list[tuple[int, str]]] = field(default_factory=list)
    features: list[list[int]] = field(default_factory=list)


class _Builder:
    def __init__(self) -> None:
        self.page, self.block = Page(), []
        self.open: list[tuple[str, int]] = [("#root", 0)]
        self.count: dict[str, int] = {}
        self.silent = self.links = 0
        self.words, self.linked = [0], [0]
        self.ends: list[str] = [""]

    def end_block(self) -> None:
        if self.block:
            self.page.blocks.append(self.block)
            self.block = []

    def pop(self) -> None:
        tag, _ = self.open.pop()
        self.count[tag] -= 1
        self.silent -= tag in SILENT
        self.links -= tag == "a"
        if tag in BLOCKS:
            self.end_block()

    def close(self, tags: frozenset[str], limit: frozenset[str]) -> None:
        """Ends the innermost of the tags, and all within it, if none of the limits stands before it."""
        if not any(self.count.get(t) for t in tags):
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] in tags:
                while len(self.open) > i:
                    self.pop()
                return
            if self.open[i][0] in limit:
                return

    def start(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self.close(_P, SCOPE)
            self.end_block()
        if tag in _HEADINGS and self.open[-1][0] in _HEADINGS:
            self.pop()
        if tag in IMPLIED:
            self.close(*IMPLIED[tag])
        if tag in VOID:
            if tag == "br":
                self.text(" ")
            return
        node, named, label = self.open[-1][1], "", None
        if "=" in attributes:
            for m in _ATTR.finditer(attributes):
                value = m[2] or m[3] or m[4] or ""
                if m[1].lower() == "data-main":
                    label = int(value == "1")
                else:
                    named += " " + value
        if tag in BLOCKS or named or label is not None:
            p = self.page
            p.parent.append(node)
            p.tag.append(tag)
            p.named.append(_named(named))
            p.label.append((p.label[node] if node else 0) if label is None else label)
            self.words.append(0)
            self.linked.append(0)
            self.ends.append("")
            node = len(p.parent) - 1
        self.open.append((tag, node))
        self.count[tag] = self.count.get(tag, 0) + 1
        self.silent += tag in SILENT
        self.links += tag == "a"

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start(tag, "")
        elif tag in _HEADINGS:
            self.close(_HEADINGS, SCOPE)
        elif tag in TABLE:
            self.close(frozenset((tag,)), frozenset(("table",)))
        elif tag not in ("html", "body"):
            self.close(frozenset((tag,)), SCOPE if tag in BLOCKS else BLOCKS)

    def text(self, text: str) -> None:
        if self.silent or not text:
            return
        node = self.open[-1][1]
        self.block.append((node, text))
        n = len(text.split())
        if n:
            self.words[node] += n
            self.linked[node] += n if self.links else 0
            self.ends[node] = text.rstrip()[-1:]


_P = frozenset(("p",))
_HEADINGS = _words("h1 h2 h3 h4 h5 h6")


def parse(html: str) -> Page:
    b, at, n = _Builder(), 0, len(html)
    while at < n:
        i = html.find("<", at)
        if i < 0:
            i = n
        if i > at:
            b.text(references.unescape(html[at:i]))
        if i == n:
            break
        at = i
        m = _TAG.match(html, i)
        if m:
            at, tag = m.end(), m[2].lower()
            if m[1]:
                b.end(tag)
                continue
            b.start(tag, m[3])
            if tag in RAW:
                while len(b.open) > 1 and b.open[-1][0] == tag:
                    b.pop()
                close = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(html, at)
                at = close.start() if close else n
        elif html.startswith("<!--", i):
            end = html.find("-->", i + 4 if not html.startswith("<!-->", i) and not html.startswith("<!--->", i) else i + 2)
            at = end + 3 if end >= 0 else n
        elif html[i + 1 : i + 2] in ("!", "?") or (html.startswith("</", i) and not html[i + 2 : i + 3].isalpha() and i + 2 < n):
            end = html.find(">", i)
            at = end + 1 if end >= 0 else n
        elif html[i + 1 : i + 2].isascii() and html[i + 1 : i + 2].isalpha() or html.startswith("</", i):
            at = n  # a tag that the end of the page cuts off
        else:
            b.text("<")
            at = i + 1
    b.end_block()
    _describe(b)
    return b.page


def _bucket(n: float) -> int:
    return n.bit_length() if isinstance(n, int) else int(n * 4.999)


def _describe(b: _Builder) -> None:
    """Each node's features, from itself and what lies below it."""
    p = b.page
    words, linked, children = list(b.words), list(b.linked), [0] * len(p.parent)
    for i in range(len(p.parent) - 1, 0, -1):
        words[p.parent[i]] += words[i]
        linked[p.parent[i]] += linked[i]
        children[p.parent[i]] += 1
    for i, tag in enumerate(p.tag):
        up = p.tag[p.parent[i]] if i else ""
        own, share = min(_bucket(b.words[i]), 7), _bucket(b.linked[i] / b.words[i]) if b.words[i] else 9
        below = _bucket(linked[i] / words[i]) if words[i] else 9
        stop = "stop" if b.ends[i] in ".!?…:;\"”»" and b.ends[i] else "none"
        p.features.append([_id("one"), _id(f"tag {tag}"), _id(f"under {up} {tag}"), _id(f"own {own}"), _id(f"own {tag} {min(own, 4)} {share}"), _id(f"below {below} {min(_bucket(words[i]), 9)}"), _id(f"end {stop} {min(own, 3)}"), *p.named[i]])


@functools.lru_cache(1 << 12)
def _edge(up: str, tag: str) -> tuple[int, int, int]:
    return _id("edge"), _id(f"edge {tag}"), _id(f"edge {up} {tag}")


def _plus(a: float, b: float) -> float:
    """The log of a sum of two logs."""
    if a < b:
        a, b = b, a
    return a + math.log1p(math.exp(b - a)) if b - a > -40 else a


@dataclass
class Model:
    """unary: a weight of each feature for content; edge: weights of each edge feature for (parent, child) states 00 01 10 11."""

    unary: list[float]
    edge: dict[int, list[float]]

    def potentials(self, page: Page) -> tuple[list[float], list[tuple[float, ...]]]:
        known, nothing = {}, [0.0] * 4
        own = [sum([self.unary[f] for f in fs]) for fs in page.features]
        pair = [(0.0,) * 4]
        for i in range(1, len(own)):
            at = page.tag[page.parent[i]], page.tag[i]
            if at not in known:
                known[at] = tuple(map(sum, zip(*[self.edge.get(f, nothing) for f in _edge(*at)], strict=True)))
            pair.append(known[at])
        return own, pair

    def beliefs(self, page: Page) -> tuple[list[float], list[tuple[float, ...]]]:
        """Each node's probability of being content, and the probabilities of each edge's four states."""
        own, pair = self.potentials(page)
        n = len(own)
        zero, one = [0.0] * n, own[:]  # logs of what a node and all below it say about it
        to0, to1 = [0.0] * n, [0.0] * n  # messages up
        for i in range(n - 1, 0, -1):
            a, b, c, d = pair[i]
            to0[i], to1[i] = _plus(zero[i] + a, one[i] + b), _plus(zero[i] + c, one[i] + d)
            zero[page.parent[i]] += to0[i]
            one[page.parent[i]] += to1[i]
        both, edges = list(zip(zero, one, strict=True)), [(0.0,) * 4] * n
        for i in range(1, n):
            p0, p1 = both[page.parent[i]]
            p0, p1 = p0 - to0[i], p1 - to1[i]  # what the parent knows from elsewhere
            a, b, c, d = pair[i]
            both[i] = zero[i] + _plus(p0 + a, p1 + c), one[i] + _plus(p0 + b, p1 + d)
            logs = p0 + zero[i] + a, p0 + one[i] + b, p1 + zero[i] + c, p1 + one[i] + d
            edges[i] = logs
        odds = [max(-700.0, min(700.0, y - x)) for x, y in both]
        return [1 / (1 + math.exp(-o)) for o in odds], edges

    def text(self, page: Page) -> str:
        chance, _ = self.beliefs(page)
        texts = (_SPACE.sub(" ", "".join(t for node, t in block if chance[node] >= 0.5)).strip() for block in page.blocks)
        return " ".join(t for t in texts if t)


def fit(pages: list[str], most: int = 2000, rounds: int = 6, rate: float = 0.4, decay: float = 1e-4, seed: int = 1) -> Model:
    """Weights that maximise the likelihood of labelled pages, by AdaGrad over single pages; at most `most` pages are used."""
    parsed = [parse(h) for h in pages[:most]]
    model, rng = Model([0.0] * WEIGHTS, {}), random.Random(seed)
    squares, edge_squares = [1e-6] * WEIGHTS, {}
    for _ in range(rounds):
        rng.shuffle(parsed)
        for page in parsed:
            chance, edges = model.beliefs(page)
            slope: dict[int, float] = {}
            for fs, y, q in zip(page.features, page.label, chance, strict=True):
                if abs(y - q) > 1e-4:
                    for f in fs:
                        slope[f] = slope.get(f, 0.0) + y - q
            for f, g in slope.items():
                g -= decay * model.unary[f]
                squares[f] += g * g
                model.unary[f] += rate * g / math.sqrt(squares[f])
            pairs: dict[int, list[float]] = {}
            for i in range(1, len(page.parent)):
                top = max(edges[i])
                shares = [math.exp(x - top) for x in edges[i]]
                total, seen = sum(shares), 2 * page.label[page.parent[i]] + page.label[i]
                if shares[seen] / total < 1 - 1e-4:
                    for f in _edge(page.tag[page.parent[i]], page.tag[i]):
                        g = pairs.setdefault(f, [0.0] * 4)
                        for s in range(4):
                            g[s] += (s == seen) - shares[s] / total
            for f, gs in pairs.items():
                w, q = model.edge.setdefault(f, [0.0] * 4), edge_squares.setdefault(f, [1e-6] * 4)
                for s, g in enumerate(gs):
                    g -= decay * w[s]
                    q[s] += g * g
                    w[s] += rate * g / math.sqrt(q[s])
    return model


# ---- labelled pages

_NAMES = {
    "nav": "nav menu navbar navigation topnav main-menu breadcrumb breadcrumbs pagination tabs nav-links pager toc-links site-nav mobile-menu",
    "header": "header masthead site-header top-bar page-header logo branding topbar hero-banner head",
    "footer": "footer site-footer copyright legal bottom footer-links colophon page-footer foot imprint",
    "aside": "sidebar side aside right-rail related related-posts widget recommended popular trending tags tag-cloud more-stories left-col side-bar read-more author-bio archive-list",
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion banner-ad adsense ad-slot adbox ad-container commercial dfp-unit teaser-ad ad-banner",
    "notice": "cookie cookies cookie-banner consent gdpr notice alert popup modal overlay banner paywall disclaimer privacy-notice message-bar warning toast announcement cookie-notice newsletter subscribe",
    "comments": "comments comment comment-list respond discussion disqus replies reply reader-comments user-comments commentlist responses feedback comment-body comments-area thread",
    "share": "share social sharing share-buttons social-links follow-us like-buttons byline-tools print-tools",
    "form": "form search search-form login signup contact-form newsletter-form subscribe-form register searchbox",
}
_MAIN = "content article post entry story main body-text text article-body post-content entry-content story-body page-content main-content articleText blog-post prose"
_TAGS = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "ad": "aside", "notice": "div", "comments": "section", "share": "div", "form": "form"}


class _Grammar:
    """A seeded writer of labelled pages; its words are random letters, its layouts vary in tags, names and mistakes."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def some(self, low: int, high: int, end: str = ".") -> str:
        r = self.r
        words = ["".join(r.choices("abcdefghilmnoprstuvé", k=r.randint(2, 9))) for _ in range(r.randint(low, high))]
        return (" ".join(words).capitalize() + end).replace(" x", ", x")

    def link(self, low: int = 1, high: int = 3) -> str:
        return f'<a href="/{self.r.randint(1, 999)}">{self.some(low, high, "")}</a>'

    def named(self, names: str) -> str:
        r = self.r
        kind = r.choice(("class", "class", "id"))
        held = r.choice(names.split())
        if r.random() < 0.3:
            held = f"{held} {r.choice(('x1', 'col', 'box', 'wrap', 'row', 'block', 'js'))}"
        return f' {kind}="{held}"'

    def links(self) -> str:
        r, n = self.r, self.r.randint(2, 8)
        if r.random() < 0.6:
            return f"<ul>{''.join(f'<li>{self.link()}</li>' for _ in range(n))}</ul>"
        return r.choice((" ", " | ", "")).join(self.link() for _ in range(n))

    def other(self, kind: str, plain: bool) -> str:
        """A part that isn't content."""
        r = self.r
        tag = _TAGS[kind] if kind == "form" or r.random() < 0.5 else r.choice(("div", "div", "section"))
        inside = []
        if kind in ("nav", "share") or (kind in ("aside", "footer", "header") and r.random() < 0.5):
            inside.append(self.links())
        if kind == "form":
            inside.append(f"<label>{self.some(1, 3, ':')}</label><input name=q>" + r.choice(("<button>Go</button>", f"<p>{self.some(3, 9)}</p>", "")))
        if kind == "comments":
            tag2, name = r.choice(("div", "li", "article")), r.choice(("comment", "reply", "comment-body", "response"))
            each = lambda: f'<{tag2}{f" class={name}" if r.random() < 0.7 else ""}><b>{self.some(1, 2, "")}</b>{r.choice(("<p>", "<div>", ""))}{self.some(2, 40)}</{tag2}>'
            inside.append(f"<h3>{self.some(1, 3, '')}</h3>" * (r.random() < 0.5) + "".join(each() for _ in range(r.randint(1, 4))))
        if not inside or r.random() < 0.5:
            text = self.some(2, 25)
            if kind == "footer":
                text = f"&copy; {self.some(1, 2, '')} &middot; {text}"
            inside.append(r.choice((text, text, f"<p>{text}</p>", f"<span>{text}</span>", f"<h4>{self.some(1, 3, '')}</h4><p>{text}</p>")))
        r.shuffle(inside)
        bare = tag in ("nav", "header", "footer", "aside", "form") and (plain or r.random() < 0.5)
        return f'<{tag} data-main="0"{"" if bare else self.named(_NAMES[kind])}>{"".join(inside)}</{tag}>'

    def piece(self) -> str:
        """A part of the content."""
        r = self.r
        text = lambda: self.some(*r.choice(((1, 3), (3, 15), (15, 60), (30, 120))))
        kind = r.random()
        if kind < 0.55:
            body = text()
            if r.random() < 0.2:
                body = f"{body} {r.choice((self.link(), f'<span class=hl>{self.some(1, 2, chr(0))}</span>'.replace(chr(0), ''), '<em>so</em>'))} {text()}"
            return f"<p>{r.choice(('', '', '<b>'))}{body}{r.choice(('</p>', '</p>', '<br>', ''))}"
        if kind < 0.63:
            n = r.choice("1223")
            return f"<h{n}>{self.some(1, 10, '')}</h{n}>"
        if kind < 0.71:
            tag = r.choice(("ul", "ol"))
            return f"<{tag}>{''.join(f'<li>{text() if r.random() < 0.8 else self.link(1, 6)}' for _ in range(r.randint(1, 5)))}</{tag}>"
        if kind < 0.76:
            return f"<blockquote>{r.choice(('<p>', ''))}{text()}</blockquote>"
        if kind < 0.81:
            return "<table>" + "".join(f"<tr>{''.join(f'<td>{self.some(1, 4, chr(46))}</td>' for _ in range(3))}</tr>" for _ in range(r.randint(1, 4))) + "</table>"
        if kind < 0.85:
            return f"<pre>{self.some(3, 20)}</pre>"
        if kind < 0.89:
            return f"<figure><img src=a.png><figcaption>{text()}</figcaption></figure>"
        if kind < 0.95:
            return f"<div>{text()}</div>"
        return f"{text()}<br>{text()}"

    def content(self, plain: bool) -> str:
        r = self.r
        parts = [self.piece() for _ in range(r.randint(1, 12))]
        if r.random() < 0.7:
            title = f"<h1>{self.some(2, 12, '')}</h1>"
            parts.insert(0, f"<header>{title}</header>" if r.random() < 0.15 else title)
        for kind, chance in (("ad", 0.2), ("share", 0.12), ("aside", 0.12), ("comments", 0.1), ("form", 0.08), ("notice", 0.08), ("nav", 0.08)):
            if r.random() < chance:
                parts.insert(r.randint(1, len(parts)), self.other(kind, plain))
        if r.random() < 0.1:
            parts = [f"<section>{''.join(parts)}</section>"]
        body = "".join(parts)
        way = r.random()
        if way < 0.45:
            close = "</article>" if r.random() < 0.85 else ""
            return f'<article data-main="1"{self.named(_MAIN) if r.random() < 0.4 else ""}>{body}{close}'
        if way < 0.6:
            return f'<main data-main="1">{body}</main>'
        if way < 0.9 and not plain:
            return f'<div data-main="1"{self.named(_MAIN)}>{body}</div>'
        return f'<div data-main="1">{body}</div>'

    def page(self) -> str:
        r, plain = self.r, self.r.random() < 0.15
        before = [self.other(k, plain) for k in ("header", "nav", "notice", "ad", "form", "share", "aside") if r.random() < 0.4]
        after = [self.other(k, plain) for k in ("comments", "aside", "ad", "nav", "share", "form", "notice") if r.random() < 0.3]
        r.shuffle(before)
        r.shuffle(after)
        if r.random() < 0.8:
            after.append(self.other("footer", plain))
        if r.random() < 0.08:  # no layout at all
            before, after = [], []
            middle = self.piece() + "".join(self.piece() for _ in range(r.randint(0, 5)))
            return r.choice((f'<html><body data-main="1">{middle}</body></html>', f'<div data-main="1">{middle}</div>', f'<p data-main="1">{self.some(1, 60)}'))
        body = "".join(before) + self.content(plain) + "".join(after)
        for _ in range(r.randint(0, 2)):
            body = f"<div{self.named('wrap wrapper container page site layout row inner outer app root') if r.random() < 0.7 else ''}>{body}</div>"
        cut = r.choice(("</body></html>", "</body></html>", ""))
        return f"<!DOCTYPE html><html><head><title>{self.some(2, 6, '')}</title><style>p{{}}</style></head><body>{body}{cut}"


def labelled_pages(n: int = 500, seed: int = 11) -> list[str]:
    g = _Grammar(seed)
    return [g.page() for _ in range(n)]


@functools.lru_cache(1)
def default_model() -> Model:
    return fit(labelled_pages())


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars of pages (page_id, url, html)."""
    held = model or default_model()
    kinds = dict(pages.dtypes)

    def go(batches):
        for b in batches:
            texts = [held.text(parse(h)) if h else "" for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    found = pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInArrow(trimmed(go), f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
    return found.withColumn("n_chars", F.length("text").cast("bigint"))
