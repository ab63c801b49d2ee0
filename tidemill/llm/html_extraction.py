"""Main text of web pages by gradient-boosted trees over DOM nodes and hierarchical decoding."""

from __future__ import annotations

import html
import random
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, unused

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe xmp noframes".split())
NEVER_TEXT = frozenset("head script style title textarea noscript template iframe svg select noframes canvas audio video".split())
BLOCKS = frozenset(
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre "
    "figure figcaption nav header footer aside form fieldset address details summary center hgroup menu dialog legend hr".split()
)
CLOSES_P = BLOCKS - {"html", "body", "td", "th", "tr", "thead", "tbody", "tfoot", "caption", "li", "dt", "dd", "legend", "summary"} | {"li", "dt", "dd"}
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
SCOPE = frozenset("html body article main section div ul ol dl table td th blockquote nav header footer aside form figure".split())

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|</?[a-zA-Z][^>]*+(?:>|\Z)|<[!?][^>]*+(?:>|\Z)|</[^a-zA-Z][^>]*+(?:>|\Z)""",
    re.S,
)
NAMES = re.compile(r"""\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORDS = re.compile(r"[a-z]+")
SPACE = re.compile(r"[\x20\x09-\x0D]+")

#: Attribute tokens that authors give to parts of a page.
BOILER_TOKENS = frozenset(
    "ad ads advert advertisement adverts adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "header masthead topbar branding footer bottom copyright legal sidebar rail aside widget widgets cookie cookies consent gdpr notice alert "
    "popup modal overlay subscribe subscription newsletter signup login register search form share sharing social comment comments commentlist "
    "reply replies respond disqus discussion related recommended recommendations more trending popular tags pagination pager toolbar skip outbrain taboola".split()
)
CONTENT_TOKENS = frozenset("article content contents post entry story main body text articlebody maincontent blog hentry prose page".split())

#: Elements that run within a line: parts of the sentence that they stand in, whatever their class.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: Attribute tokens of adverts, which may be put into a line.
ADVERTS = frozenset("ad ads advert advertisement adverts adsense sponsor sponsored promo promotion outbrain taboola".split())
HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|\bdisplay\s*:\s*none|\bvisibility\s*:\s*hidden""", re.I)

GROUPS = [
    {"article", "main"}, {"section"}, {"div", "center"}, {"p"}, {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}, {"ul", "ol", "dl", "menu"}, {"li", "dt", "dd"},
    {"table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"blockquote", "pre", "figure", "figcaption"}, {"nav"}, {"header"}, {"footer"}, {"aside"},
    {"form", "fieldset", "button", "label", "input", "dialog"}, {"html", "body"},
]
GROUP_OF = {name: i for i, names in enumerate(GROUPS) for name in names}


@dataclass
class Page:
    """A page's nodes in page order, and its pieces of text as (node, opens a block, text)."""

    tags: list = field(default_factory=list)
    parents: list = field(default_factory=list)
    tokens: list = field(default_factory=list)
    pieces: list = field(default_factory=list)
    links: list = field(default_factory=list)  # whether a piece is inside a link
    silent: list = field(default_factory=list)  # nodes whose content is no text


def parse(source: str) -> Page:
    """The nodes that are judged one by one: block elements, and others that carry a class, id or role, but for those that run within a line.

    Of the latter only adverts and hidden ones are nodes: else a sentence would lose the words that happen to have a class. What is hidden is no text.
    Elements that were never closed end where the standard says that the next one closes them, or with
    their parent; end tags without a start are ignored; a tag cut off by the end of the page is dropped.
    """
    page = Page()
    stack: list[tuple[str, int]] = []  # element name, node
    node, new_block, in_link, at, n = -1, True, 0, 0, len(source)

    def pop_to(k: int):
        nonlocal node, new_block, in_link
        for name, _ in stack[k:]:
            new_block |= name in BLOCKS
            in_link -= name == "a"
        node = stack[k - 1][1] if k else -1
        del stack[k:]

    def text(part: str):
        nonlocal new_block
        if part and not (new_block and part.isspace()):
            page.pieces.append((node, new_block, part))
            page.links.append(in_link > 0)
            new_block = False

    while at < n:
        m = TOKEN.search(source, at)
        if m is None:
            text(source[at:])
            break
        text(source[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if name == "br":  # a break inside a block is white space
            text("\n")
            continue
        if m["end"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    pop_to(k)
                    break
            continue
        new_block |= name in BLOCKS
        closes = SELF_CLOSING.get(name, set()) | ({"p"} if name in CLOSES_P else set())
        if closes:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in closes:
                    pop_to(k)
                    break
                if stack[k][0] in SCOPE:
                    break
        attrs = m["attrs"] or ""
        named = WORDS.findall(" ".join(a or b or c for a, b, c in NAMES.findall(attrs)).lower()) if "=" in attrs else []
        unseen = name in NEVER_TEXT or bool(attrs) and HIDDEN.search(attrs) is not None
        if name in BLOCKS or unseen or named and (name not in INLINE or not ADVERTS.isdisjoint(named)) or name in ("button", "label"):
            page.tags.append(name)
            page.parents.append(node)
            page.tokens.append(named)
            page.silent.append(unseen)
            mine = len(page.tags) - 1
        else:
            mine = node
        if name in VOID or attrs.endswith("/") and name == "svg":
            continue
        if name in RAW:
            closing = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(source, at)
            at = closing.start() if closing else n
            if closing is None:
                break
            stack.append((name, mine))
            node = mine
            continue
        stack.append((name, mine))
        node = mine
        in_link += name == "a"
    return page


N_FEATURES = len(GROUPS) + 21


def features(page: Page) -> np.ndarray:
    """A row for each node: tag, attribute tokens, depth, density of the subtree, siblings, and what its ancestors are."""
    n = len(page.tags)
    x = np.zeros((n, N_FEATURES), dtype=np.float32)
    if not n:
        return x
    own, linked, stops = [0.0] * n, [0.0] * n, [0.0] * n
    for (node, _, part), link in zip(page.pieces, page.links, strict=True):
        if node >= 0 and not page.silent[node]:
            size = len(part.strip())
            own[node] += size
            linked[node] += size if link else 0
            stops[node] += part.count(".") + part.count(",")
    total, links, marks, nodes, paragraphs = own.copy(), linked.copy(), stops.copy(), [1.0] * n, [0.0] * n
    parents, children = page.parents, [[] for _ in range(n)]
    for i in range(n - 1, -1, -1):
        paragraphs[i] += page.tags[i] == "p"
        p = parents[i]
        if p >= 0:
            children[p].append(i)
            for a in (total, links, marks, nodes, paragraphs):
                a[p] += a[i]
    whole = max(1.0, sum(total[i] for i in range(n) if parents[i] < 0))
    base = len(GROUPS)
    place, same = [0] * n, [1] * n
    for mine in children:
        tags: dict = {}
        for i in mine:
            tags[page.tags[i]] = tags.get(page.tags[i], 0) + 1
        for k, i in enumerate(reversed(mine)):
            place[i], same[i] = k, tags[page.tags[i]]
    rows, before = [], 0.0
    for i in range(n):
        p = parents[i]
        group = GROUP_OF.get(page.tags[i])
        if group is not None:
            x[i, group] = 1
        names = page.tokens[i]
        boiler = sum(t in BOILER_TOKENS for t in names) if names else 0
        content = sum(t in CONTENT_TOKENS for t in names) if names else 0
        siblings = len(children[p]) if p >= 0 else 1
        if p >= 0:
            up = rows[p]
            above = (up[0] + 1, max(up[3], float(up[1] > 0)), max(up[4], float(up[2] > 0)), max(up[5], float(page.tags[p] in GROUPS[0])), max(up[6], float(9 <= GROUP_OF.get(page.tags[p], 0) <= 13)))
        else:
            above = (0, 0.0, 0.0, 0.0, 0.0)
        size = total[i]
        rows.append(
            (
                above[0], boiler, content, *above[1:], size, own[i], links[i] / max(1.0, size), 100 * nodes[i] / (size + 20), marks[i] / (size / 6 + 1),
                paragraphs[i], siblings, place[i] / max(1, siblings - 1), same[i] / max(1, siblings), size / whole, before / whole,
                total[p] if p >= 0 else 0, total[p] / siblings if p >= 0 else 0, len(names),
            )
        )
        before += own[i]
    x[:, base:] = rows
    for j in (7, 8, 12, 18, 19):  # sizes, on a scale of powers
        x[:, base + j] = np.log1p(x[:, base + j])
    return x


@dataclass
class Trees:
    """Complete trees of one depth: features and cuts of the inner nodes, values of the leaves."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    bias: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for f, c, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            while len(at) and at[0] < inner:
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += leaf[at - inner]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 5, rate: float = 0.2, bins: int = 24) -> Trees:
    """Gradient boosting of logistic loss: each tree is grown level by level on histograms of quantile bins, with Newton leaves."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    inner = 2**depth - 1
    bias = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    score = np.full(len(y), bias)
    feature, cut, leaf = np.zeros((trees, inner), dtype=np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        at = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = at - first
            best = np.full(width, 1e-3)
            size = width * (bins + 1)
            whole_g, whole_h = np.bincount(local, g, width), np.bincount(local, h, width)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                key = local * (bins + 1) + binned[:, j]
                left_g = np.cumsum(np.bincount(key, g, size).reshape(width, -1), axis=1)[:, : len(e)]
                left_h = np.cumsum(np.bincount(key, h, size).reshape(width, -1), axis=1)[:, : len(e)]
                right_g, right_h = whole_g[:, None] - left_g, whole_h[:, None] - left_h
                gain = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - (whole_g**2 / (whole_h + 1))[:, None]
                gain[(left_h < 1) | (right_h < 1)] = 0
                k = gain.argmax(axis=1)
                top = gain[np.arange(width), k]
                for v in np.flatnonzero(top > best):
                    best[v], feature[t, first + v], cut[t, first + v] = top[v], j, e[k[v]]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[t, at]] > cut[t, at])
        leaves = at - inner
        leaf[t] = rate * np.bincount(leaves, g, inner + 1) / (np.bincount(leaves, h, inner + 1) + 1)
        score += leaf[t][leaves]
    return Trees(feature, cut, leaf, bias)


def decode(page: Page, odds: np.ndarray) -> list[bool]:
    """Which nodes are kept: the labelling with the highest sum of log-odds in which no kept node lies in a dropped one."""
    n = len(page.tags)
    keep, drop = odds.tolist(), (-odds).tolist()
    for i in range(n - 1, -1, -1):
        p = page.parents[i]
        if page.silent[i]:
            keep[i] = -1e9
        if p >= 0:
            keep[p] += max(keep[i], drop[i])
            drop[p] += drop[i]
    kept = [False] * n
    for i in range(n):
        p = page.parents[i]
        kept[i] = (p < 0 or kept[p]) and keep[i] > drop[i]
    return kept


def main_text(page: Page, kept: list[bool]) -> str:
    """The text of kept nodes: blocks in page order, white space inside one turned into one space."""
    blocks: list[list[str]] = []
    fresh = True
    for node, opens, part in page.pieces:
        fresh |= opens
        if node >= 0 and not kept[node]:
            continue
        if fresh or not blocks:
            blocks.append([])
        fresh = False
        blocks[-1].append(part)
    texts = (SPACE.sub(" ", html.unescape("".join(b))).strip(" ") for b in blocks)
    return "\n\n".join(t for t in texts if t)


# The pages to learn from are made up here: layouts whose parts are known.


def _phrase(rnd: random.Random, low: int, high: int) -> str:
    words = ["".join(rnd.choice("etaoinshrdlucmfwypvbgkjqxz") for _ in range(rnd.randint(1, 9))) for _ in range(rnd.randint(low, high))]
    out = " ".join(words).capitalize()
    for _ in range(len(words) // 8):
        out = out.replace(" ", rnd.choice([", ", ". ", " "]), 1) if rnd.random() < 0.5 else out[::-1].replace(" ", " ,", 1)[::-1]
    return out + rnd.choice([".", ".", "", "!"])


class _Layout:
    """A random page as markup, and the labels of its nodes in page order."""

    def __init__(self, seed: int):
        self.rnd = random.Random(seed)
        self.labels: list[int] = []
        self.blind = self.rnd.random() < 0.15  # a page whose attributes say nothing

    def node(self, tag: str, label: int, inner, names=()):
        rnd = self.rnd
        self.labels.append(label)
        attrs = ""
        if names:
            name = rnd.choice(names)
            if self.blind:
                name = "".join(rnd.choice("abcdefgh") for _ in range(5))
            if rnd.random() < 0.3:
                name = rnd.choice(["{}-wrap", "site-{}", "{} clearfix", "c-{}", "{}-1"]).format(name)
            attrs = f' {rnd.choice(["class", "class", "id"])}="{name}"'
        return f"<{tag}{attrs}>" + "".join(part() if callable(part) else part for part in inner) + f"</{tag}>"

    def plain(self, tag, label, low, high, link=False):
        body = _phrase(self.rnd, low, high)
        return lambda: self.node(tag, label, [f"<a href='/x'>{body}</a>" if link else body])

    def sentence(self, low: int, high: int, links: float = 0.0) -> str:
        """A paragraph's text: some of it in links, some in elements within the line that carry all kinds of classes."""
        rnd, out = self.rnd, []
        for piece in _phrase(rnd, low, high).split(" "):
            r = rnd.random()
            if r < links:
                piece = f"<a href='/{r}'>{piece} {_phrase(rnd, 1, 4)}</a>"
            elif r < links + 0.03:
                tag, name = rnd.choice(["span", "b", "em", "sup", "code", "i"]), rnd.choice(["header", "notice", "x1", "share", "comment", "top", "menu", "term"])
                piece = f'<{tag} {rnd.choice(["class", "id"])}="{name}">{piece}</{tag}>'
            out.append(piece)
        return " ".join(out)

    def prose(self, tag: str, label: int, low: int, high: int):
        links = self.rnd.choice([0, 0, 0, 0.03, 0.08, 0.3, 0.6])
        body = self.sentence(low, high if links < 0.2 else min(high, 12), links)
        return lambda: self.node(tag, label, [body])

    def title(self):
        """An article's heading, with or without a header of its own and a line on who wrote it."""
        rnd = self.rnd
        heading = self.plain(rnd.choice(["h1", "h1", "h2"]), 1, 1, rnd.choice([1, 2, 12]))
        if rnd.random() < 0.6:
            return [heading]
        by = rnd.choice(["By ", "", "Posted by "]) + _phrase(rnd, 1, 3)
        line = lambda: self.node(rnd.choice(["p", "p", "div"]), 1, [by], rnd.choice([(), ["byline", "author", "meta", "date", "dateline", "subtitle"]]))
        if rnd.random() < 0.3:
            return [heading, line]
        inner = [heading, line][: rnd.choice([1, 2, 2])]
        return [lambda: self.node("header", 1, inner, rnd.choice([(), (), ["entry-header", "article-header", "post-title"]]))]

    def references(self):
        """A list of links that belongs to the text, under its heading."""
        rnd = self.rnd
        items = [(lambda k=k: self.node("li", 1, [f"<a href='/{k}'>{_phrase(rnd, 1, 7)}</a>" + rnd.choice(["", "", " " + _phrase(rnd, 1, 8)])])) for k in range(rnd.randint(2, 7))]
        tag = rnd.choice(["ul", "ol", "ol"])
        return [self.plain(rnd.choice(["h2", "h3"]), 1, 1, 2), lambda: self.node(tag, 1, items)]

    def aside(self):
        """A box beside the text, often without a class or a link."""
        rnd = self.rnd
        inner = [self.plain(rnd.choice(["h3", "p", "h4"]), 0, 1, 6), *[self.plain("p", 0, 2, 25, rnd.random() < 0.3) for _ in range(rnd.randint(0, 2))]]
        if rnd.random() < 0.4:
            inner = [_phrase(rnd, 2, 14)]
        return lambda: self.node("aside", 0, inner, rnd.choice([(), (), (), ["related", "more", "box", "also"]]))

    def links(self, label=0, low=3, high=9):
        return lambda: self.node("ul", label, [self.plain("li", label, 1, 3, True) for _ in range(self.rnd.randint(low, high))])

    def boiler(self, kind: str):
        rnd = self.rnd
        tag, names, inner = {
            "nav": (rnd.choice(["nav", "nav", "div"]), ["nav", "menu", "navbar", "main-navigation", "breadcrumbs"], [self.links()]),
            "header": (rnd.choice(["header", "div"]), ["header", "masthead", "topbar", "branding"], [self.plain(rnd.choice(["h1", "p", "div"]), 0, 1, 5), self.links()][: rnd.randint(1, 2)]),
            "footer": (rnd.choice(["footer", "footer", "div"]), ["footer", "copyright", "bottom", "legal"], [rnd.choice(["", "&copy; 2024 " + _phrase(rnd, 2, 16)]), *([self.plain("p", 0, 3, 15)] if rnd.random() < 0.6 else []), *([self.links()] if rnd.random() < 0.4 else [])]),
            "ad": (rnd.choice(["div", "aside", "section"]), ["ad", "ads", "advert", "sponsored", "promo", "banner"], [rnd.choice(["", _phrase(rnd, 2, 14)]), *([self.plain("p", 0, 3, 20)] if rnd.random() < 0.5 else [])]),
            "side": (rnd.choice(["aside", "aside", "div"]), ["sidebar", "rail", "widget", "related", "popular", "trending"], [self.plain(rnd.choice(["h3", "h2"]), 0, 1, 3), self.links(), *([self.plain("p", 0, 5, 25)] if rnd.random() < 0.5 else [])]),
            "notice": ("div", ["cookie-notice", "consent", "notice", "alert", "gdpr", "popup"], [self.plain("p", 0, 6, 25), lambda: self.node("button", 0, ["OK"])]),
            "form": (rnd.choice(["form", "form", "div"]), ["search", "login", "newsletter", "subscribe", "signup"], [self.plain("p", 0, 3, 12), lambda: self.node("label", 0, ["Email"]), "<input type=text>", lambda: self.node("button", 0, ["Send"])]),
            "comments": (rnd.choice(["section", "div"]), ["comments", "comment-list", "disqus", "replies", "discussion"], [self.plain("h3", 0, 1, 3), *[(lambda: self.node(rnd.choice(["div", "article"]), 0, [self.plain("p", 0, 4, 40)], ["comment", "reply"])) for _ in range(rnd.randint(1, 5))]]),
            "share": (rnd.choice(["div", "ul"]), ["share", "social", "sharing", "tags"], [self.plain("li", 0, 1, 1, True) for _ in range(rnd.randint(2, 5))]),
        }[kind]
        return lambda: self.node(tag, 0, inner, names if tag not in ("nav", "header", "footer", "form") or rnd.random() < 0.4 or tag == "aside" else ())

    def content(self):
        rnd = self.rnd
        parts = []
        if rnd.random() < 0.9:
            parts += self.title()
        for _ in range(rnd.choice([1, 1, 2, 3, 5, 8, 12, 20])):
            r = rnd.random()
            if r < 0.66:
                parts.append(self.prose("p", 1, 1 if rnd.random() < 0.2 else 8, 90))
            elif r < 0.72:
                parts.append(self.plain(rnd.choice(["h2", "h3"]), 1, 1, 8))
            elif r < 0.76:
                parts.append(lambda: self.node(rnd.choice(["ul", "ol"]), 1, [self.prose("li", 1, 3, 20) for _ in range(rnd.randint(2, 5))]))
            elif r < 0.79:
                parts.append(lambda: self.node("blockquote", 1, [self.prose("p", 1, 8, 40)]))
            elif r < 0.81:
                parts.append(self.plain("pre", 1, 5, 30))
            elif r < 0.83:
                parts.append(lambda: self.node("table", 1, [lambda: self.node("tr", 1, [self.plain("td", 1, 1, 6) for _ in range(3)]) for _ in range(3)]))
            elif r < 0.85:
                parts.append(lambda: self.node("figure", 1, ["<img src=x>", self.plain("figcaption", 1, 2, 14)]))
            elif r < 0.87:
                parts.append(lambda: self.node("dl", 1, [p for _ in range(rnd.randint(1, 4)) for p in (self.plain("dt", 1, 1, 3), self.prose("dd", 1, 3, 20))]))
            elif r < 0.91:
                parts.append(self.aside())
            elif r < 0.94:
                parts += self.references()
            else:
                parts.append(self.boiler(rnd.choice(["ad", "share", "form", "side", "ad"])))
        if rnd.random() < 0.1:
            parts += self.references()
        if rnd.random() < 0.15:
            parts.append(self.boiler("comments"))
        tag, names = rnd.choice([("article", ()), ("article", ()), ("main", ()), ("div", ["content", "post", "entry-content", "story", "article-body", "main"]), ("section", ["content", "article", "post"])])
        return lambda: self.node(tag, 1, parts, names)

    def lines(self, low: int, high: int) -> str:
        """Text in lines, as pages without paragraphs have it."""
        return self.rnd.choice(["<br>", "<br/>\n", "<br><br>"]).join(_phrase(self.rnd, 4, 40) for _ in range(self.rnd.randint(low, high)))

    def bare(self) -> str:
        """A page that is little more than its text: paragraphs or lines right in the body, few marks or none."""
        rnd = self.rnd
        parts = []
        if rnd.random() < 0.4:
            parts.append(self.plain(rnd.choice(["h1", "h2"]), 1, 1, 8))
        for _ in range(rnd.choice([1, 1, 1, 2, 3, 6])):
            r = rnd.random()
            if r < 0.6:
                parts.append(self.plain(rnd.choice(["p", "p", "p", "div", "blockquote", "pre"]), 1, 1 if rnd.random() < 0.4 else 6, 70))
            elif r < 0.7:
                parts.append(lambda: self.node("p", 1, [self.lines(2, 4)]))
            elif r < 0.8:
                parts.append(lambda: self.node("ul", 1, [self.plain("li", 1, 2, 20) for _ in range(rnd.randint(2, 4))]))
            else:
                parts.append(lambda: self.lines(1, 5))
        if rnd.random() < 0.3:
            parts.insert(0, self.boiler("nav"))
        if rnd.random() < 0.3:
            parts.append(self.boiler("footer"))
        if rnd.random() < 0.3:
            wrapped = parts
            parts = [lambda: self.node(rnd.choice(["div", "center", "main", "article"]), 1, wrapped)]
        if rnd.random() < 0.15:
            return "".join(part() for part in parts)
        return self.node("html", 1, [lambda: self.node("body", 1, parts)])

    def tables(self) -> str:
        """A page laid out by tables and breaks, without classes."""
        rnd = self.rnd

        def menu(tag):
            links = [f"<a href='/{k}'>{_phrase(rnd, 1, 2)}</a>" for k in range(rnd.randint(3, 8))]
            return lambda: self.node(tag, 0, [rnd.choice(["<br>", " | ", " "]).join(links)])

        def story():
            inner = [self.plain(rnd.choice(["h1", "h2"]), 1, 1, 8)] if rnd.random() < 0.6 else [f"<font size=5><b>{_phrase(rnd, 1, 6)}</b></font><br>"]
            for _ in range(rnd.randint(1, 5)):
                inner.append(self.plain("p", 1, 5, 80) if rnd.random() < 0.5 else (lambda: self.lines(1, 4)))
            return self.node("td", 1, inner)

        cells = [story]
        if rnd.random() < 0.8:
            cells.insert(rnd.randint(0, 1), menu("td"))
        rows = [lambda: self.node("tr", 1, cells)]
        if rnd.random() < 0.5:
            rows.insert(0, lambda: self.node("tr", 0, [menu("td")]))
        parts = [lambda: self.node("table", 1, rows)]
        if rnd.random() < 0.4:
            parts.insert(0, menu(rnd.choice(["div", "center", "p"])))
        if rnd.random() < 0.5:
            parts.append(lambda: self.node(rnd.choice(["center", "div"]), 0, [f"&copy; 1998 {_phrase(rnd, 2, 6)} <a href='/'>Home</a>"]))
        return self.node("html", 1, [lambda: self.node("body", 1, parts)])

    def page(self) -> str:
        rnd = self.rnd
        kind = rnd.random()
        if kind < 0.12:
            return self.bare()
        if kind < 0.2:
            return self.tables()
        middle = [self.content()]
        if rnd.random() < 0.3:
            middle.append(self.boiler("side"))
        if rnd.random() < 0.2:
            middle.append(self.aside())
        if rnd.random() < 0.3:
            middle.append(self.boiler("comments"))
        for _ in range(rnd.choice([0, 1, 1, 2])):
            wrapped = middle
            middle = [lambda wrapped=wrapped: self.node(rnd.choice(["div", "main", "section"]), 1, wrapped, ["wrapper", "container", "page", "layout", "row", "main"])]
        top = [self.boiler(k) for k in ("notice", "header", "nav", "ad", "form") if rnd.random() < 0.45]
        end = [self.boiler(k) for k in ("ad", "side", "form", "footer", "notice") if rnd.random() < (0.8 if k == "footer" else 0.25)]
        body = lambda: self.node("body", 1, [*top, *middle, *end])
        return self.node("html", 1, [body])


def fit_extractor(pages: int = 1300, seed: int = 1) -> Trees:
    """Trees fitted on ``pages`` made-up pages (a fixed bound), a label for each node: 1 unless it is boilerplate or inside it."""
    xs, ys = [], []
    for k in range(pages):
        layout = _Layout(seed * 100_003 + k)
        page = parse(layout.page())
        if len(page.tags) == len(layout.labels):
            xs.append(features(page))
            ys.append(layout.labels)
    return boost(np.vstack(xs), np.concatenate(ys).astype(float))


def extract_main_text(pages: DataFrame, model: Trees | None = None, html_col: str = "html") -> DataFrame:
    """``pages`` with a column ``text``: the article of the whole page, its blocks joined by two line feeds.

    Each node of the page is judged by gradient-boosted trees; of the judgements the likeliest
    consistent set is taken, in which nothing inside a dropped node is kept. Character references are
    decoded, white space inside a block becomes one space, blocks that are empty then are left out.

    A null or empty page, and one in which nothing is kept, has an empty text; text outside of any
    element is kept. A line break inside a block is white space. Rows are handled one by one; a column named text is replaced, and an empty table
    gives an empty result. Very deep or broken markup is closed as the standard says.
    """
    pages = pages.drop("text")
    names = pages.columns
    (own_html,) = unused(pages, "__html")
    shared = pages.sparkSession.sparkContext.broadcast(model or fit_extractor())

    def extract(batches):
        trees = shared.value
        for batch in batches:
            texts = []
            sources = batch.column(own_html)
            for lo in range(0, batch.num_rows, 64):
                parsed = [parse(s) for s in sources.slice(lo, 64).to_pylist()]
                rows = [features(p) for p in parsed]
                cuts = np.cumsum([0, *map(len, rows)])
                odds = trees.log_odds(np.vstack(rows)) if cuts[-1] else np.empty(0)
                for p, a, b in zip(parsed, cuts[:-1], cuts[1:], strict=True):
                    texts.append(main_text(p, decode(p, odds[a:b])))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(texts, pa.string())], names=[*names, "text"])

    return pages.withColumn(own_html, text_of(html_col)).mapInArrow(extract, pages.schema.add("text", "string"))
