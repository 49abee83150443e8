"""Main text of web pages by gradient-boosted trees over DOM nodes.

A forgiving reader builds the tree of a page: scripts, styles, comments and markup go, unclosed paragraphs and list items
are closed as browsers do, an end tag without a start is ignored, a page that breaks off ends every element.  Each element
has features: its tag, the tokens of class, id and role, depth, text and link density of its subtree, sibling statistics
and its place.  Boosted trees score each node; the decoder then labels all nodes together, top down: inside an article a
child may be left out, nothing under a node that is out comes back, and a node around the article is neither.  So no
choice contradicts an ancestor's.

The trees are trained here, on pages of several layouts that ``made_page`` composes from a seed with every node's label known; PAGES
bounds their number.  A null or empty page gives an empty text.  Rows that repeat a page_id each get a result.  An empty table
gives an empty result.
"""

from __future__ import annotations

import html
import random
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import small_batches, texts

PAGES, ROUNDS, DEPTH = 600, 40, 4
# Elements of HTML by kind.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea iframe title".split())  # what follows is raw up to the end tag, or the page's end
DROPPED = frozenset("noscript template svg select".split())  # elements that go as a whole where they are closed
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
STOPS = frozenset("ul ol table div section article aside nav main header footer form body html dl blockquote figure".split())
BLOCK = frozenset("p div section article aside nav main header footer form ul ol table dl blockquote figure h1 h2 h3 h4 h5 h6 pre hr address fieldset".split())
# Word stems in class, id and role that speak for or against an article.
GOOD = ("article", "content", "main", "post", "entry", "body", "story", "text")
BAD = ("ad", "ads", "advert", "banner", "sponsor", "promo", "nav", "menu", "breadcrumb", "header", "footer", "sidebar", "side", "widget", "cookie", "consent", "notice", "popup", "modal", "comment", "reply", "share", "social", "related", "subscribe", "newsletter", "form", "login", "search", "copyright", "toc", "pagination", "hidden")
TAGS = ["body", "article", "main", "section", "div", "p", "h", "ul", "li", "table", "blockquote", "pre", "nav", "header", "footer", "aside", "form", "figure"]
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(>|\Z)", re.S)
ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*.?true", re.I)
SPACES = re.compile(r"\s+")
DROPS = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)(script|style|textarea|iframe|title|noscript|template|svg|select)(?=[\s/>])((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>", re.S | re.I)


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    names: str
    parts: list = field(default_factory=list)  # text, or (kind, child) in page order
    inline: bool = False


def closed(page: str) -> dict[int, int]:
    """Where each element that is DROPPED and closed starts and where its end tag ends; a self-closed svg ends with its tag."""
    opened: dict[str, list[int]] = {name: [] for name in DROPPED}
    out, at = {}, 0
    while m := DROPS.search(page, at):
        at = m.end()
        if m.group(2) is None:
            continue  # a comment
        name, shut = m.group(2).lower(), m.group(3).endswith("/")
        if name in RAW:
            if not m.group(1) and not (shut and opened["svg"]):
                end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
        elif m.group(1):
            if opened[name]:
                out[opened[name].pop()] = m.end()
        elif shut and name == "svg":
            out[m.start()] = m.end()
        else:
            opened[name].append(m.start())
    return out


def tree(page: str) -> list[Node]:
    """The nodes of a page; a parent stands before its children.  The text of an inline element without blocks belongs to the block around it, but its node stays for its place in the stack."""
    nodes = [Node("html", -1, 0, "")]
    stack, at, n, linked = [0], 0, len(page), 0
    ends = None

    def text(raw):
        if raw:
            top = nodes[stack[-1]]
            top.parts.append((html.unescape(raw), linked > 0))

    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            # what remains is text, but for a tag that breaks off
            cut = page.rfind("<", at)
            text(page[at:cut] if cut >= 0 and re.match(r"</?[a-zA-Z!]|<\Z|</\Z", page[cut:]) and ">" not in page[cut:] else page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        close, name, rest, end = m.group(1), m.group(2), m.group(3), m.group(4)
        if name is None:
            close, name, rest, end = m.group(5), m.group(6), m.group(7), m.group(8)
        if name is None:
            continue
        if end != ">" and at >= n:
            break  # a tag that breaks off with the page
        name = name.lower()
        if close:
            for i in range(len(stack) - 1, 0, -1):
                open_tag = nodes[stack[i]].tag
                if open_tag == name:
                    linked -= sum(nodes[j].tag == "a" for j in stack[i:])
                    del stack[i:]
                    break
                if name in INLINE and open_tag in STOPS:
                    break
            continue
        if name == "head":
            continue
        if name in DROPPED:
            ends = closed(page) if ends is None else ends
            at = ends.get(m.start(), at)  # of one that is never closed only the tag goes
            continue
        if name in RAW:
            m = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            at = m.end() if m else n
            continue
        if name in VOID:
            nodes[stack[-1]].parts.append(("\n" if name == "hr" else " ", False))
            continue
        shut = CLOSES.get(name) or ({"p"} if name in BLOCK else set())
        for i in range(len(stack) - 1, 0, -1):
            tag = nodes[stack[i]].tag
            if tag in shut:
                linked -= sum(nodes[j].tag == "a" for j in stack[i:])
                del stack[i:]
                break
            if tag in STOPS or (tag in ("td", "th") and name != "tr"):
                break
        names = " ".join(next(filter(None, x), "") for x in ATTR.findall(rest)).lower() if rest else ""
        if rest and HIDDEN.search(rest):
            names += " hidden"
        child = len(nodes)
        nodes.append(Node(name, stack[-1], len(stack), names, inline=name in INLINE))
        nodes[stack[-1]].parts.append(child)
        if rest.rstrip().endswith("/") and name not in BLOCK:
            continue
        stack.append(child)
        linked += name == "a"
    return nodes


def measures(nodes: list[Node]) -> np.ndarray:
    """The features of every node, one row each."""
    n = len(nodes)
    own, link, stops = np.zeros(n), np.zeros(n), np.zeros(n)
    for i, x in enumerate(nodes):
        for part in x.parts:
            if type(part) is tuple:
                size = len(part[0].strip())
                own[i] += size
                link[i] += size * part[1]
                stops[i] += part[0].count(".") + part[0].count(",")
    total, links, marks, count, paras, items = own.copy(), link.copy(), stops.copy(), np.ones(n), np.zeros(n), np.zeros(n)
    kids, rank = np.zeros(n), np.zeros(n)
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        tag = nodes[i].tag
        for a in (total, links, marks, count):
            a[p] += a[i]
        paras[p] += paras[i] + (tag == "p")
        items[p] += items[i] + (tag == "li")
        kids[p] += 1
    seen: dict[int, int] = {}
    for i, x in enumerate(nodes):
        rank[i] = seen[x.parent] = seen.get(x.parent, -1) + 1
    parent = np.array([max(x.parent, 0) for x in nodes])
    before = np.concatenate([[0], np.cumsum(own)[:-1]])
    whole = max(total[0], 1)
    tags = np.zeros((n, len(TAGS)))
    good, bad, up_bad, up_good, in_article = (np.zeros(n) for _ in range(5))
    for i, x in enumerate(nodes):
        tag = "h" if len(x.tag) == 2 and x.tag[0] == "h" and x.tag[1].isdigit() else x.tag
        if tag in TAGS:
            tags[i, TAGS.index(tag)] = 1
        words = re.split(r"[^a-z]+", x.names) if x.names else ()
        good[i] = sum(w.startswith(g) for w in words for g in GOOD)
        bad[i] = sum(w == b or (len(b) > 3 and w.startswith(b)) for w in words for b in BAD)
        if i:
            p = x.parent
            up_bad[i] = up_bad[p] + bad[p] + (nodes[p].tag in ("nav", "footer", "aside", "form", "header"))
            up_good[i] = up_good[p] + good[p]
            in_article[i] = in_article[p] + (nodes[p].tag in ("article", "main"))
    depth = np.array([x.depth for x in nodes], float)
    columns = [depth, np.log1p(own), np.log1p(total), total / whole, links / np.maximum(total, 1), marks / np.maximum(total, 1) * 10, total / count, kids, np.log1p(paras), np.log1p(items), rank / np.maximum(kids[parent], 1), kids[parent], total / np.maximum(total[parent], 1), before / whole, good, bad, np.minimum(up_bad, 3), np.minimum(up_good, 3), np.minimum(in_article, 2)]
    return np.concatenate([np.stack(columns, 1), tags], 1)


class Boosted:
    """Binary gradient boosting with trees of fixed depth over quantile bins."""

    def __init__(self, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = 0.3):
        self.rounds, self.depth, self.rate = rounds, depth, rate

    def fit(self, x: np.ndarray, y: np.ndarray, bins: int = 32) -> Boosted:
        n, d = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) for j in range(d)]
        code = np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)], 1)
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        score, self.trees = np.full(n, self.base), []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            size = (1 << self.depth + 1) - 1
            which, at, leaf = np.zeros(size, int), np.full(size, np.inf), np.zeros(size)
            node = np.zeros(n, int)
            for level in range(self.depth):
                first = (1 << level) - 1
                width = 1 << level
                best = np.full(width, 1e-6)
                sums = np.zeros((2, width))
                np.add.at(sums[0], node - first, g), np.add.at(sums[1], node - first, h)
                for j in range(d):
                    slot = (node - first) * bins + code[:, j]
                    gs = np.bincount(slot, g, width * bins).reshape(width, bins).cumsum(1)[:, :-1]
                    hs = np.bincount(slot, h, width * bins).reshape(width, bins).cumsum(1)[:, :-1]
                    gr, hr = sums[0][:, None] - gs, sums[1][:, None] - hs
                    gain = gs**2 / (hs + 1) + gr**2 / (hr + 1) - (sums[0] ** 2 / (sums[1] + 1))[:, None]
                    gain[:, len(edges[j]) :] = 0
                    pick = gain.argmax(1)
                    top = gain[np.arange(width), pick]
                    for k in np.flatnonzero(top > best):
                        best[k], which[first + k], at[first + k] = top[k], j, edges[j][pick[k]]
                node = 2 * node + 1 + (x[np.arange(n), which[node]] >= at[node])
            first = (1 << self.depth) - 1
            gs, hs = np.bincount(node - first, g, first + 1), np.bincount(node - first, h, first + 1)
            leaf[first:] = -self.rate * gs / (hs + 1)
            score += leaf[node]
            self.trees.append((which, at, leaf))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for which, at, leaf in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, which[node]] >= at[node])
            out += leaf[node]
        return out


def decode(nodes: list[Node], score: np.ndarray) -> np.ndarray:
    """Which nodes are in: the best labelling by out, around and in, where an out node has only out children and an in node has in or out ones.  Inline nodes follow their parent."""
    n = len(nodes)
    weight = np.array([1.0 + len(x.parts) ** 0.5 for x in nodes])
    out, inside, around = -score * weight, score * weight, np.where([any(type(p) is tuple and p[0].strip() for p in x.parts) for x in nodes], -0.5 * np.abs(score), 0.0) - 0.1
    out, inside, around = out.copy(), inside.copy(), around.copy()
    for i, x in enumerate(nodes):
        if x.inline:
            out[i] = inside[i] = around[i] = 0.0
    total = [out, inside, around]
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        o, s, a = (t[i] for t in total)
        out[p] += o
        inside[p] += s if nodes[i].inline else max(s, o)
        around[p] += max(o, s, a)
    state = np.zeros(n, int)
    state[0] = int(np.argmax([out[0], inside[0], around[0]]))
    for i in range(1, n):
        s = state[nodes[i].parent]
        if s == 0:
            state[i] = 0
        elif s == 1:
            state[i] = 1 if nodes[i].inline or inside[i] >= out[i] else 0
        else:
            state[i] = int(np.argmax([out[i], inside[i], around[i]])) if not nodes[i].inline else 2
    return state == 1


def blocks(nodes: list[Node], keep: np.ndarray) -> str:
    """The text of the kept nodes: a block a line, white space made one space."""
    lines, now = [], []

    def end():
        line = SPACES.sub(" ", "".join(now)).strip()
        if line:
            lines.append(line)
        now.clear()

    todo = [(0, iter(nodes[0].parts))]
    while todo:
        i, parts = todo[-1]
        for part in parts:
            if type(part) is tuple:
                if part[0] == "\n" and not part[1]:
                    now.append(" ")
                elif keep[i]:
                    now.append(part[0])
            else:
                if not nodes[part].inline:
                    end()
                todo.append((part, iter(nodes[part].parts)))
                break
        else:
            if not nodes[i].inline:
                end()
            todo.pop()
    end()
    return "\n".join(lines)


class Maker:
    """Composes pages whose every word is a token of its own kind: c... in the article, x... elsewhere."""

    def __init__(self, rng: random.Random):
        self.rng = rng

    def words(self, kind: str, low: int, high: int) -> str:
        rng, out = self.rng, []
        for i in range(rng.randint(low, high)):
            w = kind + "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(1, 8)))
            out.append(w + rng.choice(["", "", "", "", ",", "."]) if i else w.capitalize())
        return " ".join(out) + rng.choice([".", ".", "", "!"])

    def some(self, *options):
        return self.rng.choice(options)

    def maybe(self, share: float, text: str) -> str:
        return text if self.rng.random() < share else ""

    def links(self, n: int, tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="#">{self.words("x", 1, 3)}</a></{tag}>' for _ in range(n))

    def paragraph(self, plain: str = "p") -> str:
        inner, shape = self.words("c", 1, 90), self.rng.random()
        if self.rng.random() < 0.2:
            inner += f' <a href="#">{self.words("c", 1, 4)}</a> {self.words("c", 2, 20)}'
        if plain == "div":
            return f"<div>{inner}</div>" if shape < 0.8 else f"<div><span>{inner}</span></div>" if shape < 0.9 else f"{inner}<br><br>"
        return f"<p>{inner}</p>" if shape < 0.7 else f"<p><b>{inner}</b></p>" if shape < 0.75 else f"<b>{inner}<br>" if shape < 0.85 else f"<div>{inner}</div>" if shape < 0.9 else f"<p>{inner}"

    def items(self) -> str:
        tag = self.some("ul", "ul", "ol")
        return f"<{tag}>{''.join(f'<li>{self.words("c", 1, 20)}</li>' for _ in range(self.rng.randint(2, 6)))}</{tag}>"

    def extra(self) -> str:
        words, some = self.words, self.some
        return self.rng.choice([
            self.items, self.items,
            lambda: f"<blockquote><p>{words('c', 5, 40)}</p></blockquote>",
            lambda: f"<{(h := some('h2', 'h3'))}>{words('c', 1, 8)}</{h}>",
            lambda: f"<pre>{words('c', 3, 20)}</pre>",
            lambda: f"<figure><img src=x><figcaption>{words('c', 2, 12)}</figcaption></figure>",
            lambda: f"<dl><dt>{words('c', 1, 4)}<dd>{words('c', 2, 20)}</dl>",
            lambda: f"<table><tr><td>{words('c', 1, 5)}</td><td>{words('c', 1, 5)}</td></tr></table>",
            lambda: f'<div class="{some("ad", "advert", "ad-slot", "promo", "sponsored")}">{words("x", 3, 30)}</div>',
            lambda: f'<aside class="{some("related", "sidebar", "widget")}"><ul>{self.links(self.rng.randint(2, 5))}</ul></aside>',
            lambda: f'<form class="{some("newsletter", "subscribe", "search")}"><label>{words("x", 1, 6)}</label><input><button>{words("x", 1, 2)}</button></form>',
            lambda: f'<div class="{some("share", "social")}"><a href="#">{words("x", 1, 1)}</a> <a href="#">{words("x", 1, 1)}</a></div>',
        ])()

    def body(self, plain: str = "p", most: tuple = (0, 1, 1, 2, 3, 5, 8, 14)) -> str:
        out = []
        for _ in range(self.rng.choice(most)):
            out.append(self.paragraph(plain) + self.maybe(0.25, self.extra()))
        return "".join(out)

    def comments(self) -> str:
        words, n, name = self.words, self.rng.randint(1, 6), self.some("comments", "comment-list", "replies", "commentlist", "responses discussion")
        if self.rng.random() < 0.4:
            return f'<ol class="{name}">' + "".join(f"<li><cite>{words('x', 1, 2)}</cite><p>{words('x', 3, 60)}</p></li>" for _ in range(n)) + "</ol>"
        tag = self.some("section", "div")
        return f'<{tag} class="{name}"><h3>{words("x", 1, 3)}</h3>' + "".join(f'<div class="comment"><p>{words("x", 3, 60)}</p></div>' for _ in range(n)) + f"</{tag}>"

    def around(self) -> tuple[str, str]:
        """What stands before and behind the article."""
        words, some, links, r = self.words, self.some, self.links, self.rng
        top = [
            f"<nav>{'<ul>' + links(r.randint(3, 8)) + '</ul>'}</nav>",
            f'<header class="{some("site-header", "top", "")}"><h1>{words("x", 1, 4)}</h1><p>{words("x", 1, 9)}</p></header>',
            f'<div class="{some("nav", "menu", "breadcrumbs")}">{links(r.randint(2, 5))}</div>',
            f'<div class="{some("cookie-notice", "consent", "notice", "banner")}">{words("x", 5, 40)} <button>{words("x", 1, 1)}</button></div>',
            f'<div class="{some("ad", "ads", "advertisement")}">{words("x", 2, 20)}</div>',
        ]
        bottom = [
            f"<footer>{words('x', 2, 30)}</footer>",
            f'<div class="{some("footer", "copyright")}"><p>{words("x", 2, 15)}</p></div>',
            f'<aside class="{some("sidebar", "side", "")}"><h3>{words("x", 1, 3)}</h3><ul>{links(4)}</ul><p>{words("x", 5, 30)}</p></aside>',
            self.comments(),
            f'<form class="{some("login", "search", "contact")}"><label>{words("x", 1, 4)}</label><textarea></textarea></form>',
        ]
        return "".join(x for x in top if r.random() < 0.45), "".join(x for x in bottom if r.random() < 0.45)

    def classic(self) -> str:
        a, z = self.some(("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ('<div id="main-content"><div class="post-body">', "</div></div>"), ('<section class="story">', "</section>"), ('<main><article class="entry">', "</article></main>"))
        head, tail = self.around()
        inner = self.maybe(0.8, f"<h1>{self.words('c', 1, 10)}</h1>") + self.body()
        return head + a + (inner or self.paragraph()) + z + tail

    def headed(self) -> str:
        """An article with a header, and perhaps a footer, of its own."""
        words, head, tail = self.words, *self.around()
        by = self.some(f"<p>{words('c', 2, 6)}</p>", f'<p class="byline">{words("c", 2, 6)}</p>', f"<div><span>{words('c', 2, 4)}</span> <time>{words('c', 1, 3)}</time></div>", "")
        inner = f"<header><h1>{words('c', 1, 12)}</h1>{by}</header>{self.body(most=(1, 2, 4, 8))}"
        a, z = self.some(("<article>", "</article>"), ("<main><article>", "</article></main>"), ('<article class="post">', "</article>"), ("<div><main>", "</main></div>"))
        return head + a + inner + z + tail

    def divs(self) -> str:
        """Nothing but divs, whose classes tell nothing."""
        words, r = self.words, self.rng
        mark = lambda: self.maybe(0.5, f' class="{self.some("c", "box", "row", "col", "x", "wrap", "inner", "l")}{r.randint(1, 40)}"')
        menu = f"<div{mark()}>{' '.join(f'<a href=#>{words("x", 1, 2)}</a>' for _ in range(r.randint(3, 9)))}</div>"
        title = self.maybe(0.8, f"<{(t := self.some('div', 'h1', 'h2'))}>{words('c', 2, 10)}</{t}>")
        inner = title + "".join(f"<div>{words('c', 25, 120)}</div>" + self.maybe(0.3, self.items()) for _ in range(r.randint(2, 8)))
        foot = f"<div{mark()}>{self.some('&copy; ', '')}{words('x', 2, 12)} <a href=#>{words('x', 1, 2)}</a></div>"
        depth = r.randint(0, 3)
        return menu + f"<div{mark()}>" * depth + f"<div{mark()}>{inner}</div>" + "</div>" * depth + self.maybe(0.8, foot)

    def blog(self) -> str:
        words, r = self.words, self.rng
        top = f'<div id="{self.some("header", "masthead", "branding")}"><h1><a href="#">{words("x", 1, 4)}</a></h1><div class="description">{words("x", 2, 9)}</div></div>'
        title = f'<h2 class="{self.some("post-title", "entry-title", "title")}">{words("c", 2, 10)}</h2>'
        date = self.maybe(0.3, f'<div class="date">{words("c", 2, 4)}</div>')
        inner = self.body(most=(1, 2, 3, 5, 8)) + self.maybe(0.6, self.items() + self.paragraph())
        wrapped = f'<div class="{self.some("entry", "post-content", "entry-content", "text")}">{inner}</div>' if r.random() < 0.7 else inner
        meta = self.maybe(0.5, f'<div class="{self.some("share", "post-footer", "social")}">{words("x", 1, 6)} <a href=#>{words("x", 1, 2)}</a></div>')
        side = f'<div id="{self.some("sidebar", "secondary")}"><div class="widget"><h3>{words("x", 1, 3)}</h3><ul>{self.links(r.randint(3, 9))}</ul></div></div>'
        parts = f'<div class="{self.some("post", "hentry", "blog-post", "post type-post")}">{title}{date}{wrapped}{meta}</div>'
        return self.maybe(0.9, top) + self.some('<div id="content">', '<div class="main">', "<div>") + parts + self.maybe(0.6, self.comments()) + "</div>" + self.maybe(0.8, side) + self.maybe(0.7, f'<div id="footer">{words("x", 2, 12)}</div>')


LAYOUTS = ("classic", "classic", "headed", "divs", "blog")


def made_page(rng: random.Random, layout: str | None = None) -> str:
    m = Maker(rng)
    inner = getattr(m, layout or rng.choice(LAYOUTS))()
    return f"<html><head><title>{m.words('x', 1, 5)}</title></head><body>{inner}</body></html>"


def training(seed: int = 7, pages: int = PAGES) -> tuple[np.ndarray, np.ndarray]:
    """(features, labels) of the nodes of made pages; a node's label is whether most of its subtree's words are the article's, except for nodes around the whole article, which do not train."""
    rng, xs, ys = random.Random(seed), [], []
    for _ in range(pages):
        nodes = tree(made_page(rng))
        c, x = np.zeros(len(nodes)), np.zeros(len(nodes))
        for i, node in enumerate(nodes):
            for part in node.parts:
                if type(part) is tuple:
                    for w in part[0].split():
                        c[i] += w[0] in "cC"
                        x[i] += w[0] in "xX"
        for i in range(len(nodes) - 1, 0, -1):
            c[nodes[i].parent] += c[i]
            x[nodes[i].parent] += x[i]
        use = (c + x > 0) & ~np.array([node.inline or node.tag in ("html", "body") for node in nodes])
        f = measures(nodes)
        xs.append(f[use]), ys.append((c > x)[use])
    return np.concatenate(xs), np.concatenate(ys).astype(float)


_model: list[Boosted] = []


def model() -> Boosted:
    if not _model:
        _model.append(Boosted().fit(*training()))
    return _model[0]


def extract_pages(pages: list[str], boosted: Boosted) -> list[str]:
    trees = [tree(p) for p in pages]
    if not trees:
        return []
    score = boosted.score(np.concatenate([measures(t) for t in trees]))
    out, at = [], 0
    for nodes in trees:
        out.append(blocks(nodes, decode(nodes, score[at : at + len(nodes)])))
        at += len(nodes)
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """Per row: page_id, url, text, n_chars."""
    spark = pages.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model())

    def run(batches):
        for batch in batches:
            raw = texts(batch.column(2))
            found = []
            for at in range(0, len(raw), 100):
                found += extract_pages(raw[at : at + 100], shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=[id_col, url, "text", "n_chars"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url)]
    return pages.select(id_col, url, body).mapInArrow(run, f"{id_col} {kinds[0]}, {url} {kinds[1]}, text string, n_chars long")
