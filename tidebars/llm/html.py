"""Main text of web pages by a tree-structured graphical model.

A page is parsed into its tree of block elements. Each node is content or not: unary potentials weigh its tag, class, id and
role words, the length of its own text, the share of it in links, and the shares of the page's text that it has itself and
with all below it; pair potentials weigh the states of parent and child, for plain text elements apart from all others.
Sum-product messages, once from the leaves upward and once from the root downward, give every node's exact marginal; both
sweeps run level by level over all pages of a batch at once. The weights maximise the likelihood of labelled pages, which
are generated here: articles in many layouts, with menus, notices, adverts, forms, side bars, footers and comments around
and within. The text is that of the nodes whose content marginal is at least one half.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidebars.llm._shared import slices

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Fixed values of HTML: elements that make blocks, that have no end tag, whose text is not markup, and that end a paragraph.
BLOCKS = frozenset(
    "html head title body address article aside blockquote button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav noscript ol option p pre section select summary table tbody td template textarea tfoot th thead tr ul iframe object svg video audio canvas".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style".split())
TEXT_ONLY = frozenset("textarea title".split())
#: Elements that the start of such an element ends, if they are open and innermost but for inline elements.
CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "option": {"option"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tbody": {"tr", "td", "th", "thead"}, "body": {"head"}}
#: Words of class, id and role, by what they tell.
HINTS = [
    "ad ads advert advertisement sponsor sponsored promo banner", "nav navigation menu menubar breadcrumb breadcrumbs tabs toolbar", "header masthead top logo branding",
    "footer bottom copyright legal contentinfo", "sidebar aside complementary widget rail related recommended recommendations", "comment comments discussion reply replies disqus reader",
    "cookie cookies consent notice gdpr alert popup modal dialog overlay", "social share sharing follow subscribe newsletter signup login search form", "content article post entry story text main body prose page",
]
_HINT = {w: i for i, ws in enumerate(HINTS) for w in ws.split()}
_TAGS = {t: i for i, t in enumerate(sorted(BLOCKS))}
_LENGTHS = (1, 20, 80, 200)
#: Elements that hold text rather than parts of a page.
_PLAIN = frozenset("p li h1 h2 h3 h4 h5 h6 blockquote pre td th dd dt figcaption ul ol dl table tr tbody".split())
#: Shares of the page's text that a node has itself, and with all below it.
_SHARES = (0.05, 0.2, 0.5, 0.8)
WIDTH = len(_TAGS) + len(HINTS) + len(_LENGTHS) + 2 * len(_SHARES) + 6


class Page:
    """Block elements of a page in page order, and its blocks of text with the element that each stands in."""

    def __init__(self, source: str) -> None:
        self.parent, self.depth, self.marks = [-1], [0], [[]]
        self.length, self.linked = [0], [0]
        self.blocks: list[tuple[int, str]] = []
        self._open, self._text, self._links = [(0, "")], [], 0
        self._named: dict[str, int] = {}  # how many open elements have a name
        at, raw = 0, None
        while True:
            if raw:
                end = re.compile(rf"</{raw}(?=[\s/>])", re.I).search(source, at)
                if raw in TEXT_ONLY:
                    self._add(source[at : end.start() if end else len(source)])
                at, raw = (end.start() if end else len(source)), None
            m = _TOKEN.search(source, at)
            self._add(source[at : m.start() if m else len(source)])
            if not m:
                break
            at = m.end()
            if m[2]:
                raw = self._tag(m[2].lower(), bool(m[1]), m[3])
            elif m[0].startswith("<![CDATA["):
                self._add(m[0][9:].removesuffix("]]>"))
        self._flush()

    def _add(self, text: str) -> None:
        if text:
            self._text.append((text, self._links > 0))

    def _flush(self) -> None:
        if self._text:
            node = self._open[-1][0]
            text = " ".join(html.unescape("".join(t for t, _ in self._text)).split())
            if text:
                self.blocks.append((node, text))
                self.length[node] += len(text)
                self.linked[node] += sum(len(t) for t, on in self._text if on)
            self._text = []

    def _close(self) -> str:
        _, name = self._open.pop()
        self._named[name] -= 1
        return name

    def _tag(self, name: str, end: bool, attributes: str) -> str | None:
        if name == "a":
            self._links = 0 if end else 1
        if name in ("br", "wbr", "img", "input"):
            self._text.append((" " if name != "wbr" else "", False))
        if name in RAW:
            return None if end else name
        if name not in BLOCKS:
            return None
        self._flush()
        if end:
            if self._named.get(name):
                while self._close() != name:
                    pass
                self._links = 0
            return None
        closes = CLOSES.get(name, {"p"})
        while self._open[-1][1] in closes:
            self._close()
        node = len(self.parent)
        self.parent.append(self._open[-1][0])
        self.depth.append(self.depth[self._open[-1][0]] + 1)
        hints = {_HINT[w] for a in _ATTRIBUTE.finditer(attributes) for w in re.findall(r"[a-z]+", (a[2] or a[3] or a[4] or "").lower()) if w in _HINT}
        self.marks.append([_TAGS[name], *(len(_TAGS) + h for h in hints)])
        self.length.append(0)
        self.linked.append(0)
        if name not in VOID and not attributes.rstrip().endswith("/"):
            self._open.append((node, name))
            self._named[name] = self._named.get(name, 0) + 1
        return name if name in TEXT_ONLY else None


class Forest:
    """The trees of several pages as arrays."""

    def __init__(self, pages: list[Page]) -> None:
        sizes = np.array([len(p.parent) for p in pages], np.int64)
        self.first = np.cumsum(sizes) - sizes
        self.parent = np.concatenate([np.array(p.parent) + f * (np.array(p.parent) >= 0) for p, f in zip(pages, self.first)]) if pages else np.zeros(0, np.int64)
        self.depth = np.concatenate([p.depth for p in pages]) if pages else np.zeros(0, np.int64)
        length = np.concatenate([p.length for p in pages]) if pages else np.zeros(0)
        linked = np.concatenate([p.linked for p in pages]) if pages else np.zeros(0)
        self.features = np.zeros((len(self.parent), WIDTH), np.float32)
        for f, p in zip(self.first.tolist(), pages):
            for i, marks in enumerate(p.marks):
                self.features[f + i, marks] = 1
        order = np.argsort(self.depth, kind="stable")
        cut = np.searchsorted(self.depth[order], np.arange(1, int(self.depth.max(initial=0)) + 2))
        self.levels = [order[a:b] for a, b in zip(cut, cut[1:])]  # from the root's children downward
        below, linked_below = length.astype(float), linked.astype(float)
        for level in reversed(self.levels):
            np.add.at(below, self.parent[level], below[level])
            np.add.at(linked_below, self.parent[level], linked_below[level])
        page = np.maximum(np.repeat(below[self.first], sizes) if len(sizes) else below, 1)
        base = len(_TAGS) + len(HINTS)
        marks = [length >= n for n in _LENGTHS] + [length >= x * page for x in _SHARES] + [below >= x * page for x in _SHARES]
        marks += [linked * 2 > length, (length > 0) & (linked == 0), self.parent < 0, np.ones(len(page)), linked_below * 2 > below, length > 0]
        for i, mark in enumerate(marks):
            self.features[:, base + i] = mark
        # Which pair potentials an element has with its parent: 1 if it is plain text without a telling class.
        plain = [_TAGS[t] for t in sorted(_PLAIN)]
        self.kind = ((self.features[:, plain].sum(1) > 0) & (self.features[:, len(_TAGS) : base].sum(1) == 0)).astype(int)

    def marginals(self, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(content) of each node, and the joint P(parent, child) of each edge (rows of roots are zero).

        ``unary``: log-potential of content; ``pair``: for each kind 2 x 2 log-potentials of (parent, child).
        """
        n, e = len(unary), np.exp(pair - pair.max())[self.kind]
        up = np.stack([np.zeros(n), unary], 1)  # log of what a node's own potential and its children say
        message = np.zeros((n, 2))
        for level in reversed(self.levels):
            top = up[level].max(1, keepdims=True)
            message[level] = np.log(np.einsum("nc,npc->np", np.exp(up[level] - top), e[level])) + top
            np.add.at(up, self.parent[level], message[level])
        down = np.zeros((n, 2))  # log of what the rest of the tree says
        joint = np.zeros((n, 2, 2))
        for level in self.levels:
            p = self.parent[level]
            rest = up[p] + down[p] - message[level]
            rest -= rest.max(1, keepdims=True)
            down[level] = np.log(np.einsum("np,npc->nc", np.exp(rest), e[level]))
            both = np.exp(rest)[:, :, None] * e[level] * np.exp(up[level] - up[level].max(1, keepdims=True))[:, None, :]
            joint[level] = both / both.sum((1, 2), keepdims=True)
        belief = up + down
        belief -= belief.max(1, keepdims=True)
        belief = np.exp(belief)
        return belief[:, 1] / belief.sum(1), joint


def labelled_page(seed: int) -> tuple[str, list[str]]:
    """A page in a random layout and the blocks of its main text."""
    r = random.Random(seed)
    text = lambda lo, hi: " ".join("".join(r.choice("abcdeghilmnoprstu") for _ in range(r.randint(2, 9))) for _ in range(r.randint(lo, hi)))
    links = lambda n: "<ul>" + "".join(f'<li><a href="/{i}">{text(1, 2)}</a></li>' for i in range(n)) + "</ul>"
    kept: list[str] = []
    brief = r.random() < 0.35  # a page of few words

    def say(tag: str, lo: int, hi: int) -> str:
        kept.append(text(lo, hi))
        return f"<{tag}>{kept[-1]}</{tag}>"

    def paragraph() -> str:
        kind = r.random()
        if kind < 0.75:
            return say("p", *((1, 12) if brief or r.random() < 0.3 else (15, 90)))
        if kind < 0.82:
            return "<ul>" + say("li", 3, 12) + say("li", 3, 12) + "</ul>"
        if kind < 0.9:
            return say(r.choice(["h2", "h3"]), 2, 6)
        if kind < 0.95:
            return "<blockquote>" + say("p", 8, 30) + "</blockquote>"
        kept.append(f"{text(6, 20)} link {text(4, 20)}")
        a, b = kept[-1].split(" link ")
        return f'<p>{a} <a href="/x">link</a> {b}</p>'

    junk = [
        lambda: f"<nav>{links(r.randint(3, 8))}</nav>", lambda: f'<div class="menu">{links(r.randint(3, 8))}</div>', lambda: f"<header><a href='/'>{text(1, 3)}</a><p>{text(2, 8)}</p></header>",
        lambda: f'<div class="{r.choice(["ad", "advert", "sponsored promo", "ads"])}">{text(3, 40)}</div>', lambda: f'<div class="{r.choice(["cookie-notice", "consent", "notice"])}"><p>{text(5, 40)}</p><button>{text(1, 2)}</button></div>',
        lambda: f"<aside><h3>{text(1, 3)}</h3><p>{text(5, 40)}</p>{links(3)}</aside>", lambda: f'<div id="sidebar"><p>{text(5, 40)}</p>{links(4)}</div>', lambda: f"<form><p>{text(2, 12)}</p><select><option>{text(1, 1)}<option>{text(1, 1)}</select><button>{text(1, 1)}</button></form>",
        lambda: f'<section class="{r.choice(["comments", "comment-list", "discussion"])}"><h2>{text(1, 2)}</h2>' + "".join(f'<div class="comment"><p>{text(3, 50)}</p></div>' for _ in range(r.randint(1, 4))) + "</section>",
        lambda: f'<div class="related"><h3>{text(1, 3)}</h3>{links(3)}</div>', lambda: f'<div class="share"><a href="#">{text(1, 1)}</a> <a href="#">{text(1, 1)}</a></div>', lambda: f"<footer>&copy; {text(2, 30)}</footer>",
        lambda: f'<ul class="comments"><li>{text(4, 40)}</li><li>{text(4, 40)}</li></ul>', lambda: f'<div class="newsletter signup"><p>{text(4, 20)}</p></div>',
    ]
    bare = r.random() < 0.2  # a page of little more than its text
    some = lambda most: 0 if bare else r.randint(0 if r.random() < 0.1 else 1, most)
    before = "".join(r.choice(junk)() for _ in range(some(4)))
    plain = r.random()
    inner = say("h1", 2, 10) if r.random() < 0.7 else ""
    for k in range(1 if r.random() < 0.15 else r.randint(1, 3 if brief else 12)):
        if k and r.random() < 0.07:
            inner += r.choice(junk[3:])()
        elif plain < 0.08:  # text in elements that are not made for it
            inner += say("div", 15, 90)
        elif plain < 0.12:
            inner += "<table><tr>" + say("td", 5, 40) + say("td", 5, 40) + "</tr></table>"
        else:
            inner += paragraph() if inner or r.random() < 0.5 else say("p", 1 if brief else 8, 90)
    wraps = [("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div class="post-content">', "</div>"), ('<div id="content"><div class="entry">', "</div></div>"), ('<article><div class="body">', "</div></article>"), ('<div class="story">', "</div>")]
    loose = [("<div>", "</div>"), ("<div><div>", "</div></div>"), ("<section>", "</section>"), ("", "")]
    open_, close = r.choice(loose if bare or r.random() < 0.15 else wraps)
    after = "".join(r.choice(junk)() for _ in range(some(4)))
    head = f"<head><title>{text(2, 8)}</title></head>" if r.random() < 0.95 else ""
    return (f"{open_}{inner}{close}" if bare and r.random() < 0.3 else f"<html>{head}<body>{before}{open_}{inner}{close}{after}</body></html>"), kept


def _labels(page: Page, kept: list[str]) -> np.ndarray:
    """Nodes with main text, and those between such nodes and the lowest element that holds them all."""
    rest, out = list(kept), np.zeros(len(page.parent))
    for node, text in page.blocks:
        if rest and text == rest[0]:
            out[node] = 1
            rest.pop(0)
    paths = []
    for node in np.flatnonzero(out).tolist():
        path = [node]
        while page.parent[path[-1]] >= 0:
            path.append(page.parent[path[-1]])
        paths.append(path)
    shared = set(paths[0]).intersection(*paths) if paths else set()
    lowest = max(shared, key=lambda i: page.depth[i], default=-1)
    for path in paths:
        for node in path:
            out[node] = 1
            if node == lowest:
                break
    return out


@lru_cache(maxsize=4)
def train(pages: int = 900, rounds: int = 200, seed: int = 7, penalty: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Unary and pair weights that maximise the likelihood of generated labelled pages (Adam on the exact gradient)."""
    made = [labelled_page(seed * 100_003 + i) for i in range(pages)]
    parsed = [Page(source) for source, _ in made]
    forest = Forest(parsed)
    features = forest.features.astype(float)
    y = np.concatenate([_labels(p, kept) for p, (_, kept) in zip(parsed, made)])
    kinds = np.eye(2)[forest.kind]
    seen = np.zeros((len(y), 2, 2))
    child = np.flatnonzero(forest.parent >= 0)
    seen[child, y[forest.parent[child]].astype(int), y[child].astype(int)] = 1
    w = np.zeros(WIDTH + 8)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        p, joint = forest.marginals(features @ w[:WIDTH], w[WIDTH:].reshape(2, 2, 2))
        grad = np.append(features.T @ (y - p), np.einsum("nk,npc->kpc", kinds, seen - joint).ravel()) / len(y) - penalty * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w += 0.5 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w[:WIDTH], w[WIDTH:].reshape(2, 2, 2)


def main_texts(sources: list[str], weights: tuple[np.ndarray, np.ndarray]) -> list[list[tuple[str, float]]]:
    """For each page its blocks of main text with their marginals, in page order."""
    parsed = [Page(s) for s in sources]
    forest = Forest(parsed)
    p, _ = forest.marginals(forest.features @ weights[0].astype(np.float32), weights[1])
    return [[(text, float(p[f + node])) for node, text in page.blocks if p[f + node] >= 0.5] for f, page in zip(forest.first.tolist(), parsed)]


def extract(pages: DataFrame, weights: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """(page_id, url, text, blocks) of each row: the main text, and its blocks with their content marginals.

    A null or empty html has no text (an empty string). White space within a block becomes one space, blocks are joined by
    one newline. Repeated rows and null page_ids or urls stay as they are, other columns are ignored, an empty table gives
    no rows.
    """
    weights = weights or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1 << 20):
            found = main_texts([h or "" for h in b.column("html").to_pylist()], weights)
            kind = pa.list_(pa.struct([("text", pa.string()), ("content", pa.float64())]))
            blocks = pa.array([[{"text": t, "content": p} for t, p in x] for x in found], kind)
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(["\n".join(t for t, _ in x) for x in found], pa.string()), blocks], ["page_id", "url", "text", "blocks"])

    rows = pages.select("page_id", "url", "html")
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, blocks array<struct<text:string,content:double>>")
