"""Main text of web pages: flat text blocks, classified by a decision tree over words and link densities.

A page becomes a row of text blocks. Each block is described by its words and link density, by those of the block before
and the block after, and by one feature for where it stands: in the page's article, outside it, or unknown. The tree is
grown from the small table of labelled pages below. Pages without telling elements are decided by words and links alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .texts import slices

# fixed values: elements that end a block, that nest, whose content is no text, that are never main text, and headings
BLOCK = frozenset("address article aside blockquote body center dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section table tbody td tfoot th thead title tr ul".split())
NEST = frozenset("article aside blockquote div dl fieldset figure footer form header main nav ol section table ul".split())
SKIP = frozenset("button canvas datalist iframe noscript object option script select style svg template textarea title".split())
OUTSIDE = frozenset("aside footer nav".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
# fixed values: parts of names that tell an element outside the main text, and parts that may stand beside them
HINTS = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header masthead menu menus modal nav navbar "
                  "navigation newsletter notice notices pager pagination popup promo promos promotion related respond share sharing sidebar social sponsor sponsored sponsors subscribe toolbar widget widgets".split())
BESIDE = frozenset("a aside area bar block body bottom box buttons center container content desktop fixed form global group icons inner item items left link links list main mobile module outer panel post posts "
                   "primary reader region right row secondary section site slot small sticky thread top user wrap wrapper".split())
PART = re.compile(r"[^\W_\d]+")


class Block(NamedTuple):
    """text; characters in links; elements around it that name themselves outside (hints, forms) or are so (hard);
    the article or main it stands in (-1: none), how many hints stood around that, the innermost of them; whether it is a heading."""

    text: str
    linked: int
    hints: int
    forms: int
    hard: bool
    inner: int
    above: int
    holder: int
    heading: bool


def is_hint(name: str) -> bool:
    """Whether a class or id names something outside: one of its parts is a hint and the rest say nothing else.

    Layouts that are with, without or no such thing don't.
    """
    parts = [x.lower() for x in PART.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name))]
    return any(x in HINTS for x in parts) and all(x in HINTS or x in BESIDE for x in parts)


class _Blocks(HTMLParser):
    """Collects the blocks of one page; a block costs the same at any depth."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.open: list[tuple[str, str, int]] = []  # element, kind, number
        self.many: Counter = Counter()  # open elements by name and by kind
        self.inner: list[tuple[int, int, int]] = []  # open articles: number, hints around, innermost hint
        self.hint: list[int] = []
        self.skip: list[tuple[str, int]] = []
        self.skipped: Counter = Counter()
        self.text: list[str] = []
        self.linked = self.link = self.number = 0  # link: depth, from 1, at which an open link began
        self.heading = False

    def flush(self):
        words = " ".join("".join(self.text).split())
        if words:
            inner = self.inner[-1] if self.inner else (-1, 0, -1)
            self.blocks.append(Block(words, self.linked, self.many["hint"], self.many["form"], self.many["hard"] > 0, *inner, self.heading))
        self.text, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in SKIP:
            self.skip.append((tag, len(self.open)))
            self.skipped[tag] += 1
        elif tag in BLOCK:
            self.flush()
            self.heading = tag in HEADING
            if tag in NEST:
                self._enter(tag, attrs)
        elif tag == "a":
            self.link = len(self.open) + 1
        elif tag == "br":
            self.text.append(" ")

    def _enter(self, tag, attrs):
        kind = ""
        if tag in OUTSIDE or tag == "header" and not self.inner:
            kind = "hard"
        elif tag == "form":
            kind = "form"
        elif tag in ("article", "main"):
            kind = "inner"
            self.inner.append((self.number, self.many["hint"] + self.many["form"], self.hint[-1] if self.hint else -1))
        elif any(is_hint(name) for k, v in attrs if k in ("class", "id", "role") and v for name in v.split()):
            kind = "hint"
        if kind in ("hint", "form"):
            self.hint.append(self.number)
        self.open.append((tag, kind, self.number))
        self.many[tag + ">"] += 1
        self.many[kind] += 1
        self.number += 1

    def handle_startendtag(self, tag, attrs):
        if tag in SKIP or tag in NEST:
            return
        self.handle_starttag(tag, attrs)
        if tag == "a":
            self.link = 0

    def handle_endtag(self, tag):
        if self.skipped[tag]:
            self._unskip(tag)
        elif tag in BLOCK:
            self.flush()
            self.heading = False
            if self.many[tag + ">"]:
                last = ""
                while last != tag:
                    last, kind, _ = self.open.pop()
                    self.many[last + ">"] -= 1
                    self.many[kind] -= 1
                    if kind == "inner":
                        self.inner.pop()
                    elif kind in ("hint", "form"):
                        self.hint.pop()
                if self.link > len(self.open) + 1:
                    self.link = 0
                while self.skip and self.skip[-1][1] > len(self.open):  # left open inside
                    self._unskip(self.skip[-1][0])
        elif tag == "a":
            self.link = 0

    def _unskip(self, tag):
        last = ""
        while last != tag:
            last = self.skip.pop()[0]
            self.skipped[last] -= 1

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)
            if self.link:
                self.linked += len("".join(data.split()))

    def unknown_decl(self, data):
        pass


def blocks(html: str) -> list[Block]:
    p = _Blocks()
    p.feed(html)
    p.close()
    p.flush()
    return p.blocks


ARTICLE, UNKNOWN, ASIDE, AWAY = 1.0, 0.0, -0.5, -1.0


def regions(found: list[Block]) -> list[float]:
    """Where each block stands: in the page's article, beside an article, outside by its elements' names, or unknown.

    The article is what stands in article or main elements with the fewest hints around them, headings not counted; a hint
    or form around it is a wrapper. Of several wrappers that one with the most words holds it. A form around everything
    is a wrapper too.
    """
    own = [b for b in found if b.inner >= 0 and not b.hard and b.hints + b.forms == b.above]
    best = min((b.above for b in own if not b.heading), default=min((b.above for b in own), default=None))
    holder = -1
    if best:
        size: Counter = Counter()
        for b in own:
            if b.above == best:
                size[b.holder] += len(b.text.split())
        holder = max(size, key=lambda h: (size[h], -h))
    around = min((b.forms for b in found if not b.hard), default=0) if best is None else 0
    out = []
    for b in found:
        level = b.hints + b.forms
        if b.hard:
            out.append(AWAY)
        elif best is not None and b.inner >= 0 and level == b.above and (level < best or level == best and (not best or b.holder == holder)):
            out.append(ARTICLE)
        elif level > around:
            out.append(AWAY)
        else:
            out.append(UNKNOWN if best is None else ASIDE)
    return out


FEATURES = ("region", "words", "links", "words before", "links before", "words after", "links after")


def features(found: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block; what would stand before the first and after the last block counts as empty."""
    own = np.array([(len(b.text.split()), b.linked / max(len(b.text.replace(" ", "")), 1)) for b in found], float).reshape(-1, 2)
    edge = np.zeros((1, 2))
    before, after = np.concatenate([edge, own[:-1]]), np.concatenate([own[1:], edge])
    return np.concatenate([np.array(regions(found), float).reshape(-1, 1), own, before[: len(own)], after[: len(own)]], axis=1)


# fixed values: the labelled table. A row is a page; each of its lines is 1 for main text or 0, then markup; {n} are n words.
LABELLED = (
    """0 <div><a>{1}</a></div><div><a>{1}</a></div><div><a>{2}</a></div>
1 <h1>{7}</h1><p>{45}</p><p>{80}</p><p>{30}</p>
0 <div>{6}</div><div><a>{2}</a> <a>{2}</a></div>""",
    """0 <ul><li><a>{2}</a><li><a>{1}</a><li><a>{3}</a></ul>
1 <p>{60}</p><p>{1}</p><p>{52}</p><p>{3}</p><p>{41}</p>
0 <ul><li><a>{2}</a><li><a>{4}</a></ul><p>{8} <a>{2}</a></p>""",
    """0 <table><tr><td><a>{1}</a><td><a>{2}</a></tr></table>
1 <h2>{5}</h2><p>{33} <a>{2}</a> {20}</p><p>{18}</p><p>{64}</p>
0 <div><a>{6}</a></div><div><a>{7}</a></div><div><a>{5}</a></div><div>{5}</div>""",
    """0 <div>{3}</div><div><a>{2}</a></div><div><a>{1}</a></div>
1 <h1>{9}</h1><div>{120}</div><div>{75}</div>
0 <div>{4}</div><div><a>{1}</a></div><div><a>{2}</a></div><div>{7}</div>""",
    """1 <p>{25}</p><p>{40}</p><p>{9}</p><p>{31}</p>""",
    """1 <h1>{4}</h1><p>{15}</p><p>{28}</p>
0 <div><a>{3}</a></div><div>{5}</div>""",
    """0 <div><a>{2}</a></div><div>{11}</div><div><a>{2}</a></div>
1 <p>{70}</p><p>{6}</p><p>{48}</p><p>{90}</p>
0 <div><a>{3}</a></div><div>{12}</div><div><a>{2}</a></div>""",
    """0 <div><a>{1}</a> <a>{1}</a> <a>{2}</a></div>
1 <h1>{6}</h1><p>{22} <a>{3}</a></p><ul><li>{14}<li>{12}<li>{17}</ul><p>{38}</p>
0 <div><a>{1}</a> <a>{1}</a></div><div>{6}</div>""",
    """0 <div>{2}</div><div><a>{4}</a></div><div><a>{5}</a></div><div>{2}</div><div><a>{6}</a></div><div><a>{4}</a></div>""",
    """0 <div><a>{9}</a></div><div>{4}</div><div><a>{11}</a></div><div>{3}</div><div><a>{8}</a></div><div>{4}</div>""",
    """1 <h2>{3}</h2><p>{55}</p><h2>{4}</h2><p>{61}</p><h2>{2}</h2><p>{47}</p>
0 <p><a>{2}</a> {1} <a>{2}</a> {1} <a>{1}</a></p>""",
    """0 <div>{1}</div><div>{2}</div><div><a>{1}</a></div>
1 <h1>{8}</h1><p>{2}</p><p>{66}</p><p>{34}</p><blockquote>{19}</blockquote><p>{27}</p>
0 <div><a>{5}</a></div><div>{3}</div><div><a>{4}</a></div>""",
    """0 <nav><a>{1}</a></nav><div class="ad">{9}</div>
1 <article><h1>{9}</h1><p>{60}</p><p>{1}</p><p>{25}</p></article>
0 <footer>{12}</footer>""",
    """0 <nav><ul><li><a>{1}</a><li><a>{2}</a></ul></nav>
1 <article><p>{3}</p></article>
0 <section class="comments"><article>{40}</article><article>{22}</article></section><footer>{6} <a>{2}</a></footer>""",
    """0 <div class="sidebar"><article>{25}</article></div>
1 <article><h1>{5}</h1><p>{70}</p><p><a>{6}</a></p><ul><li><a>{4}</a><li><a>{5}</a></ul><p>{2}</p></article>
0 <div id="related"><p>{30}</p><p>{28}</p></div><div>{5}</div>""",
    """0 <header>{4}<a>{2}</a></header><div class="cookie-notice">{30}</div>
1 <main><p>{4}</p><p>{110}</p><div>{50}</div></main>
0 <aside><p>{35}</p><p>{45}</p></aside><div><a>{3}</a></div>""",
    """0 <div class="menu"><a>{1}</a></div><div class="banner">{20}</div>
1 <div><h1>{6}</h1><p>{44}</p><p>{4}</p><p>{58}</p></div>
0 <div class="newsletter">{24}</div><div class="comments"><p>{50}</p><p>{33}</p></div>""",
    """1 <div><p>{85}</p><p>{40}</p><p>{62}</p></div>
0 <div>{5}</div><section><article class="teaser"><div class="promo">{18}</div></article></section><div><a>{2}</a></div>""",
    """0 <div>{6}</div><div>{3}</div>
1 <article><p>{20}</p><p>{1}</p><p>{48}</p></article>
0 <div>{10}</div><div><a>{3}</a></div><div>{4}</div>""",
    """0 <form>{4}</form><div class="social-links"><a>{1}</a></div>
1 <p>{36}</p><p>{29}</p><p>{11}</p>
0 <form>{15}</form><div class="pagination"><a>{1}</a><a>{1}</a></div>""",
    """0 <div><a>{2}</a> {1} <a>{2}</a></div>
1 <h1>{11}</h1><p>{17}</p><p>{24}</p><p>{8}</p><p>{32}</p>
0 <div>{9}</div><div><a>{1}</a></div><div><a>{1}</a></div><div><a>{1}</a></div>""",
    """0 <nav><a>{1}</a></nav>
1 <article><h1>{2}</h1><p>{1}</p><p>{2}</p><p>{1}</p><p>{4}</p><p>{1}</p><p>{3}</p><p><a>{1}</a></p></article>
0 <footer>{2}</footer><div class="share">{3}</div>""",
    """1 <article><p>{2}</p><p>{5}</p><p><a>{2}</a></p><p>{1}</p><p>{6}</p><p>{1}</p></article>
0 <div class="comments"><p>{3}</p><p>{28}</p><p>{2}</p></div>""",
    """0 <div class="ad">{14}</div>
1 <main><h1>{8}</h1><p>{3}</p><p>{12}</p><p>{2}</p><p>{7}</p><p>{1}</p></main>
0 <div class="ad">{60}</div>""",
    """0 <div>{4}</div><div>{2}</div>
1 <article><p>{1}</p><p>{9}</p><p>{3}</p><ul><li>{1}<li>{2}<li>{1}</ul><p>{11}</p></article>
0 <div>{3}</div><div>{7}</div>""",
    """1 <article><h1>{6}</h1><p>{62}</p><p>{1}</p></article>""",
    """0 <div class="ad">{7}</div>
1 <article><p>{1}</p><p>{63}</p><p>{2}</p><p><a>{2}</a></p><p>{4}</p></article>""",
    """1 <article><p>{12}</p></article>""",
    """1 <article><p>{1}</p></article>""",
    """0 <div><a>{2}</a></div>
1 <article><p>{64}</p><p>{3}</p><p>{2}</p></article>
0 <div><a>{3}</a></div><div>{1}</div>""",
    """0 <div class="comments"><h2>{1}</h2><p>{48}</p><p>{8}</p><p>{73}</p><p>{31}</p><p>{16}</p></div><aside><p>{55}</p><p>{64}</p><p>{90}</p></aside>
0 <div class="ad">{8}</div><div class="notice"><p>{38}</p><p>{27}</p></div><footer><p>{8}</p><p>{44}</p><p>{70}</p></footer>""",
    """0 <div id="sidebar"><p>{21}</p><p>{8}</p><p>{33}</p><p>{52}</p></div><div class="promo">{46}</div><div class="newsletter">{8}</div>
1 <p>{42}</p><p>{57}</p><p>{36}</p>
0 <div class="related-posts"><p>{39}</p><p>{24}</p><p>{8}</p></div><footer><p>{100}</p></footer>""",
    """1 <p>{50}</p><p>{75}</p>""",
    """1 <h1>{5}</h1><p>{39}</p><p>{22}</p><p>{51}</p>""",
    """0 <div><a>{2}</a></div><div><a>{1}</a></div>
1 <p>{28}</p><p>{66}</p>""",
    """0 <div>{3}</div><div><a>{1}</a></div>
1 <div>{90}</div>""",
    """1 <p>{130}</p><p>{5}</p><p>{95}</p>
0 <div><a>{12}</a></div><div>{10}</div><div><a>{10}</a></div><div>{9}</div>""",
)


def labelled_pages(table: tuple[str, ...] = LABELLED) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features, labels) of the blocks of each labelled page."""
    out = []
    for page in table:
        p, labels = _Blocks(), []
        for line in page.split("\n"):
            p.feed(re.sub(r"\{(\d+)\}", lambda m: " ".join(["words"] * int(m[1])), line[2:]))
            p.flush()
            labels += [int(line[0])] * (len(p.blocks) - len(labels))
        out.append((features(p.blocks), np.array(labels)))
    return out


LEAST_LEAF = 3  # labelled blocks on either side of a split


def grow(x: np.ndarray, y: np.ndarray):
    """A decision tree by Gini impurity: (feature, threshold, lower branch, upper branch), or the commoner label as an int."""
    if len(set(y)) == 1:
        return int(y[0])
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, f] < cut
            if min(low.sum(), (~low).sum()) < LEAST_LEAF:
                continue
            impurity = sum(m.sum() * p * (1 - p) for m in (low, ~low) for p in (y[m].mean(),))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, cut)
    if best is None:
        return int(y.mean() >= 0.5)
    _, f, cut = best
    low = x[:, f] < cut
    lower, upper = grow(x[low], y[low]), grow(x[~low], y[~low])
    return lower if lower == upper and isinstance(lower, int) else (f, float(cut), lower, upper)


@cache
def tree():
    pages = labelled_pages()
    return grow(np.concatenate([x for x, _ in pages]), np.concatenate([y for _, y in pages]))


def classify(x: np.ndarray, node=None) -> np.ndarray:
    """1 for each row of features that the tree takes for main text."""
    node = tree() if node is None else node
    if isinstance(node, int):
        return np.full(len(x), node)
    f, cut, lower, upper = node
    low = x[:, f] < cut
    out = np.empty(len(x), int)
    out[low], out[~low] = classify(x[low], lower), classify(x[~low], upper)
    return out


def main_text(html: str | None) -> str:
    """Blocks of main text in page order, one per line; empty for null and for pages without any."""
    found = blocks(html or "")
    return "\n".join(b.text for b, good in zip(found, classify(features(found)), strict=True) if good) if found else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row; repeated rows are treated alike, other columns are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                text = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
