"""Main text of pages: the tree, pages that went wrong before, held-out pages, odd tables."""

from __future__ import annotations

import time

import numpy as np
import pytest

from spendwarden.llm import html_blocks
from spendwarden.llm.html_blocks import main_text

STORY = "The council met on Monday and agreed to pay for the new bridge over the river. " * 3
PARA = "Masons had asked for years to have the old one taken down before the winter came. " * 2


def splits(node):
    return set() if isinstance(node, int) else {html_blocks.FEATURES[node[0]]} | splits(node[2]) | splits(node[3])


# pages without telling elements: (label, text, is link)
HELD_OUT = [
    [(0, 2, 1), (0, 1, 1), (0, 3, 1), (1, 8, 0), (1, 55, 0), (1, 1, 0), (1, 47, 0), (1, 26, 0), (0, 4, 0), (0, 2, 1), (0, 2, 1)],
    [(0, 1, 1), (0, 1, 1), (1, 95, 0), (1, 4, 0), (1, 61, 0), (0, 7, 1), (0, 9, 1), (0, 6, 0)],
    [(0, 5, 0), (0, 3, 1), (1, 12, 0), (1, 30, 0), (1, 44, 0), (1, 2, 0), (1, 88, 0), (0, 3, 0), (0, 5, 1), (0, 4, 1), (0, 4, 0)],
    [(1, 33, 0), (1, 21, 0), (1, 70, 0)],
    [(0, 2, 1), (0, 6, 0), (0, 4, 1), (0, 5, 0), (0, 3, 1)],
]


def page_of(rows):
    return "".join(f"<div><a>{' '.join(['w'] * n)}</a></div>" if link else f"<p>{' '.join(['w'] * n)}</p>" for _, n, link in rows)


def right(change=lambda x: x):
    good = total = 0
    for rows in HELD_OUT:
        x = change(html_blocks.features(html_blocks.blocks(page_of(rows))))
        good += (html_blocks.classify(x) == [r[0] for r in rows]).sum()
        total += len(rows)
    return good / total


def test_neighbours_decide():
    assert splits(html_blocks.tree()) >= {"words", "links", "words after", "links after"}

    def alone(x):
        x = x.copy()
        x[:, 3:] = 0
        return x

    assert right() >= 0.9 and right(alone) < right() - 0.05
    word = "<p>w</p>"
    long = f"<p>{STORY}</p>"
    assert main_text(long + word + long).split("\n")[1] == "w" and "w" not in main_text(f"<p>w</p><div><a>{STORY}</a></div>").split("\n")


def test_labelled_pages_left_out_one_by_one():
    pages = html_blocks.labelled_pages()
    good = total = 0
    for i, (x, y) in enumerate(pages):
        rest = [p for j, p in enumerate(pages) if j != i]
        grown = html_blocks.grow(np.concatenate([p[0] for p in rest]), np.concatenate([p[1] for p in rest]))
        good += (html_blocks.classify(x, grown) == y).sum()
        total += len(y)
    assert total > 200 and good / total > 0.95


@pytest.mark.parametrize("page, want", [
    ("<article><p>Short news today.</p></article><section class='comments'><article>comment</article></section>", "Short news today."),
    (f"<article><p>Short news today.</p></article><section class='comment-list'><article>{STORY}</article></section>", "Short news today."),
    ("<div class='sidebar'><article>teaser</article></div><article>story</article>", "story"),
    (f"<article><p>story told</p></article><div class='sidebar'><article>{STORY}</article></div>", "story told"),
    ("<article><p>one two</p><p><a href=x>all of it a link</a></p><ul><li><a>first source</a><li><a>second source</a></ul></article>", "one two\nall of it a link\nfirst source\nsecond source"),
    (f"<div class='social-history'><p>{STORY}</p><p>{PARA}</p></div>", f"{STORY.strip()}\n{PARA.strip()}"),
    ("<article><p>let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be</p></article>", "let x=1 be"),
    (f"<form id=aspnet><div class=menu><a>x</a></div><p>{STORY}</p><p>{PARA}</p></form>", f"{STORY.strip()}\n{PARA.strip()}"),
    (f"<div class='post widget'><article>{STORY}</article></div><div class='widget'><article>teaser</article></div>", STORY.strip()),
    (f"<main><h1>Title</h1><div class='widget'><article><p>{STORY}</p></article></div></main>", f"Title\n{STORY.strip()}"),
    ("<article>a<nav>b</nav><footer>c</footer><aside>d</aside><div class='share-buttons'>e</div><form>f</form><div class='cookieNotice'>g</div>h</article>", "a\nh"),
    ("<header>x</header><article><header><h1>T</h1></header><p>y</p></article>", "T\ny"),
])
def test_pages(page, want):
    assert main_text(page) == want


def test_names():
    for name in ("sidebar", "ad", "ad-slot", "comments_list", "related-posts", "cookieNotice", "nav-bar", "social-links", "site-footer"):
        assert html_blocks.is_hint(name), name
    for name in ("social-history", "with-sidebar", "no-comments", "address", "header-story", "adult", "post", "content", "", "---"):
        assert not html_blocks.is_hint(name), name


def test_depth_costs_nothing():
    def seconds(n):
        start = time.process_time()
        assert main_text("<div class=ad>" + "<div>a" * n + "</div>" * n + "</div>" + "<p>x</b></i>" * n) is not None
        return time.process_time() - start

    seconds(1000)
    assert seconds(40_000) < 16 * max(seconds(5_000), 0.05)


def test_odd_pages_as_table(spark):
    long = f"<article>{'<p>' + STORY + '</p>'}" * 1 + "<article>" + f"<p>{STORY}</p>" * 3000 + "</article>"
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<article>x</article>"), (3, "u", "<article>x</article>"), (None, "v", "plain"), (4, "u", long), (5, "u", "<p>" + "a " * 5), (6, "u", "\x00<<<>&#x41;&bogus;</")]
    pages = spark.createDataFrame([(i, u, h, "t", 7, "k") for i, u, h in rows], "page_id bigint, url string, html string, text string, n_chars bigint, region string")
    got = html_blocks.extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == 8
    by = {r["page_id"]: r for r in got.collect()}
    assert by[1]["text"] == by[2]["text"] == "" and by[3]["text"] == "x" and by[4]["n_chars"] == len(by[4]["text"]) > 3000 * len(STORY.strip())
    assert [r["text"] for r in got.where("page_id = 3").collect()] == ["x", "x"] and by[None]["url"] == "v"
    assert html_blocks.extract(pages.limit(0)).count() == 0
