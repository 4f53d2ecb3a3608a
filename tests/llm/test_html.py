"""Main text of pages of many shapes: none of an article is lost, and little else comes along."""

from __future__ import annotations

import re
import time

import numpy as np
import pyarrow.parquet as pq
import pytest

from tallywright.llm import html_text

LONG = "A sentence of the article that goes on for quite a few words until it comes to its end here."


@pytest.fixture(scope="module")
def tree():
    return html_text.trained()


@pytest.mark.parametrize(
    ("page", "text"),
    [
        # nothing behind the article
        ("<article><h1>T</h1><p>A</p><p>B</p></article>", "T\nA\nB"),
        (f"<main><h2>T</h2><p>{LONG}</p><ul><li>one</li><li>two</li></ul></main>", f"T\n{LONG}\none\ntwo"),
        (f"<p>{LONG}</p>", LONG),
        # wrappers whose names tell of something else in them
        (f"<div class='has-sidebar site'><article><h1>T</h1><p>{LONG}</p></article></div>", f"T\n{LONG}"),
        (f"<div class='page header-fixed'><article><p>{LONG}</p></article><footer>c</footer></div>", LONG),
        (f"<div class='page header-fixed'><p>{LONG}</p><p>{LONG}</p></div><div>c</div>", f"{LONG}\n{LONG}"),
        (f"<div id='side-by-side'><article><p>{LONG}</p></article></div>", LONG),
        (f"<article class='tag-news comments-open'><p>{LONG}</p></article>", LONG),
        (f"<form id=aspnetForm><nav>x</nav><article><p>{LONG}</p></article></form>", LONG),
        (f"<div class='modal'><article><p>{LONG}</p></article></div>", LONG),
        # the head of an article
        (f"<article><div class='entry-header'><h1>Title</h1></div><p>{LONG}</p></article>", f"Title\n{LONG}"),
        (f"<article><header><h1>Title</h1></header><p>{LONG}</p></article>", f"Title\n{LONG}"),
        # attributes without quotes may hold some
        (f"<article><p title=it's>{LONG}</p><p>Next's</p></article>", f"{LONG}\nNext's"),
        ('<article><p>ok <b class="x>y">b</b> z</p><p a="b"c>d</p></article>', "ok b z\nd"),
        # inline elements in a paragraph stay, hidden ones go, and blocks of nothing else
        (f"<article><p>{LONG} <span class='notice'>Note</span> more</p></article>", f"{LONG} Note more"),
        (f"<article><p>{LONG} <span hidden>gone</span>more</p></article>", f"{LONG} more"),
        (f"<article><p>{LONG}</p><div><span class='ad'>Buy this now</span></div></article>", LONG),
        # what is no part of the article
        (f"<article><p>{LONG}</p><section class='comments'><article class='comment'><p>{LONG} nice</p></article></section></article>", LONG),
        (f"<main><article><p>{LONG}</p></article></main><aside><article><p>{LONG} too</p></article></aside>", LONG),
        (f"<body><header><p>{LONG}</p></header><article><p>B</p></article><footer><p>{LONG}</p></footer>", "B"),
        (f"<article><p>{LONG}</p><div class='ad'>{LONG}</div><form><p>Name</p></form><p>End</p></article>", f"{LONG}\nEnd"),
        (f"<article><p>A</p><div style='display: none'>{LONG}</div></article>", "A"),
        (f"<nav><article><p>{LONG}</p></article></nav>", ""),
        # broken markup
        (f"<article><p>{LONG}<p>B</div></span><p>C</article>", f"{LONG}\nB\nC"),
        (f"<article><p>{LONG}</p><p>B<a href='x", f"{LONG}\nB"),
        ("<article><p>1 < 2 &amp; 3 > 2</p></article>", "1 < 2 & 3 > 2"),
    ],
)
def test_pages(tree, page, text):
    assert html_text.main_text(page, tree) == text


@pytest.mark.parametrize(
    "page",
    [
        "<div>" * 100_000 + "x",
        '<a "' * 30_000,
        '<a x="' * 30_001 + ">",
        "<p><b><i>" * 40_000 + "t",
        "<ul><li>" * 50_000 + "z",
        "<div>" * 50_000 + "</span></div>" * 50_000,
        "<i>" * 30_000 + "<b>" * 30_000 + "</i>" * 30_000,
        "<div class='x-sidebar'>" * 50_000 + "text",
        "<article>" * 30_000 + "<aside>" * 30_000 + "text",
        "<" * 200_000,
    ],
)
def test_pages_of_any_depth_take_little_time(tree, page):
    start = time.process_time()
    html_text.main_text(page, tree)
    assert time.process_time() - start < 20


def test_articles_of_all_pages(tree):
    for html in pq.read_table("/root/testdata/sf0.1/pages.parquet").column("html").to_pylist():
        article = re.search(r"<article>(.*?)</article>", html, re.S)[1]
        blocks = [
            " ".join(html_text.html.unescape(re.sub(r"<[^>]+>", " ", block)).split())
            for block in re.split(r"</?(?:p|h1)>", article)
        ]
        assert html_text.main_text(html, tree) == "\n".join(filter(None, blocks))


def test_the_tree_asks_for_words_links_and_neighbours(tree):
    def asked(node):
        return set() if node.feature < 0 else {html_text.FEATURES[node.feature]} | asked(node.below) | asked(node.above)

    found = asked(tree)
    assert {"words", "link_density"} <= found and found & {"words_before", "words_after", "links_before", "links_after"}


def test_a_short_line_is_judged_by_its_neighbours(tree):
    long = " ".join([LONG] * 3)
    assert html_text.main_text(f"<p>{long}</p><p>So it went.</p><p>{long}</p>", tree) == f"{long}\nSo it went.\n{long}"
    assert html_text.main_text(f"<p>{long}</p><p>{long}</p><p>Sign in</p><p>Terms</p>", tree) == f"{long}\n{long}"


def test_features_are_those_of_the_blocks():
    rows = html_text.features_of(html_text.blocks_of("<p>a b</p><article><li><a>c</a> d e f</li></article>"))
    assert rows.shape == (2, len(html_text.FEATURES))
    assert np.allclose(rows[:, :2], [[2, 0], [4, 0.25]]) and rows[:, 6].tolist() == [0, 1] and rows[1, 11] == 1
