"""Density decides: wrappers and parts of class names don't lose an article."""

import random

import pytest

from svcops.llm import html_text as H
from svcops.llm.common import read
from tests.llm.helpers import clashing, prose

STOP = frozenset("the of and".split())
ONE = ("the quick of and " * 20).strip()
TWO = ("a slow the of one " * 20).strip()
BOTH = f"<p>{ONE}</p><p>{TWO}</p>"


@pytest.mark.parametrize("page", [
    f'<div class="post type-post tag-spark">{BOTH}</div>',
    f'<div id="content" class="content has-sidebar">{BOTH}</div>',
    f'<div class="page nav-open"><article>{BOTH}</article></div>',
    f'<div id="search-results"><main>{BOTH}</main></div>',
    f'<form id="aspnetForm"><article>{BOTH}</article></form>',
    f'<article><div class="legal">{BOTH}</div></article>',
    f'<article><p data-hidden="1">{ONE}</p><p>{TWO}</p></article>',
    f'<article><div data-hidden="no">{BOTH}</div></article>',
    f'<div class="category-legal post">{BOTH}</div><div class="legal">terms</div>',
    f'<form><div class=nav><div>{BOTH}</div></div></form>',
])
def test_the_article_stays(page):
    assert H.main_text(page, STOP) == f"{ONE}\n{TWO}"


@pytest.mark.parametrize("name", ["comments", "comment-list", "commentlist", "post-comments", "ad", "ad-container", "adsbygoogle", "cookie-notice",
                                  "main-nav", "site-footer", "sidebar-left", "widget", "related-posts", "share-buttons", "newsletter-form"])
def test_named_containers_go(name):
    assert H.main_text(f'<article>{BOTH}<div class="{name}"><p>{ONE}</p></div></article>', STOP) == f"{ONE}\n{TWO}"
    assert H.main_text(f'<article>{BOTH}</article><div id="{name}"><article><p>{ONE}</p></article></div>', STOP).startswith(f"{ONE}\n{TWO}")


@pytest.mark.parametrize("name", ["tag-spark", "has-sidebar", "nav-open", "type-post", "status-publish", "adventure", "searching-page"])
def test_other_names_say_nothing(name):
    assert H.names_no_content(name) == 0


def test_comments_never_come_back():
    page = f'<div class="comments"><article>{BOTH}</article></div>'
    assert H.main_text(page, STOP) == ""
    assert H.main_text(f'<div hidden>{BOTH}</div>', STOP) == ""


def test_formulas_are_text():
    page = f"<article><p>{ONE} <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p><svg><text>logo</text></svg></article>"
    assert H.main_text(page, STOP) == f"{ONE} x=2 holds"


def test_open_blocks_inherit_like_brute_force():
    rng = random.Random(3)
    for _ in range(2000):
        labels = [rng.choice([H.GOOD, H.BAD, H.OPEN, H.OPEN]) for _ in range(rng.randrange(12))]
        lone = rng.choice([H.GOOD, H.BAD])
        want = []
        for i, label in enumerate(labels):
            near = sorted((abs(i - k), -x) for k, x in enumerate(labels) if x != H.OPEN)
            want.append(label if label != H.OPEN else -near[0][1] if near else lone)
        assert H.second_pass(labels, lone) == want


def test_density_decides_the_drivers_pages(spark):
    pages = read(spark, "/root/testdata/sf0.01", "pages")
    stop = H.stop_words(pages)
    decided = total = 0
    for r in pages.select("html").collect():
        for b in H.blocks(r["html"]):
            if b.never < 2:
                total += 1
                decided += not b.heading and H.first_pass(b, b.text(), stop) != H.OPEN
    assert decided > 0.6 * total > 100


def test_long_page_and_other_columns(spark):
    rng = random.Random(4)
    parts = [prose(rng, 40) for _ in range(20_000)]
    rows = [(1, "u", "<article>" + "".join(f"<p>{x}</p>" for x in parts) + "</article>"), (2, None, "<div>" * 5000 + ONE), (3, "u", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in H.extract(clashing(df), id_col="doc_id").collect()}
    assert got == {1: "\n".join(parts), 2: ONE, 3: ""}
