"""Operator 4 with a fitted model on shapes of real pages: names, roles, forms and headings around and beside articles."""

import pytest

from scoreloom.llm import html_extract

TEXT = [
    "The council voted on Monday to rebuild the old bridge, which had been closed to all traffic since the flood of last spring.",
    "Engineers said that the work would take about two years, and that a ferry would run in the meantime for those who live on the far bank.",
    "Residents had asked for a decision since May. The mayor thanked them for their patience and promised that the road would open first.",
    "Costs are put at nine million, of which the state will pay a third.",
]
ART = "".join(f"<p>{x}</p>" for x in TEXT)
NAV, FOOT = '<nav><a href="1">Home</a> <a href="2">News</a> <a href="3">Sport</a></nav>', "<footer>Copyright 2024 The Daily</footer>"
READERS = "<p>I do not agree with this at all, the old bridge was better and cheaper to keep.</p><p>Nice read, thank you for this article about our bridge.</p>"
ABOUT = "<h3>About us</h3><p>We are a small newspaper that has served this town since 1901, with news from all over the county.</p>"
LONG_READERS = "".join(f"<p>Reader number {i} wrote that this bridge was always a problem and that nobody in the town wanted to pay for it.</p>" for i in range(20))
HEADED = {"h1 share": "Share prices fall", "h1 comment": "Comment on the war", "h1 related": "Related families meet again", "h2 newsletter": "Newsletter writers unite"}
SHAPES = {
    "tag class": f'{NAV}<div class="entry tag-consent category-cookies">{ART}</div>{FOOT}',
    "theme wrapper": f'{NAV}<div class="page footer-sticky">{ART}</div>{FOOT}',
    "layout wrapper": f'{NAV}<div class="sidebar-left layout">{ART}</div>{FOOT}',
    "nested wrappers": f'<div id="widget-page"><div class="comments-open post-1">{NAV}{ART}{FOOT}</div></div>',
    "page-wide form": f"<form>{NAV}{ART}{FOOT}</form>",
    "form with state": f'<form id="aspnetForm"><input type="hidden" value="x">{NAV}<div class="content">{ART}</div>{FOOT}</form>',
    "form beside": f'{NAV}<div>{ART}</div><form><p>Write to us with your name and your address, and we will send you our paper every week.</p><input></form>{FOOT}',
    "notice by role": f'<div role="alert">We use cookies on this site to give you the best experience, please accept them.</div>{NAV}<div>{ART}</div>{FOOT}',
    "status by role": f'{NAV}<div>{ART}</div><div role="status">You are offline now, and what you see may be older than it seems to be.</div>{FOOT}',
    "cookie class": f'<div class="cookie-bar"><p>We use cookies on this site to give you the best experience, please accept them all.</p></div>{NAV}<div>{ART}</div>{FOOT}',
    "counted comments": f"<article>{ART}<h2>12 comments</h2><div>{READERS}</div></article>",
    "comments in brackets": f"<article>{ART}<h3>Comments (3)</h3><ul><li>{READERS}</li></ul></article>",
    "leave a comment": f"{NAV}<main>{ART}<h3>Leave a comment</h3>{READERS}</main>{FOOT}",
    "each comment an article": f'{NAV}<article>{ART}</article><section class="comments"><article>{READERS}</article></section>{FOOT}',
    "more comments than article": f'{NAV}<div>{ART}</div><div class="comments">{LONG_READERS}</div>{FOOT}',
    "wrapper of both": f'<div class="layout sidebar"><div class="post">{ART}</div><div id="disqus_thread">{LONG_READERS}</div></div>',
    "sidebar beside": f'{NAV}<div id="wrap"><div class="post">{ART}</div><div class="sidebar">{ABOUT}</div></div>{FOOT}',
    "article in aside": f"{NAV}<aside>{ART}</aside>{FOOT}",
    "aside beside": f"{NAV}<div>{ART}</div><aside>{ABOUT}</aside>{FOOT}",
    "ad-free theme": f'<body class="no-sidebar has-ads"><div class="ad-free-theme">{NAV}{ART}{FOOT}</div></body>',
    "search page": f'{NAV}<div class="search-results-page"><div class="text">{ART}</div></div>{FOOT}',
    "modal app": f'<div class="modal-open overlay">{NAV}<div>{ART}</div>{FOOT}</div>',
    "related below": f"{NAV}<div><div>{ART}</div><h3>Related articles</h3><ul><li><a href=1>Another bridge is closed</a></li><li><a href=2>Ferry runs late again</a></li></ul></div>{FOOT}",
}


@pytest.fixture(scope="module")
def model(spark, sf):
    return html_extract.fit(spark.read.parquet(f"{sf}/pages.parquet"))


@pytest.mark.parametrize("name", SHAPES)
def test_articles_are_kept_and_nothing_else(model, name):
    assert html_extract.main_text(f"<html>{SHAPES[name]}</html>", model).split("\n\n") == TEXT


@pytest.mark.parametrize("name", HEADED)
def test_headings_that_begin_with_a_listed_word(model, name):
    tag = name.split()[0]
    got = html_extract.main_text(f"{NAV}<div><{tag}>{HEADED[name]}</{tag}>{ART}</div>{FOOT}", model).split("\n\n")
    assert [x for x in got if x != HEADED[name]] == TEXT


def test_the_fitted_cut_overrules_a_class_word(model):
    """Alone on a page with another article such a block is boilerplate; among the article's paragraphs the cut keeps it."""
    odd = f'<p class="promo-box">{TEXT[3]}</p>'
    inside = html_extract.blocks(f"<div><p>{TEXT[0]}</p><p>{TEXT[1]}</p>{odd}<p>{TEXT[2]}</p></div>")
    labels = html_extract.minimum_cut(html_extract.costs(inside, model), html_extract.smoothness(inside))
    own = html_extract.minimum_cut(html_extract.costs(inside, model), [])
    assert inside[2].words < 0 and labels == [True] * 4 and own == [True, True, False, True]


def test_headings_say_something_only_as_a_whole():
    says = html_extract.heading_says
    assert says("12 Comments") == says("Leave a comment") == says("Kommentare (4)") == -1.0
    assert says("Related articles") == says("Share this story") == says("Newsletter") == -0.6
    assert says("Share prices fall") == says("Comment on the war") == says("2024") == says("") == says("News") == says("Discussion") == 0.0


def test_pages_without_articles_are_fitted_by_their_cuts(spark):
    told = f"<body>{NAV}<article>{ART}</article>{FOOT}</body>"
    untold = f"<body>{NAV}<div>{ART}{ART}</div><div class=x><a href=1>one</a> <a href=2>two</a></div>{FOOT}</body>"
    few = spark.createDataFrame([(told,)], "html string")
    both = spark.createDataFrame([(told,), (untold,), (None,), ("",)], "html string")
    one, two = html_extract.fit(few), html_extract.fit(both)
    assert not (one.weights == two.weights).all() and html_extract.main_text(untold, two).split("\n\n") == TEXT * 2
    alone = html_extract.fit(spark.createDataFrame([(untold,)], "html string"))
    assert alone is not html_extract.NO_MODEL and html_extract.main_text(untold, alone).split("\n\n") == TEXT * 2
