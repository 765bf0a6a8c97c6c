"""Class names are hints: articles inside containers that only speak of side parts stay whole."""

import time

import pytest

from marketloom.llm.html_text import main_text

PROSE = "A long enough paragraph of the article, with some commas, and with words that go on for quite a while, as articles do. " * 2
BODY = f"<h1>Title</h1><p>{PROSE}one</p><p>{PROSE}two</p>"
WANTED = f"Title\n{PROSE}one\n{PROSE}two"


@pytest.mark.parametrize(
    "page",
    [
        f'<div class="site has-sidebar"><article>{BODY}</article></div>',
        f'<div class="content-sidebar-wrap"><main>{BODY}</main></div>',
        f'<div class="entry-content no-comments">{BODY}</div>',
        f'<div class="sidebar widget"><article>{BODY}</article></div>',
        f'<div id="comments">{BODY}</div>',
        f'<body><h1>Title</h1><div class="content"><p>{PROSE}one</p><p>{PROSE}two</p></div><p>Imprint</p></body>',
    ],
)
def test_articles_in_containers_with_odd_names(page):
    assert main_text(page) == WANTED.strip()


def test_parts_inside_an_article_go_by_whole_names():
    price = "<section class=\"share-price\"><h2>Price</h2><p>It rose, then fell.</p></section>"
    assert main_text(f"<article>{BODY}{price}</article>") == WANTED.strip() + "\nPrice\nIt rose, then fell."
    for name in ("share-buttons", "site-footer", "social-share", "sidebar", "comment-list", "related-posts", "cookie-banner", "ad"):
        gone = f'<div class="{name}"><p>{PROSE}never</p></div>'
        assert main_text(f"<article>{BODY}{gone}</article>") == WANTED.strip(), name


def test_comments_with_articles_of_their_own_go():
    comment = f'<article class="comment"><p>{PROSE}{PROSE}{PROSE}reader</p></article>'
    page = f'<main><article>{BODY}</article><div id="comments" class="comments-area">{comment * 3}</div></main>'
    assert main_text(page) == WANTED.strip()


def test_formulas_stay():
    assert main_text(f"<article>{BODY}<p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> here.</p></article>").endswith("So x=2 here.")


@pytest.mark.parametrize("part", ["<a '", "<a \"", '<a b="', "<div>", "</div>", "<", "<!", "<li>", "<p", "= \"", "<a =", "</x><div>"])
def test_time_is_linear_in_broken_markup(part):
    start = time.process_time()
    main_text(part * (300_000 // len(part)))
    main_text(part * (300_000 // len(part)) + '<p =">">')
    assert time.process_time() - start < 6
