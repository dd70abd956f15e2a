"""Names and hidden parts: what may leave out an element of a page, and what may not."""

import pytest

from oppflow.llm.html_text import main_text

BODY = "<h1>Head of it</h1>" + "".join(f"<p>Paragraph {k}, with marks, and long enough to be of an article. {'More. ' * 20}</p>" for k in range(6))
WHOLE = main_text(BODY)


@pytest.mark.parametrize("page", [
    f'<html class="js cookie"><body class="single no-sidebar">{BODY}</body></html>',
    f'<body class="home search modal-open comments">{BODY}</body>',
    f'<body style="display: none">{BODY}</body>',
    f'<div class="layout has-sidebar">{BODY}</div>',
    f'<div id="with_menu">{BODY}</div>',
    f'<div class="post share-enabled">{BODY}</div>',
    f'<article class="post share-enabled">{BODY}</article>',
    f'<main id="search" class="widget">{BODY}</main>',
    f'<section data-title="the hidden cost">{BODY}</section>',
    f'<section title="hidden" data-style="display:none" alt=\' aria-hidden="true" \'>{BODY}</section>',
    f'<section title="a"" hidden ">{BODY}</section>',
    f'<section aria-hidden="false" style="display:block">{BODY}</section>',
    f'<div class="text widget">{BODY}</div><div class="widget"><p>Other, short.</p></div>',
    f'<div class="comments">{BODY}</div>',
    f'<div class="modal"><div id="promo">{BODY}<div class="share"><p>Share it, now.</p></div></div></div>',
    f'<main><div class="promo">{BODY}</div></main>',
])
def test_article_is_kept(page):
    assert WHOLE.count("\n\n") == 6 and main_text(page) == WHOLE


LONG = "".join(f"<p>Other text {k}, with marks, and longer than all of the article. {'More. ' * 90}</p>" for k in range(6))


@pytest.mark.parametrize("outside", [
    '<section hidden><p>Not shown, at all.</p></section>',
    '<section class=x hidden="hidden"><p>Not shown, at all.</p></section>',
    '<section aria-hidden=true><p>Not shown, at all.</p></section>',
    "<section style='color:red; display : none'><p>Not shown, at all.</p></section>",
    '<div class="sidebar"><p>Side, of it.</p></div>',
    '<div class="no-js sidebar"><p>Side, of it.</p></div>',
    '<div role="search"><p>Search, here.</p></div>',
    f'<div id="comments">{LONG}</div>',
    f'<div class="disclaimer">{LONG}</div>',
])
def test_other_parts_stay_out(outside):
    assert main_text(f"<article>{BODY}</article>{outside}") == WHOLE


def test_long_comments_stay_out_without_an_article_element():
    assert main_text(f"<div>{BODY}</div><div class='comments'>{LONG}</div>") == WHOLE
