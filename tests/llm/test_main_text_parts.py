"""Short parts of an article, deep below it: tables, nested lists, quotes, code."""

import pytest

from oppflow.llm.html_text import main_text

LONG = "".join(f"<p>{f'Paragraph {k} of the text, with marks. ' * 11}</p>" for k in range(10))
TABLE = "<table><tbody>" + "".join(f"<tr><td>cell {k} left</td><td>cell {k} right</td></tr>" for k in range(4)) + "</tbody></table>"
LISTS = "<ul><li>outer one<ul><li>nested item of twenty</li><li>nested again</li></ul></li><li>outer two</li></ul>"
QUOTE = "<blockquote><div><div><p>Said so</p></div></div></blockquote>"
CODE = "<figure><div><div><pre><code>x = 1</code></pre></div></div><figcaption>Listing 1</figcaption></figure>"
SOURCES = "<ul><li><a href=1>Source one</a></li><li><a href=2>Source two</a></li></ul>"
PARTS = [f"cell {k} {side}" for k in range(4) for side in ("left", "right")] + [
    "outer one", "nested item of twenty", "nested again", "outer two", "Said so", "x = 1", "Listing 1"]
NAV = "<ul><li><a href=/>Home page</a></li><li><a href=/b>All of the news</a></li></ul>"


def lines(page):
    return main_text(page).split("\n\n")


@pytest.mark.parametrize("before,after", [
    ("<article>", "</article>"),
    ("<div><div><article><div>", "</div></article></div></div>"),
    (f"<html><body><div><div>{NAV}</div></div><div class=text>", f"</div><div><div>{NAV}</div></div></body></html>"),
    (f"<html><body><div>{NAV}</div>", f"<div>{NAV}</div></body></html>"),
    (f"<div>{NAV}</div>", f"<div>{NAV}</div>"),
    (f"<nav>{NAV}</nav><main>", "</main><footer><p>Imprint, here.</p></footer>"),
])
def test_short_parts_are_kept(before, after):
    got = lines(f"{before}<h1>Head</h1>{LONG}{TABLE}{LISTS}{QUOTE}{CODE}{after}")
    assert got[0] == "Head" and len(got) == 11 + len(PARTS) and got[11:] == PARTS


def test_parts_in_the_middle_and_sources_at_the_end():
    got = lines(f"<div>{NAV}</div><div><h1>Head</h1>{LONG}{TABLE}{LONG}{SOURCES}</div><div>{NAV}</div>")
    assert got[11:19] == PARTS[:8] and got[-2:] == ["Source one", "Source two"] and len(got) == 31
    assert lines(f"<article>{LONG}<section><div>{SOURCES}</div></section></article>")[10:] == ["Source one", "Source two"]


def test_article_around_its_body():
    page = f"<article><div><h2>Before</h2></div><div><div><div>{LONG}</div></div></div><div><div><div>{TABLE}</div></div></div></article>"
    got = lines(page)
    assert got[0] == "Before" and got[11:] == PARTS[:8]


def test_one_paragraph_and_its_table():
    assert lines(f"<div>{NAV}</div><div><p>{'Only one, but long. ' * 40}</p>{TABLE}</div>")[1:] == PARTS[:8]


def test_left_out_below_the_article():
    page = f"<article><h1>Head</h1>{LONG}<aside><p>Side</p></aside><div class=share><p>Share</p></div>{TABLE}</article>"
    assert lines(page)[11:] == PARTS[:8]


def test_link_lists_beside_the_article_stay_out():
    page = f"<div><div>{NAV}</div><div>{LONG}</div><div>{NAV}</div></div>"
    assert len(lines(page)) == 10
