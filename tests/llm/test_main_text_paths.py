"""Tag-path ratios against a slow reading of them, links around blocks, unclosed parts, deep pages."""

import time
from math import exp, isclose

import pytest

from oppflow.llm import html_text
from oppflow.llm.html_text import blocks, content_paths, main_text

BODY = "<h1>Head of it</h1>" + "".join(f"<p>Paragraph {k}, with marks, and long enough. {'More. ' * 20}</p>" for k in range(6))
WHOLE = main_text(f"<article>{BODY}</article>")


def slow_paths(found, above, threshold, smoothing):
    """The ratios of all paths compared with each other one by one."""
    def tags(path):
        out = []
        while path > 0:
            out.append(path)
            path = above[path]
        return out[::-1]

    ratios = {}
    for path in {b.path for b in found}:
        own = [b for b in found if b.path == path]
        chars = [max(0, len(b.text) - b.linked) for b in own]
        marks = [len(html_text._MARKS.findall(b.text)) * (b.linked < len(b.text)) for b in own]
        ratios[path] = (sum(chars) / len(own), sum(marks) / len(own), sum(chars))
    fused = {}
    for path in ratios:
        total = text = marks = 0.0
        for other, (chars, points, _) in ratios.items():
            mine, theirs = tags(path), tags(other)
            shared = 0
            while shared < min(len(mine), len(theirs)) and mine[shared] == theirs[shared]:
                shared += 1
            weight = exp(-smoothing * (len(mine) - shared) ** 2 / 4)
            total, text, marks = total + weight, text + weight * chars, marks + weight * points
        fused[path] = text / total * (1 + marks / total) ** 0.5
    best = max(fused.values(), default=0.0)
    near = {p for p, v in fused.items() if isclose(v, threshold * best, rel_tol=1e-9)}
    return {p for p, v in fused.items() if v >= threshold * best and ratios[p][2]}, near


def test_pages_table_against_the_slow_reading(spark, sf_dir):
    pages = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    pages += ["text <p>and, more</p> of it", "<div><p>a, b</p><div><p>c</p><ul><li>d e f g</ul></div></div>" * 3]
    for page in pages:
        found, _, above = blocks(page or "")
        for threshold, smoothing in ((0.15, 1.0), (0.5, 0.1)):
            expected, near = slow_paths(found, above, threshold, smoothing)
            assert content_paths(found, above, threshold, smoothing) - near == expected - near


@pytest.mark.parametrize("page,length", [
    ("<div><p>x, y</p>" * 32_000, 32_000), ("<div>" * 200_000 + "<p>deep, down</p>", 1),
    ("<div>" * 50_000 + "<p>deep, down</p>" + "</x>" * 50_000 + "</div>" * 50_000, 1),
    ("<svg>" * 100_000 + "<p>end, here</p>", 1), ("<a href=x><div>" * 50_000 + "</a>", 0),
])
def test_deep_pages_take_linear_time(page, length):
    start = time.time()
    text = main_text(page)
    assert time.time() - start < 6
    assert len(text.split("\n\n")) == length if length else text == ""


def test_unclosed_and_self_closing_parts():
    assert main_text(f"<svg viewBox='0'/><article>{BODY}</article>") == WHOLE
    assert main_text(f"<svg><path d=m /></svg><article>{BODY}</article>") == WHOLE
    assert main_text(f"<noscript><article>{BODY}</article>") == WHOLE
    assert main_text(f"<article>{BODY}</article><script>var x = '<p>no, not this</p>'") == WHOLE


def test_links_around_blocks():
    cards = "".join(f"<a href='/{k}'><div><h3>Teaser {k}</h3><p>Some words, of another text.</p></div></a>" for k in range(4))
    assert main_text(f"<div>{cards}</div><div class=text>{BODY}</div><div>{cards}</div>") == WHOLE
    # An anchor without a target and a link that is never closed end with their element.
    assert main_text(f"<article><a name=top>{BODY}</article>") == WHOLE
    assert main_text(f"<article><p><a href=x>Linked, all of it</p>{BODY}</article>").endswith(WHOLE)


def test_nothing_outside_the_article():
    outside = "<p>Imprint, here. Another sentence, with marks, and about as long as one of the text. More, and more.</p>"
    assert main_text(f"<body><article>{BODY}</article>{outside}</body>") == WHOLE
    assert main_text(f"<body>{outside}<div><article>{BODY}</article></div></body>") == WHOLE
    # Several articles, none with most of the text, all stay.
    several = "".join(f"<article>{BODY}</article>" for _ in range(3))
    assert main_text(several) == "\n\n".join([WHOLE] * 3)
