"""Main text of web pages by tag-path ratios.

Every block of text has a root-to-leaf path of tags.  For each path of a page the text characters
outside links and the punctuation marks are added up and divided by the number of blocks: articles keep
their text in few paths with long, punctuated blocks, navigation spreads little text over many.  A
path's ratios are smoothed with those of paths that share its upper part, fused into one
figure, and the paths above a share of the page's best are content.  All blocks of a content path are
taken, short ones too, and with them every other block below the deepest element that holds them all: tables,
nested lists, quotes and code of the article.  That element is never a paragraph, list or table itself, and
is the article element around it if there is one.  Blocks of nothing but links that lie before
or after the content are only taken from inside an article, main or an element that directly holds content.
Where one article element holds most of the content, nothing outside it is taken.

Elements that say what they are (navigation, footers, forms, scripts, adverts by class name, reader
comments and so on) never enter the sums.  A name does not count on html, body, main and article, nor if it
is negated or qualified (no-sidebar, has-sidebar, share-enabled), and an element that holds most of the page's
text is judged by its ratios whatever its name, unless the page has an article elsewhere; one named for
reader comments has to hold the page's heading, too.

Paths are nodes of a tree that grows with the page, so a page takes time in proportion to its length, however
deep it is; the ratios of paths too far apart to weigh anything in doubles are not visited.

Defined cases: null html is the empty page and gives the empty text; markup that is cut off or not
closed is read as far as it goes; of an element whose text is left out and that has no end tag only the tag is left
out, but for scripts and styles, which last to the end of the page; a link lasts over the blocks inside it, to its
end tag, the next link or the end of the element it began in; a page is one row of one task;
rows that repeat each give a row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import exp

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oppflow.llm.batches import sliced

#: A path is content if its fused ratio is at least this share of the page's best.
THRESHOLD = 0.15
#: How fast the weight of another path falls with the levels it does not share.
SMOOTHING = 1.0

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.S
)
_ATTRIBUTE = re.compile(r"\"[^\"]*\"|'[^']*'|([^\s\"'=/<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)
_MARKS = re.compile(r"[.,;:!?…。，、；：！？]")

RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "xmp"}
#: Without an end tag these last to the end of the page.
CODE = {"script", "style"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr img br".split()
)
OUTSIDE = set("nav footer aside form head menu dialog button select object audio video canvas".split())
NAMED_OUTSIDE = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary "
    "consent contentinfo cookie cookies disclaimer disqus footer gdpr login masthead menu modal nav navbar "
    "navigation newsletter notice notification paywall popup promo promotion related respond search share "
    "sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
READER_COMMENTS = {"comment", "comments", "disqus", "respond"}
#: Elements that no name leaves out.
NEVER_NAMED = {"html", "body", "main", "article"}
#: Before and after a name in the same word: what the page or part has or lacks, not what it is.
QUALIFIES = set("no non not has have with without hide".split())
QUALIFIED = {"enabled", "disabled"}
#: More than this share of the page's text outside links is most of it.
MOST = 2 / 3
#: Parts of an article, never the whole of it.
PARTS = set(
    "p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption colgroup thead tbody tfoot tr td th blockquote pre "
    "figure figcaption address details summary header hgroup hr".split()
)
#: What holds the whole page.
ALL_OF_IT = {"", "html", "body"}
#: An open element of the key is closed by a start tag of the value.
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody"}, "td": {"td", "th", "tr"},
    "th": {"td", "th", "tr"}, "option": {"option"}, "head": {"body"},
}


def _named(value: str) -> set[str]:
    """The names for parts outside the article in a class, id or role."""
    found = set()
    for word in value.lower().split():
        parts = [p for p in re.split(r"[^a-z]+", word) if p]
        if QUALIFIED.isdisjoint(parts[1:]):
            found |= {p for before, p in zip(["", *parts], parts) if p in NAMED_OUTSIDE and before not in QUALIFIES}
    return found


def _is_outside(tag: str, attributes: str, inside_article: bool) -> tuple[bool, set[str]]:
    """Whether an element is left out for its tag or because it is hidden, and the names that would leave it out."""
    if tag in OUTSIDE or (tag == "header" and not inside_article):
        return True, set()
    names: set[str] = set()
    for key, *values in _ATTRIBUTE.findall(attributes) if tag not in ("html", "body") else ():
        key, value = key.lower(), "".join(values)
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return True, set()
        if key == "style" and _NOT_SHOWN.search(value):
            return True, set()
        if key in ("class", "id", "role") and tag not in NEVER_NAMED:
            names |= _named(value)
    return False, names


@dataclass(slots=True)
class Element:
    tag: str
    parent: int  # place in the list of elements; the first one is the page
    names: set[str]
    inside_article: bool
    chars: int = 0  # text outside links
    article_chars: int = 0  # those of them in an article
    heading: bool = False


@dataclass(slots=True)
class Block:
    path: int  # node of the tree of paths
    text: str
    linked: int  # characters inside links
    element: int


def _without_named(found: list[Block], elements: list[Element]) -> list[Block]:
    """The blocks outside elements whose name says that they are not of the article."""
    for e in reversed(elements[1:]):
        above = elements[e.parent]
        above.chars += e.chars
        above.article_chars += e.article_chars
        above.heading |= e.heading
    page, left_out = elements[0], [False]
    for e in elements[1:]:
        kept = not e.names or (
            e.chars > MOST * page.chars and (e.inside_article or e.article_chars == page.article_chars)
            and (e.heading or READER_COMMENTS.isdisjoint(e.names))
        )
        left_out.append(left_out[e.parent] or not kept)
    return [b for b in found if not left_out[b.element]]


def _is_link(attributes: str) -> bool:
    """Whether a start tag ``a`` leads somewhere, as one that only has a name does not."""
    keys = {key.lower() for key, *_ in _ATTRIBUTE.findall(attributes)}
    return "href" in keys or "name" not in keys


def blocks(page: str) -> tuple[list[Block], list[Element], list[int]]:
    """Every block of text outside the elements left out, the elements, parents first, and the parents of the paths."""
    found: list[Block] = []
    elements = [Element("", -1, set(), False)]
    # Open elements that are not inline: tag, whether left out, place, path.
    stack: list[tuple[str, bool, int, int]] = []
    open_tags: Counter[str] = Counter()
    paths: dict[tuple[int, str], int] = {(0, ""): 1}  # text outside all elements has a path of its own
    above = [-1, 0]
    endless: set[str] = set()  # tags of which no end follows
    text: list[str] = []
    linked = link = at = articles = 0  # link: elements open where the open link began, and one
    outside = False

    def close() -> None:
        nonlocal linked
        whole = " ".join(entities.unescape("".join(text)).split())
        if whole:
            here, path = stack[-1][2:] if stack else (0, 1)
            found.append(Block(path, whole, linked, here))
            chars = max(0, len(whole) - linked)
            elements[here].chars += chars
            elements[here].article_chars += chars if articles else 0
            elements[here].heading |= elements[here].tag == "h1"
        text.clear()
        linked = 0

    def pop(count: int) -> None:
        nonlocal outside, articles, link
        for tag, *_ in stack[count:]:
            articles -= tag in ("article", "main")
            open_tags[tag] -= 1
        del stack[count:]
        outside = bool(stack) and stack[-1][1]
        link = link if link <= count + 1 else 0

    while True:
        match = _TOKEN.search(page, at)
        piece = page[at: match.start() if match else len(page)]
        if piece and not outside:
            text.append(piece)
            linked += len(piece) if link else 0
        if not match:
            break
        at, name = match.end(), (match.group(2) or "").lower()
        if not name:
            continue
        ends = match.group(1) == "/"
        if name in RAW and not ends:
            if name == "svg" and match.group(3).endswith("/"):
                continue
            end = None if name in endless else re.compile(rf"</{name}\s*>", re.I).search(page, at)
            if end:
                at = end.end()
            elif name in CODE:
                at = len(page)
            else:
                endless.add(name)
            continue
        if name == "br" and not outside:
            text.append(" ")
        if name in INLINE:
            if name == "a":
                link = 0 if ends or not _is_link(match.group(3)) else len(stack) + 1
            continue
        if not outside:
            close()
        if name in VOID:
            continue
        if ends:
            if open_tags[name]:
                depth = len(stack) - 1
                while stack[depth][0] != name:
                    depth -= 1
                pop(depth)
            continue
        while stack and (stack[-1][0] == "p" or name in CLOSED_BY.get(stack[-1][0], ())):
            pop(len(stack) - 1)
        own, names = (True, set()) if outside else _is_outside(name, match.group(3), articles > 0)
        outside = outside or own
        if not outside:
            elements.append(Element(name, stack[-1][2] if stack else 0, names, articles > 0))
        articles += name in ("article", "main")
        open_tags[name] += 1
        up = stack[-1][3] if stack else 0
        path = paths.setdefault((up, name), len(above))
        if path == len(above):
            above.append(up)
        stack.append((name, outside, len(elements) - 1, path))
    if not outside:
        close()
    return _without_named(found, elements), elements, above


def content_paths(found: list[Block], above: list[int], threshold: float, smoothing: float) -> set[int]:
    """The paths whose smoothed and fused ratios are high enough; ``above`` has the path that each one extends."""
    sums: dict[int, list[float]] = {}
    for block in found:
        s = sums.setdefault(block.path, [0.0, 0.0, 0.0])
        s[0] += max(0, len(block.text) - block.linked)
        s[1] += len(_MARKS.findall(block.text)) if block.linked < len(block.text) else 0
        s[2] += 1
    # Per path: the ratios of the paths at and under it, and how many there are.
    under = [[0.0, 0.0, 0.0] for _ in above]
    for path, (chars, marks, n) in sums.items():
        under[path] = [chars / n, marks / n, 1.0]
    for path in range(len(above) - 1, 0, -1):  # a path comes after the one it extends
        up, own = under[above[path]], under[path]
        for k in range(3):
            up[k] += own[k]
    fused = {}
    for path in sums:
        total = text = marks = 0.0
        closer, apart, at = [0.0, 0.0, 0.0], 0, path
        while at >= 0 and (weight := exp(-smoothing * apart * apart / 4)):
            here = under[at]
            text += weight * (here[0] - closer[0])
            marks += weight * (here[1] - closer[1])
            total += weight * (here[2] - closer[2])
            closer, at, apart = here, above[at], apart + 1
        fused[path] = text / total * (1 + marks / total) ** 0.5
    best = max(fused.values(), default=0.0)
    return {p for p, value in fused.items() if value >= threshold * best and sums[p][0]}


def _in_one_article(found: list[Block], elements: list[Element], chosen: set[int]) -> list[Block]:
    """The blocks of the outermost article element that holds most of the content, or all if none does."""
    article, held, total = [-1] * len(elements), Counter(), 0
    for e in range(1, len(elements)):
        article[e] = article[elements[e].parent]
        if article[e] < 0 and elements[e].tag == "article":
            article[e] = e
    for b in found:
        if b.path in chosen:
            chars = max(0, len(b.text) - b.linked)
            held[article[b.element]] += chars
            total += chars
    for e, chars in held.items():
        if e >= 0 and chars > MOST * total:
            return [b for b in found if article[b.element] == e]
    return found


def article_blocks(found: list[Block], elements: list[Element], chosen: set[int]) -> list[Block]:
    """The blocks of the content paths, and the others of the article around them."""
    found = _in_one_article(found, elements, chosen)
    held, holders = [0] * len(elements), set()
    places = [k for k, b in enumerate(found) if b.path in chosen and b.linked < len(b.text)]
    content = {found[k].element for k in places}
    for e in content:
        held[e] += 1
    for e in range(len(elements) - 1, 0, -1):
        held[elements[e].parent] += held[e]
        if held[e] and e in content:
            holders.add(elements[e].parent if elements[e].tag in PARTS else e)
    if not content:
        return []
    # Of the elements that hold all content the last one is the deepest.
    top = max(e for e in range(len(elements)) if held[e] == len(content))
    while elements[top].tag in PARTS:
        top = elements[top].parent
    around = top
    while around and elements[around].tag != "article":
        around = elements[around].parent
    top = around or top
    whole_page = elements[top].tag in ALL_OF_IT
    # A page without an element around its article: the parts below it that hold content, each with what is in it.
    tops = {top}
    if whole_page and top not in holders:
        tops = set()
        for e in range(1, len(elements)):
            up = elements[e].parent
            if held[e] and elements[e].tag not in ALL_OF_IT and elements[up].tag in ALL_OF_IT:
                tops.add(e)
    # Per element: whether it is in the article, and whether links alone count there.
    inside, with_links = [], []
    for e, element in enumerate(elements):
        up = element.parent
        inside.append(e in tops or (up >= 0 and inside[up]))
        with_links.append(
            (up >= 0 and with_links[up]) or element.tag in ("article", "main")
            or (e in holders and element.tag not in ALL_OF_IT)
        )
    return [
        b for k, b in enumerate(found) if b.path in chosen or (
            inside[b.element] and (b.linked < len(b.text) or with_links[b.element] or places[0] < k < places[-1]))
    ]


def main_text(page: str, threshold: float = THRESHOLD, smoothing: float = SMOOTHING) -> str:
    """The content blocks in page order, with an empty line between them."""
    found, elements, above = blocks(page)
    chosen = content_paths(found, above, threshold, smoothing)
    return "\n\n".join(block.text for block in article_blocks(found, elements, chosen))


def extract_text(
    df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    threshold: float = THRESHOLD, smoothing: float = SMOOTHING,
) -> DataFrame:
    """One row per page: ``id_col, url_col, text, n_chars``."""
    kinds = dict(df.dtypes)

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in sliced(batches):
            texts = [main_text(page, threshold, smoothing) for page in batch.pop("_html")]
            yield batch.assign(text=texts, n_chars=[len(t) for t in texts])

    pages = df.select(
        F.col(f"`{id_col}`").alias("_id"), F.col(f"`{url_col}`").alias("_url"),
        F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("_html"),
    )
    out = f"_id {kinds[id_col]}, _url {kinds[url_col]}, text string, n_chars long"
    return pages.mapInPandas(extract, out).withColumnsRenamed({"_id": id_col, "_url": url_col})
