"""Main text of web pages from parser events and the text-to-tag ratio of their lines.

The standard library's streaming parser gives events; blocks of text are the page's lines. Ratios of text to tags are smoothed with a
Gaussian over neighbouring lines, and a threshold splits them into content and the rest. The elements that hold the content make the
article: lines beside content in the same container belong to it, other containers do not. Marks help: what menus, adverts and the like hold is
left out unless the content lies in there, and an ``article`` or ``main`` that holds most of the content is taken whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title "
    "tr ul".split()
)
# Elements without text of the page, those beside the article, elements that may stand in a head.
NEVER = frozenset("title script style template noscript iframe object svg math canvas audio video button select textarea input".split())
BESIDE = frozenset("nav aside footer form dialog menu".split())
HEAD = frozenset("head title meta link script style base noscript template".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar alertdialog".split())
# Words of class and id attributes that name parts beside the article.
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription sidebar widget widgets related "
    "recommended share sharing social comment comments disqus reply replies respond breadcrumb breadcrumbs nav navbar navigation menu "
    "menus footer masthead pagination pager login signin search toolbar skip paywall".split()
)
# Words that may stand beside those: a name of any other word as well, such as search-methods, is not of that kind.
SHAPES = frozenset(
    "area article articles bar block body bottom box button buttons center container content count desktop div footer form group header "
    "icon icons inner item items label left link links list main media message mobile outer page panel post posts right row section slot "
    "small story stories text thread title top unit wrap wrapper".split()
)
HOLDERS = frozenset(["article", "main"])
#: Elements that hold a line or a part of one; their lines belong to the container around.
SMALL = frozenset(
    "p b i em strong span a h1 h2 h3 h4 h5 h6 li td th tr tbody thead tfoot table ul ol dl dt dd blockquote pre code br figure figcaption "
    "caption center font small sub sup u s cite q abbr time mark label details summary address hr option legend".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z0-9])(?=[A-Z])")
_BLANK = re.compile(r"\s+")


class Element:
    """An element of the page as far as it matters: its kind, whether it was ended, whether a block stands in it."""

    __slots__ = ("name", "parent", "beside", "tag_marked", "ended", "has_block")

    def __init__(self, name: str, parent: Element | None, beside: bool, tag_marked: bool):
        self.name, self.parent, self.beside, self.tag_marked = name, parent, beside, tag_marked
        self.ended = self.has_block = False

    def chain(self) -> Iterator[Element]:
        at: Element | None = self
        while at is not None:
            yield at
            at = at.parent


def names_beside(value: str) -> bool:
    """Whether a class or id has a name of listed words, alone or with words of shape and numbers."""
    for name in value.split():
        words = [w.lower() for w in _SPLIT.split(name) if w]
        if any(w in WORDS for w in words) and all(w in WORDS or w in SHAPES or len(w) == 1 or w[0].isdigit() for w in words):
            return True
    return False


class _Blocks(HTMLParser):
    """Blocks of text in page order: ``(text parts, [tags], element)``; text and tags in elements without page text are dropped."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.page = Element("", None, False, False)
        #: Open elements, and whether text in there is none of the page's.
        self.open: list[tuple[Element, bool]] = [(self.page, False)]
        self.blocks: list[tuple[list[str], list[int], Element]] = []
        self.text: list[str] = []
        self.tags = 0

    def _end_block(self) -> None:
        if self.text:
            self.blocks.append((self.text, [self.tags], self.open[-1][0]))
            self.text = []
        elif self.blocks:
            self.blocks[-1][1][0] += self.tags
        self.tags = 0

    def _leave_head(self) -> None:
        """A head ends with the first thing that cannot stand in it; its end tag may be left out."""
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at][0].name == "head":
                del self.open[at:]
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in HEAD and tag != "html":
            self._leave_head()
        if tag in BLOCK:
            self._end_block()
            if tag == "p" or tag == "li":
                self._close_open(tag)
            self.open[-1][0].has_block = True
        out = self.open[-1][1] or tag in NEVER or self._hidden(attrs)
        self.tags += not out
        if tag in VOID:
            return
        self.open.append((self._element(tag, attrs), out))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self._end_block()
        self.tags += not self.open[-1][1]

    def _close_open(self, tag: str) -> None:
        """A new paragraph or item ends an open one of the same block: its end tag may be left out."""
        stop = {"ul", "ol", "menu"} if tag == "li" else BLOCK - {"p"}
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at][0].name == tag:
                del self.open[at:]
                return
            if self.open[at][0].name in stop:
                return

    @staticmethod
    def _hidden(attrs: list[tuple[str, str | None]]) -> bool:
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return True
            if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", (value or "").lower()):
                return True
        return False

    def _element(self, tag: str, attrs: list[tuple[str, str | None]]) -> Element:
        parent = self.open[-1][0]
        inside = any(e.name in HOLDERS for e in parent.chain())
        by_tag = tag in BESIDE or tag == "header" and not inside
        by_name = tag not in SMALL - {"ul", "ol", "table"} and tag not in ("html", "body") and (tag not in HOLDERS or inside)
        named = any(
            name == "role" and (value or "").lower() in ROLES or by_name and name in ("class", "id") and names_beside(value or "")
            for name, value in attrs
        )
        return Element(tag, parent, by_tag or named, by_tag and tag != "form")

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self._end_block()
        self.tags += not self.open[-1][1]
        if tag in VOID:
            return
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at][0].name == tag:
                self.open[at][0].ended = True
                del self.open[at:]
                break

    def handle_data(self, data: str) -> None:
        if not data.isspace():
            if self.open[-1][0].name == "head":
                self._leave_head()
            if not self.open[-1][1]:
                self.text.append(data)
        elif self.text and not self.open[-1][1]:
            self.text.append(data)


def smooth(values: list[float], sigma: float) -> list[float]:
    """Gaussian moving average; weights beyond the ends of the page are left out and the rest scaled up."""
    reach = max(1, math.ceil(3 * sigma))
    weights = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        low, high = max(0, i - reach), min(len(values), i + reach + 1)
        own = weights[low - i + reach : high - i + reach]
        out.append(sum(w * v for w, v in zip(own, values[low:high], strict=True)) / sum(own))
    return out


def content_lines(lengths: list[int], tags: list[int], sigma: float) -> list[bool]:
    """Which lines are content: those whose smoothed ratio of text to tags is no less than the standard deviation of all."""
    ratios = smooth([n / max(1, t) for n, t in zip(lengths, tags, strict=True)], sigma)
    mean = sum(ratios) / len(ratios)
    threshold = math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios))
    return [r >= threshold for r in ratios]


#: A line: its text, the tags before it, its element, and whether it is content.
Line = tuple[str, int, Element, bool]
#: Share of the content that the innermost element around an unmarked article holds, and least ratio of a container to that of the whole.
ROOT_SHARE, LEAST_RATIO = 0.9, 0.25


def masses(lines: list[Line]) -> dict[Element, int]:
    """Letters of content in each element."""
    mass: dict[Element, int] = {}
    for text, _, at, chosen in lines:
        if chosen:
            for e in at.chain():
                mass[e] = mass.get(e, 0) + len(text)
    return mass


def without_parts_beside(lines: list[Line], mass: dict[Element, int], page: Element) -> list[Line]:
    """Lines outside of menus, adverts and so on.

    Such an element is only a wrapper, and not left out, if an ``article`` or ``main`` with content stands in it; or without one on the page, if it
    is a form, a named part, or was never ended, and holds half of the content.
    """
    around = {e for holder in mass if holder.name in HOLDERS for e in holder.chain() if e is not holder}
    marked = any(e.name in HOLDERS for e in mass)

    def wraps(e: Element) -> bool:
        if marked:
            return e in around
        return not (e.tag_marked and e.ended) and 2 * mass.get(e, 0) >= mass.get(page, 0) > 0

    return [x for x in lines if all(not e.beside or wraps(e) for e in x[2].chain())]


def region(lines: list[Line], page: Element) -> list[Line]:
    """The lines of the article."""
    mass = masses(lines)
    total = mass.get(page, 0)
    holders = [e for e in mass if e.name in HOLDERS]
    inner: dict[Element, int] = {}
    for e in holders:
        for up in e.chain():
            if up is not e and up.name in HOLDERS:
                inner[up] = inner.get(up, 0) + mass[e]
                break
    # All articles with content; a holder around them only if most of its content is not in theirs.
    roots = {e for e in holders if 2 * inner.get(e, 0) < mass[e]}
    if 2 * sum(mass[e] for e in roots if not any(up in roots for up in e.chain() if up is not e)) < total or not roots:
        roots = set()
        marked = {up for x in lines for up in x[2].chain() if up.name in HOLDERS}
        if not total and marked:
            roots = marked
    if roots:
        return [x for x in lines if any(e in roots for e in x[2].chain())]
    wide = [e for e in mass if mass[e] >= ROOT_SHARE * total]
    root = max(wide, key=lambda e: sum(1 for _ in e.chain()), default=page)
    while root.name in SMALL and root.parent is not None:
        root = root.parent

    def container(at: Element) -> Element:
        for e in at.chain():
            if e is root or e.name not in SMALL or e.name == "td" and e.has_block:
                return e
        return root

    inside = [x for x in lines if any(e is root for e in x[2].chain())]
    held: dict[Element, list[Line]] = {}
    for x in inside:
        held.setdefault(container(x[2]), []).append(x)

    def ratio(some: list[Line]) -> float:
        return sum(len(x[0]) for x in some) / max(1, sum(x[1] for x in some))

    least = LEAST_RATIO * ratio([x for x in inside if x[3]])
    kept = set()
    for e, own in held.items():
        heads = all(any(up.name in HEADINGS for up in x[2].chain()) for x in own)
        if any(x[3] for x in own) and (e is root or heads or ratio(own) >= least):
            kept.add(e)
    return [x for x in inside if container(x[2]) in kept]


def main_text(page: str, sigma: float = 1.0) -> str:
    """Article text of one page: blocks in page order, joined by line feeds; empty if there is none."""
    parser = _Blocks()
    parser.feed(page)
    parser.close()
    parser._end_block()
    found = [(text, tags[0], at) for parts, tags, at in parser.blocks if (text := _BLANK.sub(" ", "".join(parts)).strip())]
    if not found:
        return ""
    chosen = content_lines([len(x[0]) for x in found], [x[1] for x in found], sigma)
    lines = [(*x, c) for x, c in zip(found, chosen, strict=True)]
    own = without_parts_beside(lines, masses(lines), parser.page)
    return "\n".join(x[0] for x in region(own, parser.page))


def extract(pages: DataFrame, sigma: float = 1.0) -> DataFrame:
    """``(page_id, url, text, n_chars)``, one row per row of ``pages``; whole html is read.

    Null or empty html, and pages without article text, give an empty text; an empty table gives no rows. Rows repeated whole get equal
    answers; null ids and urls are kept. Very long pages are read to their end. Of elements that hold equally much the innermost is the
    article. Columns of ``pages`` other than page_id, url and html are not read, so they may have any name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html.as_py() or "", sigma) for html in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"]
            )

    kind = dict(pages.dtypes)
    rows = pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind['page_id']}, url string, text string")
    return rows.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
