"""Main text: unusual markup, pages without marks, and the ratios against a plain version."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerspark.llm import html

from .llm_cases import prose

TEXT = prose(1, 60)
MORE = prose(2, 60)

CASES = {
    "head not ended": (f"<html><head><title>x</title><body><p>{TEXT}</p></body>", TEXT),
    "text in a head": (f"<html><head><title>x</title>{TEXT}<p>{MORE}", f"{TEXT}\n{MORE}"),
    "page in a form": (f"<body><form id=aspnetForm><div><h1>Title</h1><p>{TEXT}</p></div></form></body>", f"Title\n{TEXT}"),
    "form beside": (f"<body><div><p>{TEXT}</p><p>{MORE}</p></div><form><p>Mail us your address</p></form>", f"{TEXT}\n{MORE}"),
    "nav not ended": (f"<body><nav><ul><li><a href=x>Home</a></li></ul><div><p>{TEXT}</p><p>{MORE}</p></div></body>", f"{TEXT}\n{MORE}"),
    "nav not ended, article": (f"<nav><ul><li><a href=x>Home</a></ul><article><p>{TEXT}</p></article>", TEXT),
    "articles": ("<body>" + "".join(f"<article><h2>T{k}</h2><p>{prose(k, 50)}</p></article>" for k in range(3)), "\n".join(f"T{k}\n{prose(k, 50)}" for k in range(3))),
    "names in an article": (
        f"<article><h1>T</h1><p>{TEXT}</p><section class=search-methods><h2 id=related-work>Related</h2><p>{MORE}</p></section><p id=social-impact>Last</p></article>",
        f"T\n{TEXT}\nRelated\n{MORE}\nLast",
    ),
    "comments in an article": (f"<article><p>{TEXT}</p><section class='comment-list'><article class=comment><p>{MORE}</p></article></section></article>", TEXT),
    "small article": ("<nav><ul><li><a>A</a><li><a>B</a></ul></nav><article><p>Hi.</p></article><footer>All rights reserved by us, always</footer>", "Hi."),
    "related beside": (f"<main><p>{TEXT}</p></main><div class=related-posts><p>{MORE}</p></div>", TEXT),
    "one line": ("<p>Hello", "Hello"),
    "ends in a script": (f"<article><p>{TEXT}</p><script>var a = '<p>'", TEXT),
}


@pytest.mark.parametrize("name", CASES)
def test_unusual_markup(name):
    page, text = CASES[name]
    assert html.main_text(page) == text


MENU = "".join(f"<li><a href=/{k}>{prose(k, 1)}</a></li>" for k in range(12))


def unmarked(paragraphs):
    claim = f"<div><p>{prose(77, 20)}</p></div>"
    return f"<body><div><ul>{MENU}</ul></div>{claim}<div><ul>{MENU}</ul></div><div><h1>Title of it</h1>{paragraphs}</div><div><ul>{MENU}</ul></div></body>"


def test_ratios_decide_where_nothing_is_marked(monkeypatch):
    page = unmarked("".join(f"<p>{prose(k, 50)}</p>" for k in range(6)) + "<p>Short.</p>")
    whole = "Title of it\n" + "\n".join(prose(k, 50) for k in range(6)) + "\nShort."
    assert html.main_text(page) == whole
    monkeypatch.setattr(html, "smooth", lambda values, sigma: [1.0] * len(values))
    assert html.main_text(page) != whole


@given(st.lists(st.tuples(st.integers(1, 900), st.integers(0, 9)), min_size=1, max_size=40), st.sampled_from([0.5, 1.0, 2.0]))
@settings(deadline=None)
def test_content_lines_against_a_plain_version(lines, sigma):
    ratios = np.array([n / max(1, t) for n, t in lines])
    place = np.arange(len(lines))
    gap = np.abs(place[:, None] - place[None, :])
    weights = np.where(gap <= max(1, np.ceil(3 * sigma)), np.exp(-(gap**2) / (2 * sigma**2)), 0)
    smoothed = (weights * ratios).sum(1) / weights.sum(1)
    want = smoothed >= smoothed.std()
    got = np.array(html.content_lines([n for n, _ in lines], [t for _, t in lines], sigma))
    sure = np.abs(smoothed - smoothed.std()) > 1e-9
    assert (got == want)[sure].all()


@pytest.mark.parametrize("name, beside", [("comments", True), ("comment-list", True), ("ad_728x90", True), ("adSlot", True), ("search-methods", False), ("social-impact", False), ("related-work", False), ("shadow", False), ("main-content", False), ("page no-sidebar-here", False)])
def test_names_of_parts_beside(name, beside):
    assert html.names_beside(name) == beside


def test_columns_of_any_name(spark):
    frame = spark.createDataFrame([(1, "u", CASES["articles"][0], "x", 5), (None, None, None, "y", 6)], "page_id long, url string, html string, text string, n_chars int")
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in html.extract(frame).collect()}
    assert got == {1: ("u", CASES["articles"][1], len(CASES["articles"][1])), None: (None, "", 0)}
