"""The region of the main text against all regions, and that its weights decide."""

import time

from hypothesis import given, settings
from hypothesis import strategies as st

from spanveil.llm import html_extract


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-4, 4), max_size=14))
def test_region_is_the_best_of_all(scores):
    got = html_extract.best_region([float(x) for x in scores])
    best = max((sum(scores[i : j + 1]) for i in range(len(scores)) for j in range(i, len(scores))), default=0)
    assert (best <= 0) if got is None else (sum(scores[got[0] : got[1] + 1]) == best > 0)


LONG = "these words make up the body of the page and there are quite many of them"
#: No marks and no telling names: links first and last, two blocks of text between.
BARE = f"<body><div><a>one</a> <a>two</a> <a>three</a></div><div><p>{LONG}</p><p>Short.</p></div><div><a>four</a> <a>five</a></div></body>"


def test_weights_decide_the_text():
    marked = "<nav><a>home</a> <a>news</a></nav><article><h1>head</h1><p>" + LONG + "</p></article><footer>small print</footer>"
    learned = html_extract.weights_of(html_extract.class_counts(marked))
    assert html_extract.main_text(BARE, learned) == f"{LONG}\nShort." and html_extract.main_text(marked, learned) == f"head\n{LONG}"
    assert html_extract.main_text(BARE, learned | {"link": 1.0}) == f"one two three\n{LONG}\nShort.\nfour five"
    assert html_extract.main_text(BARE, learned | {"tag": -9.0, "tag p": -9.0, "tag /p": -9.0}) == LONG
    assert html_extract.main_text(marked, learned | {"article word": -1.0}) == ""
    assert html_extract.main_text(marked, learned | {"never word": 1.0, "junk tag": -0.1, "beside tag": -0.1}) != f"head\n{LONG}"


def test_broken_markup_takes_linear_time():
    for s in ("<a b" * 50_000, "<b>" * 30_000 + "</i>" * 30_000 + "<p></p>" * 30_000, "<p><a \"" * 30_000, "<a \"'" * 30_000, *(f"<{a}><{b}>" + "<b>" * 30_000 + f"<{a}></{a}>" * 30_000 for a, b in (("dt", "ul"), ("dd", "dl"), ("td", "table"), ("li", "ul"), ("p", "section"))), "<td>" * 60_000, "<li>" * 60_000):
        start = time.process_time()
        html_extract.main_text(s)
        assert time.process_time() - start < 5


def test_pages_edges(spark):
    rows = [(1, None, "r"), (2, "", "r"), (3, "<p>a b</p>", "r"), (3, "<p>a b</p>", "r"), (4, "<p>" + "w " * 200_000, "r")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id int, html string, row string"))
    assert sorted((r.row.page_id, r.got.n_chars) for r in got.collect()) == [(1, 0), (2, 0), (3, 3), (3, 3), (4, 399_999)]
    assert html_extract.extract(spark.createDataFrame([], "page_id int, html string")).count() == 0
