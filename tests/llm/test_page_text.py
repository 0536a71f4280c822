"""Main text of pages: authored pages with their articles, the given pages against SQL, and odd markup."""

from __future__ import annotations

import time

import pytest
from conftest import DATA, assert_same, duck

from pulsegrid.llm import page_text, queries, warc

LONG = "A sentence that is long enough to count as a part of an article, and then some more words to be sure of it. "
P1, P2 = (LONG * 3).strip(), (LONG.replace("sentence", "paragraph") * 2).strip()

PAGES = {
    "article among the rest": (
        f"""<html><head><title>T</title><style>p{{}}</style></head><body><header class="top">Site name</header><nav><a href=/>Home</a></nav>
        <div class="cookie-notice">{LONG}</div><article><header><h1>Head</h1></header><p>{P1}</p><div class=ad>{LONG}</div><p>Short.</p>
        <aside>{LONG}</aside><p>{P2}<br>line</p><form>{LONG}<input></form></article><section id=comments><p>{P1}</p></section><footer>&copy; {LONG}</footer>""",
        f"Head {P1} Short. {P2} line",
    ),
    "main element with a sidebar": (f"<body><div id=sidebar>{P1}</div><main><h1>Head</h1><p>{P1}</p><ul><li>one</li><li><a href=x>two</a></li></ul></main><p>{P2}</p>", f"Head {P1} one two"),
    "no structure at all": (f"<body><div><a href=1>One</a> <a href=2>Two</a></div><div></div><div></div><div><h1>Head</h1><p>{P1}</p><p>Short.</p><p>{P2}</p></div><div></div><div></div><div>Site, 2020</div>", f"Head {P1} Short. {P2}"),
    "quote in a box between paragraphs": (f"<div><p>{P1}</p><div>Said so.</div><p>{P2}</p></div>", f"{P1} Said so. {P2}"),
    "reader comments as inner articles": (f"<article><h1>Head</h1><p>{P1}</p><article><p>{P2}</p></article></article>", f"Head {P1}"),
    "comment articles beside": (f"<article><p>{P1}</p></article><article class='comment even'><p>{P1} {P2}</p></article>", P1),
    "unclosed advert before the article": (f"<div class=ad>Buy now<article><p>{P1}</p></article>", P1),
    "inline tags do not part words": ("<article><p>wo<b>r</b>d <i>a</i>&amp;b&nbsp;&nbsp;c&#233;</p></article>", "word a&b cé"),
    "script that holds markup": ("<article><script>var t='</article><p>no';</script><p>yes</p></article>", "yes"),
    "greater sign in an attribute": ('<article><p title="a > b">yes</p></article>', "yes"),
    "less sign in the text": ("<article><p>1 < 2 <3 and a<b</p></article>", "1 < 2 <3 and a"),
    "hidden parts": ("<article><p>yes</p><div hidden>no</div><div style='display: none'>no</div><div aria-hidden=true>no</div></article>", "yes"),
    "menu only": ("<nav><a href=1>One</a></nav><div class=menu><a href=2>Two</a></div>", ""),
    "plain text": ("only text", "only text"),
    "null": (None, ""),
    "empty": ("", ""),
    "white space": (" \n\t<p> </p>", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_authored_pages(name):
    page, want = PAGES[name]
    assert page_text.main_text(page) == want


@pytest.mark.parametrize("page", ["<" * 200_000, "<a" * 200_000, '<a "' * 100_000, "<!--" * 100_000, "<div>" * 100_000 + "</p></main>" * 100_000, "<script>" * 100_000, "</div>" * 100_000, "<p>x" * 100_000, "<a href='" * 100_000, "&" * 200_000])
def test_odd_markup_takes_time_with_its_length(page):
    begin = time.perf_counter()
    page_text.main_text(page)
    assert time.perf_counter() - begin < 10


def test_long_page_is_whole(spark):
    text = " ".join(f"word{i}" for i in range(400_000))
    rows = [(1, "u", f"<article><p>{text}</p></article>"), (1, "u", f"<article><p>{text}</p></article>"), (None, None, None)]
    got = page_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.n_chars for r in got)) == [0, len(text), len(text)]
    assert {r.text for r in got} == {"", text}


def test_empty_table_and_extra_columns(spark):
    schema = "page_id int, url string, html string, text int, n_chars string"
    assert page_text.extract(spark.createDataFrame([], schema)).collect() == []
    got = page_text.extract(spark.createDataFrame([(1, "u", "<p>x</p>", 5, "y")], schema)).collect()
    assert [tuple(r) for r in got] == [(1, "u", "x", 1)]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_sql(spark, sf):
    assert_same(queries.op11_page_text(spark, f"{DATA}/{sf}"), duck(sf), queries.ORACLE_SQL["op11_page_text"])


def test_archived_pages_without_an_id(spark):
    big = "x" * 2_000
    rows = [(1, "http://a/x", big), (2, "http://a/x", big), (None, "http://a/x", big), (None, None, None), (3, None, "s"), (None, "http://b", "s")]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to or 0) for r in got) == [(0, 0, "response", 0), (0, 1, "response", 0), (0, 2_000, "revisit", 2), (1, 2_000, "revisit", 2), (2, 2_000, "response", 0), (3, 1, "response", 0)]
