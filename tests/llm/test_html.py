import pytest

from tokenlake.llm import html

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
LONG = " ".join([WORDS] * 5)

PAGES = {
    "sections of other classes": (
        f"<body><nav>menu</nav><article><p>Intro {WORDS}</p><section class=a><p>{LONG}</p></section><section class=b><p>{LONG} two</p></section></article><footer>f</footer>",
        f"Intro {WORDS} {LONG} {LONG} two",
    ),
    "lead and body": (f"<main><h1>Title</h1><div class=lead><p>Lead {WORDS}</p></div><div class=body><p>{LONG}</p></div></main>", f"Title Lead {WORDS} {LONG}"),
    "a paragraph that is mostly a link": (
        f"<body><div class=story><h1>T</h1><p>See <a href=x>{LONG}</a></p></div><div class=legal><p>{LONG} {WORDS}</p></div>",
        f"T See {LONG}",
    ),
    "boilerplate words inside other names": (f'<body><div class="search-guide entry"><p>{WORDS}</p></div><div class="site-search"><p>{LONG}</p></div>', WORDS),
    "stray quotes": (f'<body><div class=post><a title="5" tall" href="x">{WORDS}</a> says <b class="a" "b">{WORDS}</b></div><div id="side-bar">x</div>', f"{WORDS} says {WORDS}"),
    "mostly a list": (f"<body><div id=page><h1>Head</h1><ul><li>{LONG}</li><li>{LONG}</li></ul><p>end</p></div><div class='site-footer'>x</div>", f"Head {LONG} {LONG} end"),
    "open cells": (f"<body><table><tr><td width=20%><a href=1>menu</a><td><h1>Head</h1>{LONG}</table>", f"Head {LONG}"),
    "an article's own head": (f"<article><header><h1>Head</h1></header><p>{WORDS}</p><footer>by me</footer></article>", f"Head {WORDS}"),
    "comments and forms": (f"<article><p>{WORDS}</p><div class='comment-list'><p>{LONG}</p></div><form>{LONG}</form><aside>{LONG}</aside></article>", WORDS),
    "references and inline tags": (f"<body><p>{WORDS} It<i>al</i>ic &lt;b&gt; a<br>b 1 < 2 &amp;&nbsp;3<script>if(a<b)</script></p>", f"{WORDS} Italic <b> a b 1 < 2 & 3"),
    "no tags": ("plain  text", "plain text"),
    "nothing": ("<div></div>", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_shapes(name):
    source, want = PAGES[name]
    assert html.extract(source, html.best_path(source)[0]) == want


def test_hosts_agree_on_both_join_paths_and_minor_parts_fall_back(spark):
    page = "<body><div class='a-{0}'><p>Text {0} " + WORDS + "</p></div><div class=b><p>b {0}</p></div>"
    other = f"<body><div class='a-1'><p>small</p></div><div class=other><h1>Head</h1><p>{LONG}</p></div>"
    rows = [(i, "http://h/", page.format(i)) for i in range(5)] * 2 + [(9, "http://h/", other), (10, None, "<p>x" + "y " * 100_000), (11, "http://t/", None)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, host string")
    got = sorted(html.main_text(df).collect(), key=str)
    assert got == sorted(html.main_text(df, broadcast=0).collect(), key=str) and len(got) == len(rows)
    text = {r.page_id: r.text for r in got}
    assert text[3] == f"Text 3 {WORDS}" and text[9] == f"Head {LONG}" and text[10] == ("x" + "y " * 100_000).strip() and text[11] == ""


def test_tied_votes(spark):
    rows = [(1, "http://h/", f"<div class=a><p>{WORDS}</p></div>"), (2, "http://h/", f"<div class=b><p>{WORDS}</p></div>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert [r.path for r in html.winners(df).collect()] == ["/div.b"]
    assert {r.text for r in html.main_text(df).collect()} == {WORDS}
