import html
import re

import numpy as np
import pytest

from cordon.llm import html_extract as hx


def lcs_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_alignment_is_a_longest_common_subsequence():
    rng = np.random.default_rng(1)
    for _ in range(500):
        a, b = (rng.integers(0, 6, rng.integers(0, 15)).tolist() for _ in range(2))
        s = hx.shared(a, b)
        rest = iter(b)
        assert len(s) == lcs_length(a, b) and all(any(a[i] == y for y in rest) for i in s)


@pytest.mark.parametrize("page, text", [
    ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a<p>b<br>c", "a b c"),
    ("<nav>menu</nav><article><header><h1>T</h1></header><p>x <b>y</b>z</p><aside>s</aside><form>f<input>g</form></article><footer>c</footer>", "T x yz"),
    ("<body><div class='site-header'>h</div><p>one</p><script>'</p>'</script><style>p{}</style><div id=comments>c<div>d</div></div><p>two", "one two"),
    ("<article><p>a<!-- no > -->b</p><ul><li>i<li>j</ul><pre>k\n\n  l</pre></article><section>off</section>", "ab i j k l"),
    ("<article><h1>T</h1><p>a</p><h2 id='related-work'>w</h2><p class='market-share'>m</p><div class='legal'>l</div><section id='social-impact'>s</section><p>x <math><mi>y</mi></math></p></article>", "T a w m l s x y"),
    ("<article><p>a<svg><title>i</title><text>v</text></svg></p><div class='ad-banner'>b</div><div class='cookie notice'>c</div><div id=comments>d</div><div class='share-buttons'>e</div><p hidden>f</p><p class='side'>g</p></article>", "av g"),
    ("<main><p>&copy;&#39;&nbsp;x</p></main><div>y</div>", "©' x"), ("<article><p>unclosed <b>bold<p>next", "unclosed bold next"),
])
def test_text_of_a_page(page, text):
    assert hx.main_text(hx.lines(page), set()) == text


def test_template_without_markup_goes_by_differencing(spark):
    top, end = "<div>Site name</div><div>Menu</div>", "<div>Imprint</div>"
    rows = [(i, f"http://h.example/a/{i}", f"{top}<p>story {i} first</p><p>story {i} second</p>{end}") for i in range(5)]
    rows += [(9, "http://other.example/a", "<div>Site name</div><p>alone</p>"), (10, None, None), (11, "http://h.example/a/1", rows[1][2]), (12, "http://h.example/z", "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, lines string")
    got = {r.page_id: (r.text, r.n_chars) for r in hx.extract(df).collect()}
    for i in range(5):
        assert got[i][0] == f"story {i} first story {i} second"
    assert got[9][0] == "Site name alone" and got[10] == ("", 0) and got[12] == ("", 0) and len(got) == len(rows)
    assert hx.extract(df.where("false")).count() == 0


def test_runs_of_equal_pages_meet_the_nearest_different_page(spark):
    page = lambda story: f"<div>Menu</div><p>{story}</p><div>Imprint</div>"
    stories = ["first", *["copy"] * 40, "other", *["again"] * 3]
    rows = [(i, f"http://h.example/{i:03}", page(s)) for i, s in enumerate(stories)] + [(100 + i, f"http://only.example/{i}", page("copy")) for i in range(3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = dict(enumerate(stories)) | {100 + i: "Menu copy Imprint" for i in range(3)}
    for n in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            assert {r.page_id: r.text for r in hx.extract(df).collect()} == want
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_pages_of_the_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r.text for r in hx.extract(pages).collect()}
    for r in pages.collect():
        body = r.html[r.html.index("<article>") : r.html.index("</article>")]
        want = html.unescape(re.sub(r"<b>|</b>", "", re.sub(r"</?(p|h1|br|article)>", " ", body)))
        assert got[r.page_id] == " ".join(want.split())


def test_differencing_decides_hints_inside_an_article(spark):
    """A box whose name only hints at furniture goes if pages of other articles have it; copies of an article keep it."""
    page = lambda story, box: f"<article><p>{story} one</p><p>{story} two</p><p>{story} three</p><div class='related-reading'>{box}</div></article>"
    rows = [(i, f"http://h.example/{i}", page(f"story {i}", "Read this as well")) for i in range(4)]
    rows += [(9, "http://h.example/9", page("last", "Only here")), (10, "http://c.example/1", page("copy", "Its own box")), (11, "http://c.example/2", page("copy", "Its own box") + "<p>x</p>")]
    got = {r.page_id: r.text for r in hx.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"story {i} one story {i} two story {i} three" for i in range(4))
    assert got[9].endswith("last three Only here") and got[10] == got[11] == "copy one copy two copy three Its own box"
