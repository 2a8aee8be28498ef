import time
import tracemalloc

import pytest

from plumbline.llm import html_text

LONG = "This paragraph is certainly long enough to count as running text, as it goes on and on for more than eighty characters."
PAGES = "page_id long, url string, html string, text string, host string, path string, votes string"


def text(html, path=None):
    return html_text.extract(html_text.parse(html), path)


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        ("", ""),
        ("<p>a &amp; b &lt;c&gt; &copy &#233;</p>", "a & b <c> © é"),
        ("<div>one<br>two <b>th</b>ree\n\n four</div>", "one two three four"),
        ("<nav>menu</nav><article><h1>T</h1><p>x</p></article><footer>f</footer>", "T\nx"),
        ("<article><p>a<p>b<ul><li>c<li>d</ul></article>", "a\nb\nc\nd"),
        ("<body><div class='ad-box'>buy</div><p>kept</p><div class='Cookie_notice'>eat</div><section id=comments><p>first</p></section>", "kept"),
        ("<body><script>var a='</p>';</script><style>p{}</style><p>kept</p><script>open", "kept"),
        ("<!-- a <p>no</p> --><p>yes</p><!-- open <p>no</p>", "yes"),
        ("<p title=it's>one</p><a href=\"x>y\">two</a>", "one\ntwo"),
        ("<p>a < b and 3 > 2</p>", "a < b and 3 > 2"),
        ("<p>cut off <sp", "cut off"),
        ("<article class='has-sidebar'><p>kept</p></article>", "kept"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
        ("<form><p>no</p></form><noscript>no</noscript><div role=navigation>no</div><pre>yes</pre>", "yes"),
        ("just text", "just text"),
    ],
)
def test_blocks(html, expected):
    assert text(html) == expected


def test_host_vote_carries_a_page_that_would_choose_badly(spark):
    good = "<body><div class='post p{0}'><p>" + LONG + "</p><p>" + LONG + "</p></div><div class=extra><p>short</p></div></body>"
    odd = "<body><div class='post p99'><p>" + LONG + "</p></div><div class=extra><p>" + LONG + " " + LONG + "</p></div></body>"
    rows = [(i, f"https://Site.example/{i}", good.format(i)) for i in range(5)] + [(9, "https://site.example/9", odd)]
    pages = spark.createDataFrame([(*r, "", "", "", "") for r in rows], PAGES)
    found = {r.page_id: (r.text, r.n_chars) for r in html_text.main_text(pages).collect()}
    assert all(found[i] == (f"{LONG}\n{LONG}", 2 * len(LONG) + 1) for i in range(5))
    assert found[9][0] == LONG
    assert text(odd) != LONG


def test_awkward_tables(spark):
    assert html_text.main_text(spark.createDataFrame([], PAGES)).count() == 0
    rows = [(1, None, None), (1, None, None), (None, "not a url", "<p>x</p>"), (2, "http://[bad", ""), (3, "http://h/é", "<p>" + "é " * 50_000 + "</p>"), (4, "http://h/", "<div>" * 3000 + "deep")]
    out = html_text.main_text(spark.createDataFrame([(*r, "", "", "", "") for r in rows], PAGES)).collect()
    assert len(out) == 6 and all(r.text is not None and r.n_chars == len(r.text) for r in out)
    assert {r.page_id: r.text for r in out}[4] == "deep"


def test_a_word_of_the_layout_is_no_furniture():
    assert text(f"<div class='sidebar-layout'><article><p>{LONG}</p></article><div class='related-box'><p>Read on</p></div></div>") == LONG
    assert text(f"<div class='search-page'><div class=form><h1>T</h1><p>{LONG}</p></div><aside>no</aside></div>") == f"T\n{LONG}"
    assert text(f"<article><p>{LONG}</p></article><div class='related-box'><h1>More</h1><p>Read on</p></div>") == LONG


def test_hostile_pages_take_linear_time():
    began = time.time()
    for page in ("<title>" * 300_000, "<svg>" * 300_000, "<script>" * 300_000, "<!--" * 300_000, "<a " * 300_000, "<a x=\">\" " * 200_000, "<!x" * 300_000, "<" * 500_000, "<section>" * 50_000 + "</div>" * 50_000, "<section>" * 50_000 + "<td><tr>" * 50_000, "&" * 500_000, "<p title='" * 100_000, "<a b=\">" * 100_000 + "<p>x</p>"):
        text(page)
    assert text("<div><p>word word</p>" * 50_000).count("\n") > 49_900
    assert time.time() - began < 60


def test_deep_pages_take_little_memory():
    tracemalloc.start()
    assert text("<div>" * 200_000 + "deep") == "deep"
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20


def test_an_end_that_never_comes_keeps_the_text():
    assert text("<p>a<title>b<p>c") == "ab\nc"
    assert text("<p>x</p><a href=\"y>z</p><p>end") == "x\nz\nend"
