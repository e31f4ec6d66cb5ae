import pytest

from lattica.llm import html_extract as H

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><p>site head</p></header><nav><ul><li><a href=x>Home</a></li></ul></nav><!-- ad <p>no</p> --><div class="ad">buy</div>
<article><h1>Title &amp; more</h1><p><b>One&nbsp;two<br>three<p>Four  &lt;b&gt;
five &eacute;<aside>side</aside><form>send<input></form><div class="comments"><p>nice!</p></div><ul><li>a<li>b</ul>tail</article>
<footer>&copy; x</footer></body></html>"""


def text(html, template=None):
    return H.main_text(H.Page(html), template)


def test_article_without_the_rest():
    assert text(PAGE) == "Title & more\n\nOne two three\n\nFour <b> five é\n\na\n\nb\n\ntail"


@pytest.mark.parametrize("html,want", [(None, ""), ("", ""), ("plain &am; text", "plain &am; text"), ("<p>a<p>b", "a\n\nb"), ("<p>1 < 2</p>", "1 < 2"), ("<article><p>x</article", "x"), ("<script>never ends <p>x", ""), ("<!-- never ends <p>x", ""), ("<div>a<span>b</span>c</div>", "abc")])
def test_odd_pages(html, want):
    assert text(html) == want


def site(i):
    return f"<html><body><div class=top><a href=/>Start</a> <a href=/b>More</a></div><div class=box><h2>Head {i}</h2><p>Story number {i} with its own words {i * 7}.</p><p>Another part of story {i}.</p></div><div class=low>All rights are kept by us</div></body></html>"


def test_template_of_a_host_without_names(spark):
    rows = [(i, f"http://h.example.org/{i}", site(i)) for i in range(12)] + [(99, "http://lone.example.org/", site(99))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {i: f"Head {i}\n\nStory number {i} with its own words {i * 7}.\n\nAnother part of story {i}." for i in range(12)}
    for most in (H.MAX_TEMPLATES, 0):
        got = {r.page_id: r.text for r in H.extract(pages, most).collect()}
        assert {i: got[i] for i in want} == want
    assert "Start More" in got[99]  # one page has no vectors to compare


def test_repeated_text_in_articles_stays(spark):
    rows = [(i, "http://h.example.org/", f"<nav>menu</nav><article><p>same for all</p><p>own {i}</p></article>") for i in range(8)]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"same for all\n\nown {i}" for i in range(8)}


def test_odd_table(spark):
    rows = [(1, None, None, 1), (1, "not a url", "", 1), (None, "http://a/", PAGE, 2), (2, "http://a/", PAGE, 3), (2, "http://a/", PAGE, 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    got = H.extract(df).collect()
    assert sorted(r.n_chars for r in got) == sorted([0, 0] + [len(text(PAGE))] * 3)
    assert H.extract(df.where("false")).collect() == []
