import html as entities
import os
import re
import time

import pytest

from windrow.llm import html

SF = "/root/testdata/sf0.01"
LONG = "This is a sentence, with commas, that is long enough to score well among paragraphs."


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{x}}</style><script>var a='</p><p>no</p>';</script></head><body>{body}</body></html>"


@pytest.mark.parametrize(
    "body,want",
    [
        (f"<nav><a href=x>Home</a></nav><article><h1>Head</h1><p>{LONG}</p></article><footer>c</footer>", f"Head\n{LONG}"),
        (f"<div id=content><p>{LONG}<p>Second &amp; last<br>line &copy; &eacute;&nbsp;x</div><div class='sidebar'><p>{LONG}</p></div>", f"{LONG}\nSecond & last line © é x"),
        (f"<article><header><h1>Head</h1></header><p>{LONG}</p><aside>no</aside><form>no</form><div class='ad'>no</div><div class='cookie-notice'>no</div><section id='comments'><p>{LONG}</p></section></article>", f"Head\n{LONG}"),
        (f"<header>no</header><main><p>{LONG}</p><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></main>", f"{LONG}\na\nb\nc\nd"),
        (f"<div><div><p>{LONG}</p></div><p>{LONG}</p><p><a href=x>{LONG}</a></p></div>", None),
        ("<p>a  \n\t b</p><!-- <p>no</p> --><p hidden>no</p><p style='display: none'>no</p><p>c</p>", "a b\nc"),
        ("", ""), ("<nav><a>x</a></nav>", ""), ("<article>plain words</article>", "plain words"), ("<article><h1>Only</h1></article>", "Only"),
        ("<p>unclosed <b>bold <i>it", "unclosed bold it"), ("<p>a < b and c > d</p>", "a < b and c > d"),
    ],
)
def test_pages(body, want):
    got = html.extract(page(body))
    assert got == want if want is not None else LONG in got


def test_broken_and_deep_pages():
    deep = "<div>" * 20_000 + f"<p>{LONG}</p>"
    assert html.extract(page(deep)) == LONG
    for text in ("<", "<a", "<!--", "<a href='", "</", "<p a=\"" * 300, "&#x110000;&#0;", "<p>\x00</p>", "<script>"):
        html.extract(text)


@pytest.mark.parametrize("part", ["<div>some text, ", "<div>x</div>", "<a href=\"x>t ", "<a b=\">\"", "<a \"'", "<a ", "<a '", "<![CDATA[", "<b>", "</b>", "<p>", "<td><table>", "<li><div>"])
def test_time_is_linear_in_the_length(part):
    def seconds(n):
        start = time.process_time()
        html.extract(part * n + "<li>x</li><td>y</td>" * (n // 4) + "\">\"")
        return time.process_time() - start

    seconds(200)
    assert seconds(20_000) < 4.0


@pytest.mark.parametrize("block,text", [('<h2 id="related">Related work</h2>', "Related work"), ('<p id="comments">On comments</p>', "On comments"), ('<p class="side">Aside</p>', "Aside"), ('<div class="tags">Tagged</div>', "Tagged"), ('<section id="related-work"><p>Prior</p></section>', "Prior"),
    ('<section id="discussion"><h2>Discussion</h2><p>We found, as others did, more.</p></section>', "Discussion\nWe found, as others did, more."), ('<div class="header">Chapter header</div>', "Chapter header"), ('<div class="share-price">The price rose.</div>', "The price rose."),
    ('<div class="navigation-systems"><p>Satellites, mostly.</p></div>', "Satellites, mostly."), ('<p class="copyright">On the law of copyright.</p>', "On the law of copyright."), ('<div class="menu"><p>Soup, then fish, then a pudding that nobody had asked for.</p></div>', "Soup, then fish, then a pudding that nobody had asked for.")])
def test_named_blocks_inside_the_article_stay(block, text):
    assert html.extract(page(f"<article><p>{LONG}</p>{block}<p>{LONG}</p></article>")) == f"{LONG}\n{text}\n{LONG}"


@pytest.mark.parametrize("block", ['<div class="comments"><p>Nice, very nice</p></div>', '<section id="comments">no</section>', '<div class="ad">no</div>', '<p class="cookie-notice">no</p>', '<div class="newsletter">no</div>', "<form>no</form>", '<ul class="menu"><li>no</ul>', '<div class="share"><a href=x>Share</a> <a href=y>Tweet</a></div>', '<div class="navigation"><ul><li><a href=x>Back</a></ul></div>', '<div id="discussion"><p>Say what you think</p><form>x</form></div>', '<div class="sidebar"><p>More, of this</p></div>', '<p class="breadcrumb"><a href=x>Home</a></p>'])
def test_notices_adverts_and_comments_inside_the_article_go(block):
    assert html.extract(page(f"<article><p>{LONG}</p>{block}<p>{LONG}</p></article>")) == f"{LONG}\n{LONG}"


def test_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", page(f"<p>{LONG}</p>")), (3, "u", page(f"<p>{LONG}</p>")), (None, "v", "<p>x</p>"), (4, "w", "<article>" + f"<p>{LONG}</p>" * 5000 + "</article>")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    got = html.extract_pages(df).collect()
    assert len(got) == 6
    by = {r.page_id: r for r in got}
    assert by[1].text == by[2].text == "" and by[3].text == LONG and by[4].text == "\n".join([LONG] * 5000) and by[4].n_chars == len(by[4].text) and by[None].text == "x"
    assert html.extract_pages(df.limit(0)).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_against_the_pages_template(spark):
    got = {r.page_id: r for r in html.op9_html_extraction(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1].replace("<br>", " ")
        blocks = (" ".join(entities.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner))
        assert got[r.page_id].text == "\n".join(b for b in blocks if b)
