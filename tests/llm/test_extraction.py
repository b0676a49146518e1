"""Main text: driver's pages against a plain reading of their one template, unmarked templates, malformed pages."""

import html
import re

from geoweave.llm import extraction

SF = "/root/testdata/sf0.1"


def plain(source):
    """The text of the only article, blocks at h1 and p tags."""
    inside = re.search("<article>(.*?)(</article>|$)", source, re.S)[1]
    blocks = re.split("</?(?:p|h1)>", inside)
    out = [" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", b))).split()) for b in blocks]
    return "\n".join(b for b in out if b)


def test_driver_pages(spark):
    df = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r.page_id: plain(r.html) for r in df.collect()}
    got = extraction.main_texts(df).collect()
    assert len(got) == len(want)
    for r in got:
        assert r.text == want[r.page_id] and r.n_chars == len(r.text)


def page(i, body):
    return f"<html><body><div class='x1'><a href=/>Home</a> <a href=/a>About</a></div><div class=x2>Accept our terms to go on.</div>{body}<div class=x4>Page {i}</div></body></html>"


def test_unmarked_template_is_deduced(spark):
    rows = [(i, "http://a.example/x", page(i, f"<div class=x3><p>Story {i} begins. <p>It goes on {i * 7} times &amp; ends.</div>"), 1) for i in range(30)]
    rows += [(100 + i, "http://few.example/", page(i, "<div class=x3>Short one.</div>"), 1) for i in range(2)]
    df = spark.createDataFrame(rows * 2, "page_id long, url string, html string, n_chars int").repartition(3)
    got = {r.page_id: r.text for r in extraction.main_texts(df).collect()}
    assert got[3] == "Story 3 begins.\nIt goes on 21 times & ends.\nPage 3"
    assert got[100] == "Accept our terms to go on.\nShort one.\nPage 0"  # two pages prove no repeated text, but links are a menu


def test_malformed_and_edge_pages(spark):
    cases = [
        (None, ""), ("", ""), ("no markup  at\nall &lt;b&gt;", "no markup at all <b>"),
        ("<article>a<br>b<p>c<b>d</p>e<!-- x --> f<script>if (1 < 2) '</p>'</script></article>tail", "a b\ncd\ne f"),
        ("<main><h1>T</h1><div class='comments'>no</div><section>yes<aside>no</aside> more</section></main><p>out", "T\nyes\nmore"),
        ("<article><header><h1>H</h1></header>x<form>f<input>g</form><footer>q</footer></article><header>h</header>", "H\nx"),
        ("<div id=content class='has-sidebar'><ul><li>one<li>two</ul>&nbsp;&#x41;&amp</div><div class=sidebar>s</div>", "one\ntwo\nA&"),
        ("<article>cut off <b>here &am", "cut off here &am"), ("<article><p title='a>b'>x</p><div", "x"), ("<p>" * 3000 + "deep", "deep"),
        ("<article>" + "word " * 200_000 + "</article>", " ".join(["word"] * 200_000)),
        ("<article>a<section class='reader-comments'><article>c</article></section></article>", "a"),
    ]
    rows = [(i if i else None, None if i % 2 else f"x://h{i}", h, "q") for i, (h, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(2)
    got = {r.page_id: (r.text, r.n_chars) for r in extraction.main_texts(df).collect()}
    for i, (_, want) in enumerate(cases):
        assert got[i if i else None] == (want, len(want)), cases[i][0]
    assert extraction.main_texts(df.where("false")).count() == 0
