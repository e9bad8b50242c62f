"""Main text of pages: hand-written layouts, the sample table and hostile input."""
import html
import re
import time

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quantloom.llm import html_text
from quantloom.llm.html_text import main_text

LONG = "The river rose for three days and then fell back as quickly as it had come, leaving mud on every step of the town."
NEXT = "Nobody had seen anything like it, and the old people said that nobody ever would again."


@pytest.mark.parametrize("page, want", [
    # semantic page: menu, header, aside, advert inside of the article, form, comments, footer
    (f"""<html><head><title>T</title><style>p{{}}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/a>A</a></ul></nav>
     <main><article class="post"><header><h1>Flood</h1><time>May</time></header><p>{LONG}</p><div class="ad-box"><p>Buy now</p></div><p>Be.</p>
     <form><h3>Join</h3><input><button>Go</button></form><p>{NEXT}</p><section id="comments"><p>{LONG}</p></section><footer>By me</footer></article></main>
     <aside><p>{LONG}</p></aside><div class="cookie-notice">We use cookies</div><footer>&copy; us</footer></body></html>""", f"Flood {LONG} Be. {NEXT}"),
    # no semantic elements: link lists and marked boxes are gaps of the distribution
    (f"""<body><div id=menu><a>One</a><a>Two</a></div><div><a>Home</a> | <a>News</a></div><div><h2>Flood</h2><p>{LONG}<p>Short.<p>{NEXT}</div>
     <div class=sidebar>{LONG}</div><div>Tiny</div><div class="footer">end</div></body>""", f"Flood {LONG} Short. {NEXT}"),
    # a menu that never ends, an unclosed head, text after the article
    (f"<head><title>x</title><nav><ul><li><a>A</a><article><p>{LONG}</article>after", LONG),
    (f"<head><p>{LONG}<p>© 2020 us", LONG),
    # inline markup leaves no trace, blocks and line breaks one space, references are decoded
    ("<article><p>a<b>b</b>c <i>d</i><br>e\n\t f</p><ul><li>g<li>h</ul>i&amp;j &lt;k&gt; &eacute;&#233;&#x1F600; &amp;amp; &am &ampx&nbsp;y</article>",
     "abc d e f g h i&j <k> éé\U0001F600 &amp; &am &x y"),
    # markup inside of scripts, comments, attributes and CDATA is no markup
    ("<article><script>if (a</b>) '<p>no</p>'</script><!-- <p>no</p> --><p title='a > b' data-x=it's>yes<!--> no --> 1 < 2 <3 <![CDATA[<raw>&amp;]]></p></article>",
     "yes no --> 1 < 2 <3 <raw>&amp;"),
    # hidden parts, roles, modifiers that only sound like boxes
    ("<main class='no-sidebar has-comments'><p hidden>no</p><p style='display: none'>no</p><div role=alert>no</div><div aria-hidden=true>no</div><div class=no-ads>yes</div></main>", "yes"),
    ("<article><span class=ad>no <span>no</span> no</span> yes <p class=ad>no<p>yes</article>", "yes yes"),
    ("<article>one</article><div>no</div><article>two</article><article class=comment>no</article>", "one two"),
    ("just text, no markup at all", "just text, no markup at all"),
    ("", ""), (None, ""), ("<nav>only a menu</nav>", ""), ("<article>cut <b", "cut"), ("<article>cut <!-- never", "cut"), ("<article>a</article><script>var", "a"), ("<>", "<>"),
    ("</p></div></b>x", "x"), ("<article><p a=\"b>c</p>d</article>", "c d"),
])
def test_layouts(page, want):
    assert main_text(page) == want


def test_windows_sum_lines():
    """A stretch below the surge is dropped where another one reaches it, and kept alone."""
    gap = "<div class=ad>x</div>"
    assert main_text(f"<p>few words</p>{gap}<p>{LONG}</p>{gap}<p>some more</p>") == LONG
    assert main_text(f"<p>few words</p>{gap}<p>more words</p>") == "more words"
    lines = "".join("<p>one line of text here</p>" for _ in range(3))
    assert main_text(f"{lines}{gap}<p>one line</p>") == " ".join(["one line of text here"] * 3)


def article(page):
    """Brute force for the sample pages: what the only article element encloses."""
    m = re.search(r"<article>(.*?)</article>", page or "", re.S)
    blocks = re.sub(r"</?(?:p|h1|br)>", " ", m.group(1)) if m else ""
    return " ".join(html.unescape(re.sub(r"<[^>]*>", "", blocks)).split())


def test_sample_pages_whole(spark):
    path = "/root/testdata/sf0.01/pages.parquet"
    want = {r["page_id"]: article(r["html"]) for r in pq.read_table(path).to_pylist()}
    got = html_text.extract(spark.read.parquet(path)).select("row.page_id", "text", "n_chars").collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_odd_pages(spark):
    rows = [(1, "u", "<article>" + "<p>word</p>" * 50_000 + "</article>"), (None, None, None), (2, None, ""), (2, None, ""), (3, "u", "<p>\x00</p>")]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, text string").withColumn("row", F.lit("r")).withColumn("n_chars", F.lit(1))
    got = sorted((r.row.page_id or 0, r.row.text, r.text, r.n_chars) for r in html_text.extract(pages).collect())
    assert got == [(0, "c", "", 0), (1, "c", " ".join(["word"] * 50_000), 249_999), (2, "c", "", 0), (2, "c", "", 0), (3, "c", "\x00", 1)]
    assert html_text.extract(pages.where("false")).count() == 0


@pytest.mark.parametrize("part", ["<b>", "<div>", "<div><li>", "<ul><li></ul>", "<", "<a b=\"", "<!--", "<script>", "<nav><span>", "<p class=ad><b>", "<tr><td>", "</div>", "<a =' ", "<form><table>", "&", "<li><ul>" + "<blockquote>" * 9])
def test_linear_time(part):
    start = time.time()
    main_text(part * 60_000 + "<li></li></td></p></span>" * 20_000)
    assert time.time() - start < 20
