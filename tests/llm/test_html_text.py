import html
import re

import odd
import pytest
from quaywise.llm import html_text
from quaywise.llm.tables import table

P1, P2, P3 = ("This is a paragraph of some length, number %d, which goes on for a while so that it counts. " % i * 3 for i in range(3))
T1, T2, T3 = P1.strip(), P2.strip(), P3.strip()

PAGES = {
    "plain": (f"<html><body><nav><a href=/>Home</a></nav><article><h1>Title</h1><p>{P1}</p><p>{P2}</p></article><footer>Imprint</footer></body></html>", f"Title\n\n{T1}\n\n{T2}"),
    "no article element": (f"<body><div class='top-menu'><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></div><div id=content><h2>Head</h2><div><p>{P1}<p>{P2}<p>{P3}</div></div><div class=sidebar><p>{P1}</p></div>", f"Head\n\n{T1}\n\n{T2}\n\n{T3}"),
    "comments of readers": (f"<article><p>{P1}</p><section class='comments'><div class='comment'><p>{P2}</p></div></section></article>", T1),
    "cookie notice": (f"<div id='cookie-notice' role=dialog><p>{P3}</p><button>OK</button></div><main><p>{P1}</p><aside>{P2}</aside><form><label>Mail<input></label></form><p>{P2}</p></main>", f"{T1}\n\n{T2}"),
    "advert inside": (f"<article><p>{P1}</p><div class='ad'>Buy!</div><p>{P2}</p><div class=AdBox>Buy!</div></article>", f"{T1}\n\n{T2}"),
    "references": ("<article><p>a &amp; b &lt;c&gt; &eacute;&#233;&#x41; &copy &unknown;</p></article>", "a & b <c> ééA © &unknown;"),
    "inline": ("<article><p>one<b>two</b> <i>three</i>\n\t four<br>five<a href=x>six</a></p></article>", "onetwo three four fivesix"),
    "scripts": (f"<article><script>if (a < b) document.write('</p><p>no</p>');</script><style>p {{}}</style><p>{P1}<!-- <p>no</p> --></p></article>", T1),
    "tables and lists": ("<article><table><tr><td>a<td>b<tr><td>c</table><ul><li>x<li>y</ul><blockquote>q</blockquote></article>", "a\n\nb\n\nc\n\nx\n\ny\n\nq"),
    "header of the article": (f"<header>Site</header><article><header><h1>Title</h1></header><p>{P1}</p></article>", f"Title\n\n{T1}"),
    "open tags": (f"<article><h1>T</h1><p><b>bold.<br><p>{P1}</p><p>{P2}</article>", f"T\n\nbold.\n\n{T1}\n\n{T2}"),
    "unended advert": (f"<article><div class=ad>Buy!<p>{P1}</p></article>", None),
    "hidden": (f"<article><p hidden>no</p><p style='display: none'>no</p><p>{P1}</p></article>", T1),
    "text alone": ("just some text", "just some text"),
    "nothing": ("", ""),
    "null": (None, ""),
    "tags alone": ("<p></p><div><br></div>", ""),
    "broken tags": ("<article><p title=\"x>y</p><p>text</p", None),
    "many open quotes": ("<a b='" * 3000, None),
    "menus alone": ("<nav>Home</nav><footer>x</footer>", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    page, want = PAGES[name]
    got = html_text.main_text(page)
    assert isinstance(got, str) if want is None else got == want


def test_very_deep_and_long_pages():
    assert html_text.main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert html_text.main_text(f"<article>{'<p>a b</p>' * 20000}</article>").count("\n\n") == 19999


def test_matches_a_plain_reading_of_the_pages(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    got = {r.page_id: r for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search("<article>(.*)</article>", r.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", inner))
        want = "\n\n".join(b for b in blocks if b)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)


def test_odd_rows(spark):
    rows = [(1, None, None, "x"), (None, "u", "<p>a", "y"), (1, None, None, "x"), (2, "u", "", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert odd.got(html_text.extract(df)) == sorted([(1, None, "", 0), (None, "u", "a", 1), (1, None, "", 0), (2, "u", "", 0)], key=repr)
    assert html_text.extract(df.where("1 = 0")).collect() == []
