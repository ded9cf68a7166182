import html
import random

import pytest

from svcops.llm import html_text as H
from svcops.llm.common import read
from tests.llm.helpers import CLASHING, prose

STOP = frozenset("the of and".split())
LONG = "the quick of and " * 20


@pytest.mark.parametrize("page, text", [
    ("", ""), (None, ""), ("plain", "plain"),
    ("<p>a &amp; b&nbsp;&nbsp;c<p>d &#233;&#x1F600;", "a & b c\nd é😀"),
    ("<article><h1>T</h1><p>one <b>two</b>\n\t three</article>", "T\none two three"),
    ("<article><p>a<br>b<br><br>c</article>", "a b\nc"),
    ("<body><header><h1>Site</h1></header><article><header><h1>Title</h1></header><p>x</article><footer>f</footer>", "Title\nx"),
    ("<nav><a href=1>Home</a></nav><main><p>x</p><aside>ad</aside><form><label>l</label><input></form></main>", "x"),
    ("<article><p>x</p><section class='comments'><p>first!</p></section><div class=\"ad\">buy</div><p>y</p></article>", "x\ny"),
    ("<div class='cookie-notice'>We use cookies</div><article>x</article><div id='sidebar'>s</div>", "x"),
    ("<article>a<script>var t='</p>';</script><style>p{}</style><!-- <p>c --><noscript>n</noscript>b</article>", "ab"),
    ("<article><ul><li>1<li>2</ul><table><tr><td>3<td>4</table></article>", "1\n2\n3\n4"),
    ("<article><p hidden>h</p><p style='display: none'>n</p><p>x &lt;b&gt; 1 < 2</p>", "x <b> 1 < 2"),
    ("<div class='header'>Site</div><div id=content><div class='header'>Title</div><p>x</div><ol class=commentlist><li>hi</ol>", "Title\nx"),
    ("<main><p>x</p><div class='cookiebar'>c</div><div class=adsbygoogle>buy</div><p>notable commentary</p></main>", "x\nnotable commentary"),
    ("<article><p>cut <a href=\"x", "cut"), ("<article><p>text</p></div></span></article>tail <p>more", "text"),
    (f"<div><a href=1>Home</a> <a href=2>About</a></div><div>{LONG}</div><div>short tail</div><div><a href=3>More</a></div>",
     LONG.strip() + "\nshort tail"),
])
def test_cases(page, text):
    assert H.main_text(page, STOP) == text


def test_second_pass():
    g, b, o = H.GOOD, H.BAD, H.OPEN
    assert H.second_pass([b, o, o, g, o, b, o], g) == [b, b, g, g, g, b, b]
    assert H.second_pass([o, o], g) == [g, g] and H.second_pass([], g) == []


def page_of(rng, body):
    return (f"<html><head><title>{prose(rng, 3)}</title></head><body><nav><ul><li><a href=/x>{prose(rng, 1)}</a></ul></nav>"
            f"<div class=ad>{prose(rng, 9)}</div><article>{''.join(f'<p>{html.escape(x)}</p>' for x in body)}</article>"
            f"<div class=comments><p>{prose(rng, 12)}</p></div><footer>&copy; {prose(rng, 4)}</footer></body></html>")


def test_whole_table(spark):
    rng = random.Random(12)
    bodies = {i: [prose(rng, rng.randrange(1, 60)) for _ in range(rng.randrange(1, 6))] for i in range(30)}
    rows = [(i, f"u{i}", page_of(rng, b)) for i, b in bodies.items()] + [(90, None, None), (None, "u", ""), (5, "u5", page_of(rng, bodies[5]))]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    from pyspark.sql import functions as F
    df = df.select("*", *[F.lit("x").alias(c) for c in CLASHING if c != "label"], F.lit("y").alias("text"))
    got = H.extract(df).collect()
    assert len(got) == 33
    for r in got:
        want = "\n".join(bodies.get(r["page_id"], []))
        assert r["text"] == want and r["n_chars"] == len(want)
    assert H.extract(df.limit(0)).count() == 0


def test_driver_pages(spark):
    """Articles of the driver's pages: exactly the text between their block tags."""
    import re

    pages = read(spark, "/root/testdata/sf0.01", "pages")
    for r in H.extract(pages).join(pages.select("page_id", "html"), "page_id").collect():
        inner = r["html"].split("<article>")[1].split("</article>")[0]
        parts = re.split(r"</?(?:p|h1)>|<br>(?=<p>|$)", inner)
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in parts]
        assert r["text"] == "\n".join(x for x in parts if x)
