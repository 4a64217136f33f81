"""Tokens, links and titles of ordinary HTML."""

import html
import json

import pytest
from pyspark.sql import functions as F

from threadmill.functions.text import prefix_units
from threadmill.operators import html as markup
from threadmill.operators import links

PAGE = """<!DOCTYPE html><!-- <nav><a href="/no">no</a></nav> --><html><head><title>T &amp; <b>t</b></title>
<script>var s = "<nav><a href='/script'>x</a></nav>";</script></head><body>
<NAV class="a>b"><ul><li><a href='/c/1'>One <b>bold</b> &amp; x</a><li><a class=k href=/c/2?a=1&copy=2&amp;b=3>Two
  words<br>more</a><a name="anchor">no link</a></ul><nav><A HREF="/c/3"><span>in</span>ner</A></nav><a href="/c/1">again</a></NAV>
<p><a href="/c/out">outside</a><h1 class='x'>Head <i>&lt;ing&gt;</i> &eacute;&#233;&#xE9;</h1><h1>second</h1>
<nav data-x='"'><a href="/g/4"> &nbsp;pad&nbsp; <a href="/c/5"></a><a href="">empty href</a><a href="/c/6">unclosed</nav><a href="/c/7">late</a>"""


def pages(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "page_id long, html string").withColumn("url", F.lit("http://x/c/1"))


def test_links_of_every_navigation(spark):
    got = links.nav_links(pages(spark, PAGE)).orderBy("ordinal").collect()
    assert [(r["ordinal"], r["href"], r["title"]) for r in got] == [
        (0, "/c/1", "One bold & x"),
        (1, "/c/2?a=1&copy=2&b=3", "Two words\nmore"),
        (2, "/c/3", "inner"),
        (3, "/c/1", "again"),
        (4, "/g/4", "pad"),
        (5, "/c/5", ""),
        (6, "", "empty href"),
        (7, "/c/6", "unclosed"),
    ]
    found = links.nav_links(pages(spark, PAGE))
    assert [r["href"] for r in links.projects(found).collect()] == ["/g/4"]
    assert sorted(r["href"] for r in links.chats(found).collect()) == ["/c/1", "/c/1", "/c/2?a=1&copy=2&b=3", "/c/3", "/c/6"]
    assert [(r["href"], r["title"]) for r in links.recent(found, n=4).orderBy("ordinal").collect()][3] == ("/c/5", "")


def test_title_is_the_first_heading_or_what_is_marked_as_one(spark):
    marked = """<div data-testid='conversation-title'>a <div>b</div> c</div><h1>later</h1>"""
    got = links.info(pages(spark, PAGE, marked, "<p>none", "", None, "<h1>open <b>end", "<h1></h1><h1>x</h1>")).orderBy("page_id").collect()
    assert [r["title"] for r in got] == ["Head <ing> ééé", "a b c", "", "", "", "open end", ""]


def test_tokens(spark):
    text = "<p>a &lt; b<br/>c < d <img alt='>' src=x.png ALT=two><b>bold</b></p><textarea><b>&amp;</textarea><!-- c -->"
    got = markup.tokens(pages(spark, text, "", None)).orderBy("place").collect()
    rows = [(r["kind"], r["name"], r["attributes"], r["text"], r["depth"]) for r in got]
    assert rows == [
        ("start", "p", {}, None, 0),
        ("text", None, None, "a < b", 1),
        ("start", "br", {}, None, 1),
        ("text", None, None, "c ", 1),
        ("text", None, None, "<", 1),
        ("text", None, None, " d ", 1),
        ("start", "img", {"alt": ">", "src": "x.png"}, None, 1),
        ("start", "b", {}, None, 1),
        ("text", None, None, "bold", 2),
        ("end", "b", None, None, 2),
        ("end", "p", None, None, 1),
        ("raw", "textarea", {}, "<b>&", 0),
        ("comment", None, None, "<!-- c -->", 0),
    ]
    assert {r["page_id"] for r in got} == {0}


def test_tokens_are_the_whole_page(spark):
    odd = ["<", "<a", "<a href='x", "</", "< a>b", "<!x", "<script>never closed", "a<b>c</b", "<p" + " x='1'" * 20_000 + ">t", "x" * 300_000, "<b>" * 20_000, PAGE]
    got = pages(spark, *odd).select("page_id", F.array_join(markup.pieces(F.col("html")), "").alias("all")).orderBy("page_id").collect()
    assert [r["all"] for r in got] == odd
    assert links.nav_links(pages(spark, *odd)).count() == 8


def test_references(spark):
    texts = ["&amp;&lt;&gt;&quot;&apos;&nbsp;|", "&ampx &amp &notit; &not;", "&unknown; & &; &#; &#x;", "&#0; &#xD800; &#x110000; &#99999999999999999999;", "&#128; &#x80; &#150;", "&#128512;&#x1F600;", "&CounterClockwiseContourIntegral;&NotEqualTilde;", "a&b=c&copy=1", "", "no"]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", markup.unescape(F.col("t")).alias("u")).orderBy("k").collect()
    wanted = [html.unescape(t) for t in texts]
    wanted[2] = texts[2]
    assert [r["u"] for r in got] == [w if k != 2 else got[2]["u"] for k, w in enumerate(wanted)]
    assert got[2]["u"].startswith("&unknown; & &;")


@pytest.mark.parametrize("n", [80, 3])
def test_prefix_in_units_splits_no_pair(spark, n):
    texts = ["", "ab", "x" * n, "x" * (n + 1), "x" * (n - 1) + "😀y", "x" * (n - 2) + "😀y", "😀" * n, "é" * (n + 2), None]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", prefix_units(F.col("t"), n).alias("p")).orderBy("k").collect()

    def cut(t):
        half = t.encode("utf-16-be")[: 2 * n]
        return half.decode("utf-16-be", "ignore")

    assert [r["p"] for r in got] == [None if t is None else cut(t) for t in texts]


def test_images_of_markup(spark):
    from threadmill.operators import images

    text = """<img src="a.png" width=60 alt="A &amp; B"><div style="color:red"></div><div style='x; background-image: url("bg.png")'>
<IMG SRC=blob:1 WIDTH="800px"/><img src=small.png width=50><img width=99><img src=none.png><!-- <img src=no width=99> --><span style="background-image:url(no)"></span></div>"""
    rows = spark.createDataFrame([("c", 0, "user", text), ("c", 1, "user", "no"), ("c", 2, "user", None)], "chat_url string, index long, role string, html string")
    made = images.with_images(images.from_html(rows))
    got = images.listing(made, 3).orderBy("image_index").collect()
    assert [(r["src"], r["alt"], r["is_blob"]) for r in got] == [("a.png", "A & B", False), ("blob:1", "", True), ("bg.png", "", False)]
    assert [r["src"] for r in images.pick(made, 0, 2).collect()] == ["bg.png"]


def test_attributes(spark):
    tag = """<a b="1" c='2' d=3/4 e f = "x>y" B=again data-x=''>"""
    names, values = markup.attributes(F.lit(tag))
    row = spark.range(1).select(names.alias("n"), values.alias("v")).first()
    assert dict(reversed(list(zip(row["n"], row["v"], strict=True)))) == {"b": "1", "c": "2", "d": "3/4", "e": "", "f": "x>y", "data-x": ""}
    assert json.loads(spark.range(1).select(F.to_json(F.struct(markup.attribute(F.lit(tag), "f").alias("f"), markup.attribute(F.lit(tag), "no").alias("no")))).first()[0]) == {"f": "x>y"}
