"""Landed HTML as tokens: tags with their attributes, text, comments.

One pattern cuts a page into tokens in a single pass, from left to right:
comments, elements whose content is no markup, tags with attributes in any
quoting, and text. What stands inside an element is gathered by a fold over the
tokens of its page, so pages are never joined or shuffled.
"""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import strip

# Elements without an end tag, and elements whose content is no markup.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
RAW = ("script", "style", "title", "textarea", "noscript", "iframe", "template", "xmp", "noembed", "noframes")

#: Up to the end of a tag; a quote counts after an equals sign alone.
_TAIL = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+>"""
TOKEN = (
    rf"(?is)<!--.*?(?:-->|\z)|<({'|'.join(RAW)})(?=[\s/>]){_TAIL}.*?(?:</\1(?=[\s/>])[^>]*+>|\z)"
    rf"|</?[a-z]{_TAIL}|</?[a-z][^>]*+\z|<[!?/][^>]*+>|[^<]++|<"
)
_ATTRIBUTE = r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>][^\s>]*+)))?"""
#: Stands for a line break until white space has been run together; no page can hold it.
_BREAK = "\0"


def pieces(page: Column) -> Column:
    """The tokens of a page as they are written; together they are the page."""
    return F.regexp_extract_all(page, F.lit(TOKEN), 0)


def is_tag(token: Column, start: str, *names: str) -> Column:
    """Whether a token is such a tag; one that the page's end cuts off is not."""
    return token.rlike(rf"(?i)^{start}(?:{'|'.join(names)})(?=[\s/>])") & F.endswith(token, F.lit(">"))


def _is_text(token: Column) -> Column:
    return ~F.startswith(token, F.lit("<")) | ~token.rlike(r"^<(?:[a-zA-Z!?/])")


def attributes(tag: Column) -> tuple[Column, Column]:
    """Names in lower case, and values of a tag's attributes, as written; one without a value has an empty one."""
    tail = F.regexp_replace(tag, r"^</?[^\s/>]+", "")
    group = lambda n: F.regexp_extract_all(tail, F.lit(_ATTRIBUTE), n)
    value = F.transform(F.arrays_zip(group(2).alias("a"), group(3).alias("b"), group(4).alias("c")), lambda v: F.concat(v["a"], v["b"], v["c"]))
    return F.transform(group(1), F.lower), value


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's first attribute of this name, null without one."""
    names, values = attributes(tag)
    return unescape(F.get(values, F.array_position(names, name).cast("int") - 1), inside_tag=True)


def _named() -> Column:
    """Characters by the name of a reference, with its semicolon where it needs one."""
    return F.from_json(F.lit(json.dumps(html.entities.html5)), "map<string,string>")


def _character(number: Column) -> Column:
    """The character of a number; those of no character become the sign for one that is unknown."""
    # the second block of controls is read as the code page that writers meant
    meant = "".join(bytes([k]).decode("cp1252", "ignore") or chr(k) for k in range(0x80, 0xA0))
    bad = number.isNull() | (number == 0) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
    plain = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    return F.when(bad, "�").when(number.between(0x80, 0x9F), F.substring(F.lit(meant), (number - 0x7F).cast("int"), F.lit(1))).otherwise(plain)


def unescape(text: Column, inside_tag: bool = False) -> Column:
    """The text with character references replaced, as browsers read them.

    Names that end without a semicolon count where they always have; inside a
    tag not before a letter, a digit or an equals sign, as in a query string.
    """
    parts = F.regexp_extract_all(text, F.lit(r"(?s)&(?:#[0-9]++;?|#[xX][0-9a-fA-F]++;?|[a-zA-Z][a-zA-Z0-9]*+;?+=?)|&|[^&]++"), 0)

    named = _named()

    def replaced(part: Column) -> Column:
        body = F.regexp_replace(F.substring(part, 2, 1 << 20), "=$", "")
        digits = F.regexp_replace(part, "[^0-9a-fA-F]", "")
        number = F.when(F.length(digits) > 12, F.lit(1 << 40)).when(part.rlike("^&#[xX]"), F.conv(digits, 16, 10).cast("long")).otherwise(digits.cast("long"))
        whole = F.try_element_at(named, body)
        lengths = F.when(F.length(body) > 1, F.sequence(F.length(body) - 1, F.lit(1))).otherwise(F.array().cast("array<int>"))
        known = F.filter(lengths, lambda n: F.try_element_at(named, F.substring(body, F.lit(1), n)).isNotNull())
        longest = F.get(known, 0)
        old = F.concat(F.try_element_at(named, F.substring(body, F.lit(1), longest)), F.substring(part, longest + 2, F.lit(1 << 20)))
        rest = F.when(F.endswith(part, F.lit("=")), "=").otherwise("")
        if inside_tag:
            closed = F.endswith(body, F.lit(";")) | ~F.endswith(part, F.lit("="))
            name = F.when(closed & whole.isNotNull(), F.concat(whole, rest)).otherwise(part)
        else:
            name = F.when(whole.isNotNull(), F.concat(whole, rest)).otherwise(F.coalesce(old, part))
        return F.when(part.rlike("^&#[0-9xX]"), _character(number)).when(part.rlike("^&[a-zA-Z]"), name).otherwise(part)

    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(parts, replaced), "")).otherwise(text)


def shown(text: Column) -> Column:
    """Gathered text as it is shown: references replaced, white space run together, breaks as new lines, ends stripped."""
    even = F.regexp_replace(unescape(text), r"[ \t\n\f\r]+", " ")
    return strip(F.regexp_replace(even, f" ?{_BREAK} ?", "\n"))


def _coded(page: Column) -> Column:
    """The page's tokens, each with what it opens or closes in lower case (``<a``, ``</a``), ``text``, or nothing.

    A fold looks at its token many times, so what it asks for is told once.
    """
    start = lambda t: F.lower(F.regexp_extract(t, r"^</?[a-zA-Z][^\s/>]*", 0))
    tag = lambda t: F.when(~F.startswith(t, F.lit("<")), "text").when(F.endswith(t, F.lit(">")), start(t)).when(_is_text(t), "text").otherwise("")
    return F.transform(pieces(page), lambda t: F.struct(tag(t).alias("tag"), t.alias("t")))


def _said(coded: Column) -> Column:
    """What a token adds to the text around it."""
    return F.when(coded["tag"] == "text", coded["t"]).when(coded["tag"] == "<br", F.lit(_BREAK)).otherwise("")


def _value(tag: Column, name: str) -> Column:
    """The value of an attribute as written, null without one."""
    names, values = attributes(tag)
    return F.when(F.contains(F.lower(tag), F.lit(name)), F.get(values, F.array_position(names, name).cast("int") - 1))


def inner_links(page: Column, around: str = "nav") -> Column:
    """href (as written) and label of each link with one, inside elements named ``around``, nested ones and several too.

    A link ends with its end tag, where the next one starts, or with the
    outermost ``around``. Labels hold the text of all that is nested in them.
    """
    kind = "struct<depth:int,href:string,label:string,out:array<struct<href:string,label:string>>>"
    link = lambda s: F.array(F.struct(s["href"].alias("href"), s["label"].alias("label")))
    start = F.struct(F.lit(0).alias("depth"), F.lit(None).cast("string").alias("href"), F.lit("").alias("label"), F.array().cast("array<struct<href:string,label:string>>").alias("out"))
    wanted = F.filter(_coded(page), lambda c: c["tag"].isin("text", "<a", "</a", f"<{around}", f"</{around}", "<br"))

    def step(s: Column, c: Column) -> Column:
        tag = c["tag"]
        closes = s["href"].isNotNull() & ((tag == "<a") | (tag == "</a") | ((tag == f"</{around}") & (s["depth"] <= 1)))
        return F.struct(
            F.when(tag == f"<{around}", s["depth"] + 1).when(tag == f"</{around}", F.greatest(s["depth"] - 1, F.lit(0))).otherwise(s["depth"]).alias("depth"),
            F.when(tag == "<a", F.when(s["depth"] > 0, _value(c["t"], "href"))).when(~closes, s["href"]).alias("href"),
            F.when(s["href"].isNull() | closes, "").otherwise(F.concat(s["label"], _said(c))).alias("label"),
            F.when(closes, F.concat(s["out"], link(s))).otherwise(s["out"]).alias("out"),
        ).cast(kind)

    return F.aggregate(wanted, start.cast(kind), step, lambda s: F.when(s["href"].isNotNull(), F.concat(s["out"], link(s))).otherwise(s["out"]))


def first_text(page: Column, name: str, mark: tuple[str, str] | None = None) -> Column:
    """Text of the first element of this name, or with this attribute and value, as gathered; empty without one."""
    kind = "struct<name:string,open:int,text:string>"
    start = F.struct(F.lit(None).cast("string").alias("name"), F.lit(0).alias("open"), F.lit("").alias("text"))

    def step(s: Column, c: Column) -> Column:
        tag = c["tag"]
        found = tag == f"<{name}"
        if mark:
            marked = F.coalesce(_value(c["t"], mark[0]) == mark[1], F.lit(False))
            found = found | (F.startswith(tag, F.lit("<")) & ~F.startswith(tag, F.lit("</")) & ~tag.isin(*[f"<{v}" for v in VOID]) & marked)
        opens = s["name"].isNull() & found
        inside = s["open"] > 0
        change = F.when(opens, 1).when(~inside, 0).when(tag == F.concat(F.lit("<"), s["name"]), 1).when(tag == F.concat(F.lit("</"), s["name"]), -1).otherwise(0)
        return F.struct(
            F.when(opens, F.substring(tag, 2, 1 << 20)).otherwise(s["name"]).alias("name"),
            (s["open"] + change).alias("open"),
            F.when(inside, F.concat(s["text"], _said(c))).otherwise(s["text"]).alias("text"),
        ).cast(kind)

    return F.aggregate(_coded(page), start.cast(kind), step, lambda s: s["text"])


def tokens(pages: DataFrame) -> DataFrame:
    """page_id, place from 0, kind, name, attributes, text and depth of every token of (page_id, html).

    Kinds are start, end, text, comment (declarations and a tag that the page's
    end cuts off, too) and raw, which is an element whose content is no markup,
    whole. Text has its references replaced,
    but for raw scripts and styles. The first of several attributes of one name
    counts. Depth is how many start tags before the token have no end tag yet,
    not below zero; elements without end tags, and whole ones, don't count. A
    null page has no tokens, and neither has an empty one.
    """
    cells = pages.select("page_id", F.posexplode(pieces(F.col("html"))).alias("place", "token"))
    t = F.col("token")
    tag = F.lower(F.regexp_extract(t, r"^</?([a-zA-Z][^\s/>]*)", 1))
    whole = F.regexp_extract(t, rf"(?is)^<[a-z]{_TAIL}", 0)
    kind = (
        F.when(_is_text(t), "text")
        .when(t.rlike(rf"(?i)^<(?:{'|'.join(RAW)})(?=[\s/>])") & (whole != ""), "raw")
        .when(~F.endswith(t, F.lit(">")), "comment")
        .when(t.rlike("^</[a-zA-Z]"), "end")
        .when(t.rlike("^<[a-zA-Z]"), "start")
        .otherwise("comment")
    )
    named = cells.withColumn("kind", kind).withColumn("name", F.when((tag != "") & F.col("kind").isin("start", "end", "raw"), tag))
    opened = F.col("kind").isin("start", "raw")
    names, values = attributes(F.when(F.col("kind") == "raw", whole).otherwise(t))
    pairs = F.arrays_zip(names.alias("name"), F.transform(values, lambda v: unescape(v, inside_tag=True)).alias("value"))
    first = F.filter(pairs, lambda x, i: F.array_position(names, x["name"]) == i + 1)
    content = F.regexp_replace(F.substring(t, F.length(whole) + 1, F.length(t)), r"(?is)</[a-z]+[^>]*>$", "")
    change = F.when((F.col("kind") == "start") & ~F.col("name").isin(*VOID) & ~F.endswith(t, F.lit("/>")), 1).when(F.col("kind") == "end", -1).otherwise(0)
    before = Window.partitionBy("page_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return named.withColumn("change", change).select(
        "page_id",
        F.col("place").cast("long").alias("place"),
        "kind",
        "name",
        F.when(opened, F.map_from_entries(first)).alias("attributes"),
        F.when(F.col("kind") == "text", unescape(t))
        .when((F.col("kind") == "raw") & F.col("name").isin("title", "textarea"), unescape(content))
        .when(F.col("kind") == "raw", content)
        .when(F.col("kind") == "comment", t)
        .alias("text"),
        F.greatest(F.lit(0), F.coalesce(F.sum("change").over(before), F.lit(0))).cast("long").alias("depth"),
    )
