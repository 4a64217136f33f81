"""Text functions as column expressions; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lengths and defaults that results depend on.
PREVIEW, WATCH_PREVIEW, NOTICE_PREVIEW, TITLE = 300, 500, 150, 80
UNKNOWN_ROLE, UNTITLED = "unknown", "untitled"


def full_hash(text: Column) -> Column:
    """SHA-1 of the UTF-8 text, 40 hex digits; null stays null."""
    return F.sha1(text)


def short_hash(text: Column) -> Column:
    return F.substring(F.sha1(text), 1, 16)


def prefix(text: Column, n: int) -> Column:
    """The first n code points."""
    return F.substring(text, 1, n)


def prefix_units(text: Column, n: int) -> Column:
    """The first n UTF-16 units; a character that the end would split is left out."""
    units = F.encode(text, "UTF-16BE")
    # a first half of a pair may not be the last unit
    half = F.hex(F.substring(units, 2 * n - 1, 1)).between("D8", "DB")
    cut = F.decode(F.substring(units, F.lit(1), F.when(half, 2 * n - 2).otherwise(2 * n)), "UTF-16BE")
    return F.when(F.octet_length(units) <= 2 * n, text).otherwise(cut)


def suffix(text: Column, n: int) -> Column:
    return F.right(text, F.lit(n))


def strip(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    """True for null, and for text of white space alone, whatever kind it is."""
    return ~F.coalesce(text.rlike(r"(?U)\S"), F.lit(False))


def or_default(value: Column, default: str) -> Column:
    """``default`` for null and for the empty string."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def one_line(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(" "))


def key(*parts: Column) -> Column:
    return F.concat_ws(":", *[p.cast("string") for p in parts])


def style_url(style: Column) -> Column:
    """What the first ``url(`` of a style holds, up to the next bracket, without quotes; null without one."""
    inner = F.regexp_extract(style, r"(?s)url\(((?:(?!url\()[^)])*)", 1)
    return F.when(F.contains(style, F.lit("url(")), F.regexp_replace(inner, "^['\"]+|['\"]+$", ""))


def truthy(text: Column) -> Column:
    """A switch's text: 1, true or yes in any case."""
    return F.lower(text).isin("1", "true", "yes")


def form_encode(fields: dict[str, Column]) -> Column:
    """name=value pairs as a web form sends them."""
    return F.concat_ws("&", *[F.concat(F.lit(f"{k}="), F.url_encode(v)) for k, v in fields.items()])
