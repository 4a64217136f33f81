"""Images of messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import style_url
from ..sources.messages import last
from . import html

# Fixed value: narrower images are icons.
MIN_WIDTH = 50


def with_images(messages: DataFrame, narrowest: int = MIN_WIDTH) -> DataFrame:
    """``messages`` (with imgs and bg_styles) with images: wide ones that have a source, then backgrounds."""
    blob = lambda src: F.startswith(src, F.lit("blob:"))
    wide = F.filter(F.coalesce("imgs", F.array().cast("array<struct<src:string,alt:string,width:int>>")), lambda i: (i["width"] > narrowest) & (F.coalesce(i["src"], F.lit("")) != ""))
    tags = F.transform(wide, lambda i: _image(i["src"], F.coalesce(i["alt"], F.lit("")), i["width"], blob(i["src"])))
    urls = F.filter(F.transform(F.coalesce("bg_styles", F.array().cast("array<string>")), style_url), lambda u: F.coalesce(u, F.lit("")) != "")
    backgrounds = F.transform(urls, lambda u: _image(u, F.lit(""), F.lit(0), blob(u)))
    return messages.withColumn("images", F.concat(tags, backgrounds)).drop("imgs", "bg_styles")


def from_html(messages: DataFrame) -> DataFrame:
    """``messages`` with imgs and bg_styles, as ``with_images`` takes them, from the markup in column html.

    An image's width is its attribute's number, or zero without one. Backgrounds
    are those of ``div`` elements, in the order of the page.
    """
    tags = F.filter(html.pieces(F.col("html")), lambda t: html.is_tag(t, "<", "img", "div"))
    value = lambda t, name: F.coalesce(html.attribute(t, name), F.lit(""))
    width = lambda t: F.coalesce(F.regexp_extract(value(t, "width"), r"^\s*(\d{1,9})", 1).try_cast("int"), F.lit(0))
    imgs = F.transform(
        F.filter(tags, lambda t: html.is_tag(t, "<", "img")),
        lambda t: F.struct(value(t, "src").alias("src"), value(t, "alt").alias("alt"), width(t).alias("width")),
    )
    styles = F.transform(F.filter(tags, lambda t: html.is_tag(t, "<", "div")), lambda t: value(t, "style"))
    return messages.withColumns({"imgs": imgs, "bg_styles": F.filter(styles, lambda s: F.contains(s, F.lit("background-image")))})


def messages_with(messages: DataFrame, include_images: bool = True) -> DataFrame:
    """Messages with the column images, or without it and all that it is made from."""
    return with_images(messages) if include_images else messages.drop("imgs", "bg_styles")


def _image(src: Column, alt: Column, width: Column, is_blob: Column) -> Column:
    return F.struct(src.alias("src"), alt.alias("alt"), width.cast("int").alias("width"), is_blob.alias("is_blob"))


def listing(messages: DataFrame, last_n: int) -> DataFrame:
    """One row an image of the last messages; zero or fewer messages have none."""
    return (
        last(messages, last_n)
        .select("chat_url", F.col("index").alias("message_index"), "role", F.posexplode("images").alias("image_index", "i"))
        .select("chat_url", "message_index", "role", F.col("image_index").cast("long").alias("image_index"), "i.src", "i.alt", "i.is_blob", (~F.col("i.is_blob")).alias("downloadable"))
    )


def pick(messages: DataFrame, message_index: int, image_index: int) -> DataFrame:
    """The image at a place of a message, or the reason why there is none; places count from 0, negative ones are refused."""
    row = messages.where(F.col("index") == message_index)
    refused = message_index < 0 or image_index < 0
    image = F.lit(None).cast("string") if refused else F.try_element_at("images", F.lit(image_index + 1))["src"]
    reason = F.when(F.lit(refused), "negative_index").when(F.size("images") <= image_index, "no_such_image")
    return row.select("chat_url", "index", image.alias("src"), reason.alias("error"))
