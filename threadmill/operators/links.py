"""Links in the navigation of landed pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import TITLE, prefix_units
from . import html

# What marks a project link and a chat link, and how many recent chats are looked at.
PROJECT, PROJECT_PAGE, CHAT, RECENT = "/g/", "/project", "/c/", 10
TITLE_MARK = ("data-testid", "conversation-title")


def nav_links(pages: DataFrame) -> DataFrame:
    """page_id, ordinal from 0, href and title of every link in a page's navigation blocks, in the order of the page."""
    links = pages.select("page_id", F.posexplode(html.inner_links(F.col("html"), "nav")).alias("ordinal", "link"))
    return links.select(
        "page_id",
        F.col("ordinal").cast("long").alias("ordinal"),
        html.unescape(F.col("link.href"), inside_tag=True).alias("href"),
        html.shown(F.col("link.label")).alias("title"),
    )


def _first(links: DataFrame) -> DataFrame:
    order = Window.partitionBy("page_id", "href").orderBy("ordinal")
    return links.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def _titled(links: DataFrame) -> DataFrame:
    return links.where(F.col("title") != "").withColumn("title", prefix_units(F.col("title"), TITLE))


def projects(links: DataFrame, inside: str = PROJECT, outside: str = PROJECT_PAGE) -> DataFrame:
    """First links to each project that has a title; links to a project's own page are left out."""
    return _titled(_first(links.where(F.contains("href", F.lit(inside)) & ~F.contains("href", F.lit(outside)))))


def chats(links: DataFrame, inside: str = CHAT) -> DataFrame:
    """All links to chats that have a title, repeated ones too."""
    return _titled(links.where(F.contains("href", F.lit(inside))))


def recent(links: DataFrame, inside: str = CHAT, n: int = RECENT) -> DataFrame:
    """The first n different chat links of a page, without a title as well."""
    first = _first(links.where(F.contains("href", F.lit(inside))))
    order = Window.partitionBy("page_id").orderBy("ordinal")
    kept = first.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= n).drop("__n")
    return kept.withColumn("title", prefix_units(F.col("title"), TITLE))


def find(links: DataFrame, name: str) -> DataFrame:
    """The first link of each page whose title holds ``name`` in any case."""
    hits = links.where(F.contains(F.lower("title"), F.lit(name.lower())))
    order = Window.partitionBy("page_id").orderBy("ordinal")
    return hits.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def info(pages: DataFrame, chat: str = CHAT) -> DataFrame:
    """page_id, url, title from the first heading or element marked as one, and whether the url is a chat's."""
    return pages.select(
        "page_id",
        "url",
        F.coalesce(html.shown(html.first_text(F.col("html"), "h1", TITLE_MARK)), F.lit("")).alias("title"),
        F.contains("url", F.lit(chat)).alias("is_chat"),
    )
