"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _to_minimum(pairs: DataFrame) -> DataFrame:
    """(u, v) with the least v of each u; the least is found before the shuffle and joined back."""
    return pairs.join(pairs.groupBy("u").agg(F.min("v").alias("m")), "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _to_minimum(both).withColumn("m", F.least("u", "m"))
    return least.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _to_minimum(down)
    return (
        least.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .where("u <> v")
        .union(least.select("u", F.col("m").alias("v")))
        .distinct()
    )


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """node and root, the least node that it reaches, for every node of the edges (u, v).

    Edges may repeat and point either way; loops and edges with a null end are
    left out. No edges give no rows.
    """
    edges = cut(edges.where("u <> v").select("u", "v").distinct())
    before = _mark(edges)
    while before[0]:
        edges = cut(_small_star(_large_star(edges)))
        now = _mark(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
