"""Vector tables and block joins that the two vector searches share."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Shards of at most so many bytes are sent to every task; of more, blocks of so many queries and shards meet.
SENT_BYTES = 32 << 20
GRID_QUERIES, GRID_SHARDS = 4096, 1024


def usable(vectors: DataFrame, zeros: bool) -> DataFrame:
    """vec_id, v (array of doubles) and dim, without null vectors or ids, empty ones, and null or non-finite components.

    With ``zeros`` false vectors of zeros alone are left out, too. Other columns are left out.
    """
    v = F.col("embedding").cast("array<double>")
    # null, NaN and the infinities are all that x - x = 0 does not hold for
    finite = F.forall("v", lambda x: F.coalesce((x - x) == 0.0, F.lit(False)))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & (F.size("v") > 0) & finite
    )
    if not zeros:
        rows = rows.where(F.exists("v", lambda x: x != 0.0))
    return rows.withColumn("dim", F.size("v"))


def matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64)


def sample(vectors: DataFrame, n: int, *order: Column) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Number of rows, and ids and values of the first n, for each dimension of the commonest eight.

    They only seed bounds and cells, which any rows do validly; other
    dimensions are searched without. At most 8 n rows reach the driver.
    """
    dims = vectors.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(8).collect()
    out = {}
    for dim, count in dims:
        rows = vectors.where(F.col("dim") == dim).orderBy(*order, "vec_id").limit(n).select("vec_id", "v").collect()
        out[dim] = count, np.array([r["vec_id"] for r in rows], np.int64), np.array([r["v"] for r in rows], np.float64)
    return out


def _beside(asked: DataFrame, shards: DataFrame) -> DataFrame:
    """Each query beside each shard of its dimension, the shards' dim and shard as d and s, so that no task gets all of either.

    Shards of a checked size are sent to the queries where those lie. Of more,
    blocks of queries meet blocks of shards, each pair of blocks in a task.
    """
    # new names, since both tables come from the same rows
    named = shards.withColumnsRenamed({"dim": "d", "shard": "s"})
    count, widest = shards.agg(F.count("*"), F.max("dim")).first()
    if count * (8 * (widest or 0) + 64) <= SENT_BYTES:
        return asked.join(F.broadcast(named), F.col("dim") == F.col("d"))
    rows, columns = max(1, -(-asked.count() // GRID_QUERIES)), max(1, -(-count // GRID_SHARDS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    ours = asked.withColumn("row", F.pmod(F.xxhash64("query_id", F.lit(5)), F.lit(rows)).cast("int")).withColumn("column", every(columns))
    theirs = named.withColumn("of_column", F.pmod(F.xxhash64("s", F.lit(5)), F.lit(columns)).cast("int")).withColumn("of_row", every(rows))
    meet = (F.col("dim") == F.col("d")) & (F.col("row") == F.col("of_row")) & (F.col("column") == F.col("of_column"))
    return ours.join(theirs, meet).drop("row", "column", "of_row", "of_column")


def routed(rows: DataFrame, asked: DataFrame, shards: DataFrame, able: Column, block: int) -> tuple[DataFrame, DataFrame]:
    """Shards beside the queries that may find something there, as two tables with keys dim, shard and part.

    ``shards`` has a row for each (dim, shard) with what ``able`` needs to tell
    whether a query of that dimension must see the shard. Queries of a shard
    are dealt into blocks of about ``block``; its rows go once to each block,
    and a shard that no query needs goes nowhere.
    """
    pairs = _beside(asked, shards).where(able)
    parts = pairs.groupBy("d", "s").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    spread = rows.join(parts, (F.col("dim") == F.col("d")) & (F.col("shard") == F.col("s")))
    spread = spread.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(*rows.columns, "part")
    ours = parts.withColumnsRenamed({"d": "of_dim", "s": "of_shard"})
    sent = pairs.join(ours, (F.col("d") == F.col("of_dim")) & (F.col("s") == F.col("of_shard")))
    part = F.pmod(F.xxhash64("query_id", F.lit(3)), F.col("parts")).cast("int").alias("part")
    return spread, sent.select(*asked.columns, F.col("s").alias("shard"), part)


def best(found: DataFrame, k: int, order: Column) -> DataFrame:
    """The first k rows of each query by ``order``, ties to the smaller vec_id, with their rank."""
    window = Window.partitionBy("query_id").orderBy(order, F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
