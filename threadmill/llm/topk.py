"""Exact top-k inner products over integer vectors, by buckets of similar length.

Vectors are grouped by length. A query's threshold, the k-th product that it is
sure to reach, gives each bucket a local cosine threshold: above one the bucket
is left out, a high one allows ranges on the query's strongest coordinates,
and otherwise lengths alone prune. Products of what is left are verified in
exact integers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .vectors import best, matrix, routed, sample, usable

SHARD_ROWS, QUERY_ROWS = 8192, 2048
#: Rows inside a shard that share one local threshold.
BUCKET = 512
#: From this local cosine on coordinates prune; so many coordinates are used.
COORDINATE_COSINE, FOCUS = 0.6, 4
#: Longest vectors that seed the thresholds.
SEEDS = 512
LIMIT = 2.0**53
#: Pairs are multiplied one by one where fewer than one in so many are left.
SPARSE = 8


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of the rows of a and b; those beyond a long become its ends."""
    peak = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1])
    if peak < LIMIT:  # each partial sum is an integer that a double holds
        return (a @ b.T).astype(np.int64)
    exact = [[sum(x * y for x, y in zip(p, q, strict=True)) for q in map(_whole, b)] for p in map(_whole, a)]
    ends = np.iinfo(np.int64)
    return np.array([[min(max(x, ends.min), ends.max) for x in row] for row in exact], np.int64).reshape(len(a), len(b))


def _whole(row: np.ndarray) -> list[int]:
    return [int(x) for x in row]


def pair_products(a: np.ndarray, b: np.ndarray, able: np.ndarray) -> np.ndarray:
    """``products`` where ``able`` is set and the least long elsewhere; few pairs are multiplied one by one."""
    if able.mean() * SPARSE > 1:
        return np.where(able, products(a, b), np.iinfo(np.int64).min)
    out = np.full(able.shape, np.iinfo(np.int64).min)
    peak = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1])
    i, j = np.nonzero(able)
    step = max(1, 1_000_000 // max(1, a.shape[1]))
    for low in range(0, len(i), step):
        x, y = i[low : low + step], j[low : low + step]
        if peak < LIMIT:
            out[x, y] = np.einsum("ij,ij->i", a[x], b[y]).astype(np.int64)
        else:
            out[x, y] = [products(a[p : p + 1], b[q : q + 1])[0, 0] for p, q in zip(x, y, strict=True)]
    return out


def bucket_top(ids: np.ndarray, points: np.ndarray, own: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Rows (query, id, score) of the k best of each query here that reach its floor, ties to smaller ids."""
    length = np.sqrt((points**2).sum(axis=1))
    order = np.lexsort((ids, -length))
    ids, points, length = ids[order], points[order], length[order]
    q_length = np.sqrt((queries**2).sum(axis=1))
    unit_q = queries / np.maximum(q_length, 1e-300)[:, None]
    focus = np.argsort(-np.abs(unit_q), axis=1, kind="stable")[:, :FOCUS]
    scores = np.full((len(queries), k), np.iinfo(np.int64).min)
    names = np.full((len(queries), k), np.iinfo(np.int64).max)
    filled = np.zeros((len(queries), k), bool)
    floor = floor.astype(np.float64).copy()
    for low in range(0, len(ids), BUCKET):
        part = slice(low, low + BUCKET)
        longest = length[low]
        slack = 1e-9 * (np.abs(floor) + q_length * longest + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            local = (floor - slack) / (q_length * longest)
        live = np.flatnonzero(~(local > 1))
        if not len(live):
            continue
        unit_p = points[part] / np.maximum(length[part], 1e-300)[:, None]
        # length: a row must be long enough to reach the floor at cosine one
        able = length[part][None, :] * q_length[live][:, None] >= (floor - slack)[live][:, None]
        sharp = np.flatnonzero(local[live] >= COORDINATE_COSINE)
        for f in range(min(FOCUS, queries.shape[1])):
            if not len(sharp):
                break
            who = live[sharp]
            x = unit_q[who, focus[who, f]][:, None]
            c = np.clip(local[who], 0, 1)[:, None]
            # unit vectors at cosine c or more differ in this coordinate by a bounded amount
            y = unit_p[:, focus[who, f]].T
            reach = np.sqrt(np.maximum(0, 1 - c**2) * np.maximum(0, 1 - x**2)) + 1e-9
            # below the longest a row needs a higher cosine still, so the bucket's own threshold is safe
            # an angle wide enough to reach the coordinate's pole leaves that side free
            able[sharp] &= (y >= x * c - reach) | (x <= -c)
            able[sharp] &= (y <= x * c + reach) | (x >= c)
        columns = np.flatnonzero(able.any(axis=0))
        if not len(columns):
            continue
        valid = able[:, columns] & (ids[part][columns][None, :] != own[live][:, None])
        got = pair_products(queries[live], points[part][columns], valid)
        all_scores = np.concatenate([scores[live], got], axis=1)
        all_names = np.concatenate([names[live], np.broadcast_to(ids[part][columns], got.shape)], axis=1)
        all_filled = np.concatenate([filled[live], valid], axis=1)
        # by score downwards, which the bitwise complement does without overflow
        pick = np.lexsort((all_names, ~all_scores, ~all_filled), axis=1)[:, :k]
        scores[live], names[live], filled[live] = (np.take_along_axis(x, pick, 1) for x in (all_scores, all_names, all_filled))
        full = live[filled[live, -1]]
        floor[full] = np.maximum(floor[full], scores[full, -1])
    who, column = np.nonzero(filled)
    return own[who], names[who, column], scores[who, column]


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id and score of the k largest products of floor(scale * x).

    Null vectors, and those with null or non-finite components, take no part;
    vectors of zeros do. A query meets rows of its own dimension alone and never
    rows of its own id. Products beyond a long count as its least or largest.
    """
    whole = lambda rows: rows.withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("double")))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    rows = whole(usable(vectors, zeros=True)).withColumn("length", length)
    asked = whole(usable(queries, zeros=True)).withColumn("length", length)
    sent = vectors.sparkSession.sparkContext.broadcast(sample(rows, SEEDS, F.desc("length")))

    def thresholds(batches):
        for block in batches:
            floor = np.full(len(block), -np.inf)
            for dim, at in block.groupby("dim").indices.items():
                _, ids, points = sent.value.get(dim, (0, np.zeros(0, np.int64), np.zeros((0, dim))))
                if len(ids) > k:
                    got = products(matrix(block["q"].iloc[at]), points)
                    # the query itself, however often it is there
                    got[ids[None, :] == block["query_id"].to_numpy()[at][:, None]] = np.iinfo(np.int64).min
                    floor[at] = np.sort(got, axis=1)[:, -k]
            yield block.assign(floor=floor)

    asked = asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "dim", F.col("length").alias("q_length"))
    asked = cut(asked.mapInPandas(thresholds, "query_id long, q array<double>, dim int, q_length double, floor double"))
    # bands of similar length; a band of many rows is dealt out further by a hash
    band = F.floor(F.log2(F.greatest("length", F.lit(1.0))) * 4)
    sizes = rows.withColumn("band", band).groupBy("dim", "band")
    sizes = sizes.agg(F.ceil(F.count("*") / SHARD_ROWS).alias("chunks"), F.max("length").alias("longest"))
    # at most a few thousand bands exist: lengths of doubles span so many powers of two
    dealt = rows.withColumn("band", band).join(F.broadcast(sizes), ["dim", "band"])
    dealt = dealt.withColumn("shard", F.concat_ws(":", "band", F.pmod(F.xxhash64("vec_id", "v"), "chunks"))).select("dim", "shard", "vec_id", "v")
    shards = sizes.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    shards = shards.select("dim", F.concat_ws(":", "band", "chunk").alias("shard"), "longest")
    # a band whose longest vector cannot reach the floor at cosine one is not sent to the query
    most = F.col("q_length") * F.col("longest")
    able = ~(F.col("floor") > most + 1e-9 * (F.abs("floor") + most + 1))
    spread, asked = routed(dealt, asked, shards, able, QUERY_ROWS)

    def run(rows: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or block.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        found = bucket_top(rows["vec_id"].to_numpy(), matrix(rows["v"]), block["query_id"].to_numpy(), matrix(block["q"]), block["floor"].to_numpy(), k)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found, strict=True)))

    keys = ["dim", "shard", "part"]
    found = spread.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(lambda a, b: run(a, b), "query_id long, vec_id long, score long")
    return best(found, k, F.col("score").desc())
