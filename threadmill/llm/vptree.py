"""Approximate nearest neighbours by vantage-point trees, one for each shard.

A tree is a table: rows of a shard in heap order, each with the radius that
halves what lies below it. A search prunes a half when its lower bound, by the
triangle inequality, times the relaxing factor exceeds the k-th distance so
far; factor one is exact. Shards hold rows near one another, and a query is
sent only to those that the same bound, from the root's reach, cannot exclude.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut
from .vectors import best, matrix, routed, sample, usable

#: Rows of a shard and queries of a block, about.
SHARD_ROWS, QUERY_ROWS = 8192, 4096
LEAF = 64
#: Rows of a dimension that seed a query's bound, and rows that part a dimension or a cell, at most.
SEEDS, CENTRES = 512, 512

#: Rows of a cell that meet its centres at once, and levels of cells at most: each parts a cell into up to ``CENTRES``.
PART_ROWS, LEVELS = 65_536, 4

CELLS = "dim int, cell string, vec_id long, v array<double>"
INDEX = "dim int, shard string, place int, vec_id long, v array<double>, radius double, reach double"


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of a and b, by their differences in double precision."""
    out = np.empty((len(a), len(b)))
    step = max(1, 2_000_000 // max(1, b.size))
    for k in range(0, len(a), step):
        with np.errstate(over="ignore"):
            out[k : k + step] = np.sqrt(((a[k : k + step, None, :] - b[None, :, :]) ** 2).sum(axis=-1))
    return out


def arrange(points: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Order of the points and radii: a node's vantage point comes first, then its inner half, then its outer half."""
    order = np.arange(len(points))
    radius = np.full(len(points), np.nan)
    stack = [(0, len(points))]
    while stack:
        low, high = stack.pop()
        if high - low <= LEAF:
            continue
        # of a few candidates the one with the widest spread of distances
        picks = rng.choice(high - low, 5, replace=False) + low
        probe = rng.choice(high - low, min(64, high - low), replace=False) + low
        spread = distances(points[order[picks]], points[order[probe]]).var(axis=1)
        at = picks[int(np.nanargmax(np.nan_to_num(spread)))]
        order[low], order[at] = order[at], order[low]
        d = distances(points[order[low : low + 1]], points[order[low + 1 : high]])[0]
        ranked = np.argsort(d, kind="stable")
        order[low + 1 : high] = order[low + 1 : high][ranked]
        half = len(d) // 2
        radius[low] = d[ranked[half]]
        stack += [(low + 1, low + 1 + half), (low + 1 + half, high)]
    return order, radius


def _finer(placed: DataFrame, shard_rows: int, level: int) -> tuple[DataFrame, bool]:
    """``placed`` (dim, cell, vec_id, v) with cells of many rows parted by centres of their own, and whether any was.

    A cell's centres are about as many of its rows as it needs shards, ``CENTRES``
    at most; they are picked by a hash, and its rows meet them in blocks.
    """
    sizes = placed.groupBy("dim", "cell").agg(F.count("*").alias("rows"))
    large = cut(sizes.where(F.col("rows") > 2 * shard_rows))
    if large.isEmpty():
        return placed, False
    found = placed.join(large, ["dim", "cell"])
    wanted = F.least(F.lit(CENTRES), F.ceil(F.col("rows") / shard_rows))
    hashed = F.pmod(F.xxhash64("vec_id", F.lit(level)), F.lit(1 << 30))
    # a few times as many as are wanted come to the window that picks them
    likely = found.withColumn("h", hashed).where(F.col("h") <= 4 * wanted / F.col("rows") * (1 << 30))
    order = Window.partitionBy("dim", "cell").orderBy("h", "vec_id")
    parts = F.ceil(F.col("rows") / PART_ROWS).cast("int")
    picked = likely.withColumn("n", F.row_number().over(order)).where(F.col("n") <= wanted)
    # new names, since both tables come from the same rows
    picked = picked.select(F.col("dim").alias("d"), F.col("cell").alias("c"), F.col("v").alias("centre"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("p"))
    dealt = found.select("dim", "cell", "vec_id", "v", F.pmod(F.xxhash64("vec_id", "v"), parts).cast("int").alias("part"))

    def part(rows: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or centres.empty:
            return rows[["dim", "cell", "vec_id", "v"]]
        c = matrix(centres["centre"].sort_values(key=lambda v: v.map(tuple)))
        nearest = ((c**2).sum(axis=1) - 2 * matrix(rows["v"]) @ c.T).argmin(axis=1)
        cell = rows["cell"] + "." + nearest.astype(str)
        return rows.assign(cell=cell)[["dim", "cell", "vec_id", "v"]]

    parted = dealt.groupBy("dim", "cell", "part").cogroup(picked.groupBy("d", "c", "p")).applyInPandas(lambda a, b: part(a, b), CELLS)
    rest = placed.join(large.select("dim", "cell"), ["dim", "cell"], "left_anti")
    return rest.select("dim", "cell", "vec_id", "v").unionByName(parted), True


def build(vectors: DataFrame, shard_rows: int = SHARD_ROWS, seed: int = 7) -> DataFrame:
    """Index of all usable rows: dim, shard, place, vec_id, v, radius (null in leaves) and reach.

    Vectors that are null, zero, or hold null or non-finite components take no
    part. Each row goes to the cell of the nearest of a few sampled rows; where
    the first cells are too few for all rows, they are parted again in the same
    way, level by level. Cells that cannot be parted, such as of equal rows, are
    dealt out by a hash; repeated ids stay repeated. The first row of a shard has the distance of
    its farthest row as its reach.
    """
    rows = usable(vectors, zeros=False)
    picks = sample(rows, CENTRES, F.xxhash64("vec_id"))
    cells = {dim: values[: -(-count // shard_rows)] for dim, (count, _, values) in picks.items()}
    centres = vectors.sparkSession.sparkContext.broadcast(cells)

    def place(batches):
        for block in batches:
            cell = np.zeros(len(block), np.int64)
            for dim, at in block.groupby("dim").indices.items():
                if dim in centres.value:
                    c = centres.value[dim]
                    cell[at] = ((c**2).sum(axis=1) - 2 * matrix(block["v"].iloc[at]) @ c.T).argmin(axis=1)
            yield block.assign(cell=cell.astype(str))[["dim", "cell", "vec_id", "v"]]

    def tree(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id", kind="stable")
        points = matrix(group["v"])
        order, radius = arrange(points, np.random.default_rng(seed))
        reach = np.full(len(order), np.nan)
        reach[0] = distances(points[order[:1]], points).max()
        group = group.iloc[order]
        group = group.assign(place=np.arange(len(group), dtype=np.int32), radius=radius, reach=reach)
        return group[[x.split()[0] for x in INDEX.split(", ")]]

    placed = cut(rows.select("vec_id", "v", "dim").mapInPandas(place, CELLS))
    # the first cells do where each needs few shards
    more, level = any(count > CENTRES * shard_rows for count, *_ in picks.values()), 0
    while more and level < LEVELS:
        level += 1
        finer, more = _finer(placed, shard_rows, level)
        placed = cut(finer) if more else placed
    sizes = placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / shard_rows).alias("chunks"))
    dealt = placed.join(sizes, ["dim", "cell"]).withColumn("shard", F.concat_ws(":", "cell", F.pmod(F.xxhash64("vec_id", "v"), "chunks")))
    return dealt.groupBy("dim", "shard").applyInPandas(lambda g: tree(g), INDEX)


class Searcher:
    """Searches one tree for a block of queries at a time."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, radius: np.ndarray, queries: np.ndarray, own: np.ndarray, limit: np.ndarray, k: int, factor: float):
        self.points, self.ids, self.radius, self.queries, self.own, self.limit, self.k, self.factor = points, ids, radius, queries, own, limit, k, factor
        self.near = np.full((len(queries), k), np.inf)
        self.rows = np.full((len(queries), k), -1, np.int64)

    def take(self, who: np.ndarray, rows: np.ndarray, d: np.ndarray) -> None:
        """Merge distances into the k best, ties to the smaller id."""
        d = np.where(self.ids[rows][None, :] == self.own[who][:, None], np.inf, d)
        better = (d <= self.near[who, -1][:, None]).any(axis=1)
        who, d = who[better], d[better]
        if not len(who):
            return
        near = np.concatenate([self.near[who], d], axis=1)
        found = np.concatenate([self.rows[who], np.broadcast_to(rows, d.shape)], axis=1)
        keys = np.where(found >= 0, self.ids[found], np.iinfo(np.int64).max)
        best = np.lexsort((keys, near), axis=1)[:, : self.k]
        self.near[who] = np.take_along_axis(near, best, 1)
        self.rows[who] = np.take_along_axis(found, best, 1)
        self.rows[who] = np.where(np.isinf(self.near[who]), -1, self.rows[who])

    def search(self) -> None:
        everyone = np.arange(len(self.queries))
        stack = [(0, len(self.points), everyone, np.zeros(len(everyone)))]
        while stack:
            low, high, who, bound = stack.pop()
            # equal distances may still win by their id, so only larger ones are pruned
            live = bound * self.factor <= np.minimum(self.near[who, -1], self.limit[who])
            who = who[live]
            if not len(who):
                continue
            if high - low <= LEAF:
                rows = np.arange(low, high)
                self.take(who, rows, distances(self.queries[who], self.points[rows]))
                continue
            d = distances(self.queries[who], self.points[low : low + 1])
            self.take(who, np.array([low]), d)
            d, mu = d[:, 0], self.radius[low]
            middle = low + 1 + (high - low - 1) // 2
            inside = d < mu
            inner = (low + 1, middle, who, np.maximum(0, d - mu))
            outer = (middle, high, who, np.maximum(0, mu - d))
            # last in, first out: each query sees its own side first
            for far, near, mine in ((outer, inner, inside), (inner, outer, ~inside)):
                if mine.any():
                    stack.append((*far[:2], who[mine], far[3][mine]))
                    stack.append((*near[:2], who[mine], near[3][mine]))


def search(index: DataFrame, queries: DataFrame, k: int = 10, factor: float = 1.0, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score, the Euclidean distance, of the k nearest rows found.

    ``queries`` has vec_id and embedding; unusable ones have no rows. A query
    meets rows of its own dimension alone, never rows of its own id, and all of
    them if they are fewer than k.
    """
    asked = usable(queries, zeros=False).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "dim")
    seeds = index.sparkSession.sparkContext.broadcast(sample(index, SEEDS, F.xxhash64("vec_id")))

    def bounds(batches):
        for block in batches:
            limit = np.full(len(block), np.inf)
            for dim, at in block.groupby("dim").indices.items():
                _, ids, points = seeds.value.get(dim, (0, np.zeros(0, np.int64), np.zeros((0, dim))))
                if len(ids) >= k:
                    d = distances(matrix(block["q"].iloc[at]), points)
                    d[ids[None, :] == block["query_id"].to_numpy()[at][:, None]] = np.inf
                    # a little above the distance itself, so that rounding cannot exclude its row
                    limit[at] = np.partition(d, k - 1, axis=1)[:, k - 1] * (1 + 1e-9)
            yield block.assign(limit=limit)

    asked = cut(asked.mapInPandas(bounds, "query_id long, q array<double>, dim int, limit double"))
    shards = index.where("place = 0").select("dim", "shard", F.col("v").alias("root"), "reach")
    gap = F.sqrt(F.aggregate(F.zip_with("q", "root", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda n, x: n + x))
    far = (gap * (1 - 1e-9) - F.col("reach")) * factor > F.col("limit")
    spread, sent = routed(index.drop("reach"), asked, shards, F.isnan(gap) | ~far, query_rows)

    def run(tree: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if tree.empty or block.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        tree = tree.sort_values("place")
        ids, own = tree["vec_id"].to_numpy(), block["query_id"].to_numpy()
        s = Searcher(matrix(tree["v"]), ids, tree["radius"].to_numpy(float), matrix(block["q"]), own, block["limit"].to_numpy(float), k, factor)
        s.search()
        who, column = np.nonzero(s.rows >= 0)
        return pd.DataFrame({"query_id": own[who], "vec_id": ids[s.rows[who, column]], "score": s.near[who, column]})

    keys = ["dim", "shard", "part"]
    found = spread.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInPandas(lambda a, b: run(a, b), "query_id long, vec_id long, score double")
    return best(found, k, F.col("score"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, factor: float = 1.0) -> DataFrame:
    return search(cut(build(vectors)), queries, k, factor)
