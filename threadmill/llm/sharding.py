"""Shards of near-equal bytes by Karmarkar-Karp differencing of indivisible groups.

Rows of equal text are one group and stay together. Groups that hold a
noticeable share of all bytes or rows are items of their own. The others are
differenced within their partition into bundles of about one grain. Items and
bundles are few, whatever the table's size, so one last differencing deals
them out to the shards. In both, the two partial partitions of the largest
spread are combined again and again, in opposite order.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from .common import cut

#: Bytes that each row counts for beside its text.
ROW_BYTES = 8
#: Grains of a shard: a group of at least one grain of the bytes or of the rows is an item of its own.
GRAINS = 1000
#: Groups that are differenced together, so that a task's memory stays bounded.
TOGETHER = 1 << 16
#: So many places of shards in partitions are sent to every task at most; more are joined by a shuffle.
SENT_OFFSETS = 500_000


def difference(sizes: np.ndarray, ways: int) -> np.ndarray:
    """The way of each size, so that the ways' sums come out near equal."""
    n = len(sizes)
    if ways <= 1 or n <= 1:
        return np.zeros(n, np.int64)
    heap = [(-int(s), k) for k, s in enumerate(sizes)]
    heapq.heapify(heap)
    # a partial partition is its non-zero sums from the largest down, and the node of each sum;
    # nodes below n are sizes, each later one stands for two that were added up
    parts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    first, second = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    free, made = n, n

    def take() -> tuple[np.ndarray, np.ndarray]:
        _, k = heapq.heappop(heap)
        return parts.pop(k) if k in parts else (np.array([sizes[k]], np.int64), np.array([k], np.int64))

    while len(heap) > 1:
        (a, x), (b, y) = take(), take()
        if len(a) < len(b):
            (a, x), (b, y) = (b, y), (a, x)
        # the largest of one goes to the smallest of the other, first of all to ways that are free
        alone = min(len(b), ways - len(a))
        sums, nodes = np.concatenate([a, b[:alone]]), np.concatenate([x, y[:alone]])
        if both := len(b) - alone:
            at = np.arange(len(a) - 1, len(a) - 1 - both, -1)
            # no more than n - 1 of these are made in all
            fresh = slice(free - n, free - n + both)
            first[fresh], second[fresh] = x[at], y[alone:]
            sums[at] += b[alone:]
            nodes[at] = np.arange(free, free + both)
            free += both
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        parts[made] = sums, nodes
        heapq.heappush(heap, (int((sums[-1] if len(sums) == ways else 0) - sums[0]), made))
        made += 1
    _, nodes = take()
    way = np.full(free, -1, np.int64)
    way[nodes] = np.arange(len(nodes))
    for k in range(free - 1, n - 1, -1):
        way[first[k - n]] = way[second[k - n]] = way[k]
    return way[:n]


def deal(sizes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each size, in falling order: one that is more than an even share of the rest stands alone, the rest are differenced."""
    alone, rest = 0, int(sizes.sum())
    while alone < min(len(sizes), shards - 1) and int(sizes[alone]) * (shards - alone) >= rest:
        rest -= int(sizes[alone])
        alone += 1
    return np.concatenate([np.arange(alone), alone + difference(sizes[alone:], shards - alone)])


BUNDLES = "key long, part long, lane int, bytes long"


def _bundles(groups: DataFrame, grain: int, together: int) -> DataFrame:
    """part and lane of each group (key, bytes), and with a null key the bytes of each lane of a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def settle() -> pa.RecordBatch:
            keys, sizes = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            lanes = difference(sizes, max(1, -(-int(sizes.sum()) // grain)))
            each = int(lanes.max()) + 1
            sums = np.zeros(each, np.int64)
            np.add.at(sums, lanes, sizes)
            return pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([pa.array(keys, pa.int64()), pa.nulls(each, pa.int64())]),
                    pa.array(np.full(len(keys) + each, part)),
                    pa.array(np.concatenate([lanes, np.arange(each)]).astype(np.int32)),
                    pa.concat_arrays([pa.nulls(len(keys), pa.int64()), pa.array(sums, pa.int64())]),
                ],
                names=["key", "part", "lane", "bytes"],
            )

        for batch in batches:
            for low in range(0, batch.num_rows, together):
                some = batch.slice(low, together)
                held.append(tuple(some.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)))
                if sum(len(k) for k, _ in held) >= together:
                    yield settle()
                    part += 1
        if held:
            yield settle()

    # in a fixed order, so that a task that is run again gives the same bundles
    return groups.select("key", "bytes").sortWithinPartitions("key").mapInArrow(run, BUNDLES)


def _placed(keyed: DataFrame, shards: int, together: int) -> DataFrame:
    """``keyed`` (with size and key) with the shard of its group."""
    spark = keyed.sparkSession
    groups = cut(keyed.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")))
    total = groups.agg(F.sum("bytes"), F.sum("rows")).first()
    parts = shards * GRAINS
    grain, many = max(1, -(-(total[0] or 0) // parts)), max(1, -(-(total[1] or 0) // parts))
    alone = (F.col("bytes") >= grain) | (F.col("rows") >= many)
    # at most one in each grain of the bytes and one in each grain of the rows
    single = groups.where(alone).select("key", "bytes").collect()
    lanes = cut(_bundles(groups.where(~alone), grain, together))
    # a bundle for each grain, and one for each batch of groups that is smaller than that
    bundles = lanes.where("key IS NULL").select("part", "lane", "bytes").collect()
    items = sorted([(r["bytes"], 0, r["key"], 0) for r in single] + [(r["bytes"], 1, r["part"], r["lane"]) for r in bundles], reverse=True)
    ways = deal(np.array([x[0] for x in items], np.int64), shards).tolist()
    of_single = [(x[2], w) for x, w in zip(items, ways, strict=True) if not x[1]]
    of_lane = [(*x[2:], w) for x, w in zip(items, ways, strict=True) if x[1]]
    singles = F.broadcast(spark.createDataFrame(of_single, "key long, shard int"))
    placed = F.broadcast(spark.createDataFrame(of_lane, "part long, lane int, shard int"))
    small = lanes.where("key IS NOT NULL").select("key", "part", "lane").join(placed, ["part", "lane"]).select("key", "shard")
    # rows of large groups never meet in one task; of the others none has a grain of the rows
    few = keyed.join(singles.select("key"), "key", "left_anti").join(small, "key")
    return keyed.join(singles, "key").unionByName(few)


def _numbered(placed: DataFrame, shards: int) -> DataFrame:
    """``placed``, which must be written, with slot: gapless from 0 in each shard, without gathering a shard."""
    here = placed.withColumn("__part", F.spark_partition_id())
    counted = here.groupBy("__part", "shard").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("__part", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__offset"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1, np.int64)
        for batch in batches:
            shard = batch.column(batch.schema.get_field_index("shard")).to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(shard):
                continue
            counts = np.bincount(shard, minlength=len(seen))
            seen = np.concatenate([seen, np.zeros(len(counts) - len(seen), np.int64)])
            order = np.argsort(shard, kind="stable")
            place = np.empty(len(shard), np.int64)
            place[order] = np.arange(len(shard)) - np.repeat(np.cumsum(counts) - counts, counts)
            yield batch.append_column("__place", pa.array(place + seen[shard]))
            seen += counts

    local = here.mapInArrow(run, StructType([*here.schema.fields, StructField("__place", LongType())]))
    # a row for each partition and shard
    if placed.rdd.getNumPartitions() * shards <= SENT_OFFSETS:
        offsets = F.broadcast(offsets)
    return local.join(offsets, ["__part", "shard"]).withColumn("slot", F.col("__place") + F.col("__offset")).drop("__part", "__place", "__offset")


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def assign(docs: DataFrame, shards: int = 24, with_text: bool = False, together: int = TOGETHER) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each row, with its text if asked for.

    Sizes are bytes of text and ``ROW_BYTES`` a row. The law is ``bytes``: the
    shards' sums come out near equal, and since any change of the table may move
    any group, grown_shard is null. ``docs`` needs doc_id and text; other
    columns are left out, whatever their names. A null text counts as an empty
    one and is in its group; rows with a null or repeated id are kept as they
    are. A group that is larger than a shard's share has a shard of its own. No
    rows give no rows; with fewer groups than shards some shards have none.
    Groups go by a 64-bit hash: two texts that share one would stay together,
    which breaks nothing.
    """
    if shards < 1:
        raise ValueError("there must be a shard")
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(_text()) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(_text().cast("binary")).alias("text_crc32"),
        F.xxhash64(_text()).alias("key"),
        *([F.col("text").cast("string").alias("text")] if with_text else []),
    )
    # texts are read once; what follows works on a few numbers a row
    placed = cut(_placed(cut(keyed), shards, together).drop("key"))
    return _numbered(placed, shards).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        *(["text"] if with_text else []),
    )


def write(docs: DataFrame, folder: str, shards: int = 24) -> None:
    """The rows with their texts as Parquet, a folder a shard."""
    assign(docs, shards, with_text=True).write.partitionBy("shard").parquet(folder)
