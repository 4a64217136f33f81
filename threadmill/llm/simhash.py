"""Near-duplicate detection on SimHash fingerprints with pivot distance tables.

Fingerprints that differ in at most ``bits`` bits agree on some blocks of
theirs whole, so equal block groups bring every such pair together in some
bucket. Inside a bucket each fingerprint carries its Hamming distances to many
reference fingerprints: no coordinate of a linked pair differs by more than
``bits``, so pairs with a larger difference are discarded and only survivors
are compared bit by bit. Equal fingerprints are one node throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, own_name, per_batch, utf8
from .components import components

SEED = 42
#: Rows of a bucket that one task compares at most; a larger bucket is dealt out as pairs of chunks.
BUCKET_ROWS = 8192
#: Rows that a task holds before it compares the buckets that are complete.
HELD_ROWS = 1_000_000
REFERENCES = 16


def shingle_hashes(text: bytes, width: int) -> bytes:
    """Hashes of the text's shingles, eight bytes each; none without words."""
    words = text.lower().split()
    if not words:
        return b""
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) <= width:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: len(words) - width] + 1).tolist()]
    return b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)])


def fingerprint(text: bytes, width: int) -> bytes:
    """Eight bytes: each bit is the majority over the hashes of the text's shingles."""
    hashes = shingle_hashes(text, width)
    if len(hashes) <= 8:
        return hashes or bytes(8)
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
    return np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(bits)).tobytes()


def fingerprints(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id and fp, a signed 64-bit fingerprint of word shingles.

    Words are runs without ASCII white space, A-Z in lower case. A text of
    fewer words than ``width`` is one shingle; without words, or null, its
    fingerprint is zero. Rows are kept one to one, columns other than doc_id
    and text are left out.
    """

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = b"".join([fingerprint(t, width) for t in utf8(batch.column(1))])
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.frombuffer(found, ">i8").astype(np.int64))], names=["doc_id", "fp"]
            )

        return step

    return per_batch(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")),
        make,
        "doc_id long, fp long",
    )


def references(n: int = REFERENCES) -> np.ndarray:
    """Reference fingerprints from a fixed rule, so that every task has the same ones."""
    return np.array([xxhash.xxh64_intdigest(b"reference %d" % k, SEED) for k in range(n)], np.uint64)


def _block_masks(bits: int) -> list[int]:
    """Masks over two of bits + 2 blocks: at most ``bits`` differing bits leave two blocks whole."""
    edges = [round(64 * k / (bits + 2)) for k in range(bits + 3)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return [a | b for a, b in combinations(blocks, 2)]


def _linked(fp: np.ndarray, group: np.ndarray, bits: int, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and the root each is linked to here; groups are runs of equal numbers."""
    values, node = np.unique(fp, return_inverse=True)
    table = np.bitwise_count(values[:, None] ^ pivots[None, :]).astype(np.int8)
    order = np.lexsort((table[node, 0], group))
    node, group = node[order], group[order]
    first = table[node, 0]
    root = np.arange(len(values))
    rows = np.arange(len(node))
    step = 0
    while True:
        step += 1
        rows = rows[rows + step < len(node)]
        rows = rows[group[rows] == group[rows + step]]
        # rows are in order of the first coordinate, so no later row comes near again
        rows = rows[first[rows + step] - first[rows] <= bits]
        if not len(rows):
            break
        a, b = node[rows], node[rows + step]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
        near = np.abs(table[a] - table[b]).max(axis=1, initial=0) <= bits
        a, b = a[near], b[near]
        near = np.bitwise_count(values[a] ^ values[b]) <= bits
        for x, y in zip(a[near].tolist(), b[near].tolist(), strict=True):
            while root[x] != x:
                x = root[x]
            while root[y] != y:
                y = root[y]
            root[max(x, y)] = min(x, y)
        if near.any():
            while (root != (up := root[root])).any():
                root = up
    moved = np.flatnonzero(root != np.arange(len(root)))
    return values[moved], values[root[moved]]


def links(prints: DataFrame, bits: int = 4) -> DataFrame:
    """Edges (u, v) that connect whatever fingerprints differ in at most ``bits`` bits.

    ``prints`` has a column fp. Each edge joins fingerprints of one component;
    of the links in a bucket a spanning forest is given, never all pairs.
    Null fingerprints take no part.
    """
    spark = prints.sparkSession
    masks = _block_masks(bits)
    distinct = prints.where("fp IS NOT NULL").select("fp").distinct()
    # the mask's number goes with the masked bits, since masks may leave equal bits
    keys = F.array(
        *[F.struct(F.lit(i).cast("int").alias("mask"), F.col("fp").bitwiseAND(_signed(m)).alias("part")) for i, m in enumerate(masks)]
    )
    rows = cut(distinct).select("fp", F.explode(keys).alias("k")).select("fp", "k.mask", "k.part")
    hot = cut(rows.groupBy("mask", "part").count().where(F.col("count") > BUCKET_ROWS))
    if hot.isEmpty():
        dealt = rows.withColumn("cell", F.lit(0).cast("long"))
    else:
        chunks = F.coalesce(F.ceil(F.col("count") / (BUCKET_ROWS // 2)), F.lit(1)).cast("long")
        mine = F.pmod(F.xxhash64("fp"), "chunks")
        other = F.col("other")
        dealt = (
            rows.join(hot, ["mask", "part"], "left")
            .withColumn("chunks", chunks)
            .withColumn("mine", mine)
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
            .withColumn("cell", F.least("mine", other) * F.col("chunks") + F.greatest("mine", other))
            .select("fp", "mask", "part", "cell")
        )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, "mask", "part", "cell").sortWithinPartitions("mask", "part", "cell")
    pivots = references()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0

        def compare(last: bool) -> pa.RecordBatch:
            nonlocal count
            columns = [np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in held]) for k in range(4)]
            new = np.zeros(len(columns[0]), bool)
            new[:1] = True
            for c in columns[1:]:
                new[1:] |= c[1:] != c[:-1]
            # the last bucket may go on in the next batch
            end = len(new) if last else int(np.flatnonzero(new)[-1])
            held.clear()
            if end < len(new):
                held.append(pa.RecordBatch.from_arrays([pa.array(c[end:]) for c in columns], names=["fp", "mask", "part", "cell"]))
            count = len(new) - end
            u, v = _linked(columns[0][:end].astype(np.int64).view(np.uint64), np.cumsum(new)[:end], bits, pivots)
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (u, v)], names=["u", "v"])

        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= HELD_ROWS:
                yield compare(False)
        if count:
            yield compare(True)

    return dealt.select("fp", "mask", "part", "cell").mapInArrow(run, "u long, v long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def groups(docs: DataFrame, width: int = 5, bits: int = 4) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id among all that links reach.

    One row for each row of ``docs``. Texts without words share fingerprint zero
    and are linked like any others. A null doc_id is never a component's name;
    a group that has no other id has a null component_id.
    """
    prints = cut(fingerprints(docs, width))
    named = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = cut(components(links(named, bits)))
    reached = roots.join(named, roots.node == named.fp)
    name = reached.groupBy("root").agg(F.min("least").alias("component"))
    joined = reached.join(name, "root").select(F.col("fp"), "component")
    label = named.join(joined, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id"))
    return prints.join(label, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, width: int = 5, bits: int = 4) -> DataFrame:
    """``docs`` with one document of each group, that of the smallest doc_id.

    Repeated rows of that id count once, but other texts of it stay, since they
    may be of another group; rows without an id are kept, since no group can
    name them.
    """
    first = groups(docs, width, bits).where("doc_id = component_id").select("doc_id").distinct()
    body = own_name(docs, "__text")
    named = docs.withColumn(body, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))).join(first, "doc_id", "left_semi")
    named = named.dropDuplicates(["doc_id", body])
    return named.select(docs.columns).unionByName(docs.where("doc_id IS NULL"))
