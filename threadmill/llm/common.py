"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that one step takes at most, but a row at least: texts can be long, so a step stays small.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def own_name(df: DataFrame, name: str) -> str:
    """``name``, or one like it, for a helper column beside those of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def steps(batches: Iterable[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows and about ``BATCH_BYTES``."""
    for batch in batches:
        each = max(1, min(rows, BATCH_BYTES * batch.num_rows // max(1, batch.nbytes)))
        for low in range(0, batch.num_rows, each):
            yield batch.slice(low, each)


def give_back() -> None:
    """Return freed memory to the system: a worker lives on, and would keep it from one stage to the next."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's shared checkpoint folder and read it from there.

    The folder is the session's ``spark.checkpoint.dir``; only where that is
    unset (tests on one machine) a temporary folder is made.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if spark.conf.get("spark.checkpoint.dir", None) is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id's decimal text leaves 1 modulo 3; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def per_batch(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str
) -> DataFrame:
    """mapInArrow with a function that is made once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in steps(batches):
            out = step(batch)
            if out is not None and out.num_rows:
                yield out
        del step
        give_back()

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """Texts of an Arrow string column as UTF-8; null reads as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """doc_id, label and text of about ``bound`` ids at most, picked by a hash; ids held out are never among them.

    Of several texts of one id the least is taken, and of equal texts one, so
    that large groups of copies do not outweigh the rest; it has label 1 if any has.
    """
    usable = labels.where(~held_out() & F.col(label).isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), label)
    rows = usable.count()
    if rows > bound:
        usable = usable.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) < int(bound / rows * (1 << 30)))
    usable = usable.groupBy("doc_id").agg(F.max(label).alias("label"))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # the broadcast side holds no more ids than the bound
    rows = text.join(F.broadcast(usable), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return rows.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("label").alias("label")).select("doc_id", "label", "text")
