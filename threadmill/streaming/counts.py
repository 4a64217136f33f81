"""Message counts of chats, kept up by a stream, so that marks and ranges need not scan messages for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..sources import messages

COUNTS = "chat_url string, message_count long, assistant_count long"
#: A whole table is written each time so many batches have changed a part of it.
EVERY = 20


def _read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(f"{COUNTS}, whole boolean, batch long").parquet(folder)


def _latest(rows: DataFrame) -> DataFrame:
    base = rows.where("whole").agg(F.max("batch")).first()[0]
    base = -1 if base is None else base
    # the last whole table and what changed after it; both are partition columns
    live = rows.where((F.col("whole") & (F.col("batch") == base)) | (~F.col("whole") & (F.col("batch") > base)))
    newest = live.groupBy("chat_url").agg(F.max_by(F.struct("message_count", "assistant_count"), "batch").alias("c"))
    return newest.select("chat_url", "c.message_count", "c.assistant_count")


def maintained(spark: SparkSession, folder: str) -> DataFrame:
    """chat_url, message_count and assistant_count as ``messages.counts`` gives them, from what ``maintain`` has written."""
    return _latest(_read(spark, folder))


def maintain(stream: DataFrame, folder: str, checkpoint: str, every: int = EVERY) -> DataStreamWriter:
    """Keep counts of a stream that gives each message once.

    A batch writes the counts that it changed under its number, and a batch that
    is run again overwrites its own. Only counts are kept as state.
    """

    def log(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/whole=false/batch={number}")
        if number % every == every - 1:
            rows = _read(batch.sparkSession, folder).where(F.col("batch") <= number).where(~F.col("whole") | (F.col("batch") < number))
            _latest(rows).write.mode("overwrite").parquet(f"{folder}/whole=true/batch={number}")

    return messages.counts(stream).writeStream.outputMode("update").foreachBatch(log).option("checkpointLocation", checkpoint)
