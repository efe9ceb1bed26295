"""The message queue: an append-only table partitioned by chat, and message identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def message_id() -> Column:
    """Identity of a message: the same message always has the same id."""
    parts = [F.col(c).cast("string") for c in ("chat_id", "ts", "seq")]
    return F.sha2(F.concat_ws("|", *parts, "text"), 256)


def with_message_id(messages: DataFrame) -> DataFrame:
    """Add ``msg_id``."""
    return messages.withColumn("msg_id", message_id())


def enqueue(messages: DataFrame, path: str) -> None:
    """Append messages(chat_id, ts, seq, text) to the queue table.

    Rows are put together by ranges of chat and id, so there are about as many files as chats and tasks, and a
    hot chat is spread over several.
    """
    out = with_message_id(messages).select("chat_id", "msg_id", "ts", "seq", "text")
    ranges = out.repartitionByRange("chat_id", "msg_id")
    ranges.write.mode("append").partitionBy("chat_id").parquet(path)


_SCHEMA = "msg_id string, ts timestamp_ntz, seq bigint, text string, chat_id bigint"


def read_queue(spark: SparkSession, path: str) -> DataFrame:
    """Messages of the queue table."""
    return spark.read.schema(_SCHEMA).parquet(path)


def stream_queue(spark: SparkSession, path: str, max_bytes_per_trigger: int = 1 << 30) -> DataFrame:
    """The same as a stream. Each run takes a bounded number of bytes (and at least one file)."""
    return spark.readStream.schema(_SCHEMA).option("maxBytesPerTrigger", max_bytes_per_trigger).parquet(path)
