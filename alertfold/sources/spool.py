"""The message spool: one directory per chat, one file per message, texts as they are, byte by byte."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertfold.deploy import ship
from alertfold.sources.spool_files import MUTE_MARKER, SpoolSource

__all__ = ["MUTE_MARKER", "read_spool", "stream_spool", "write_spool"]


def _known(spark: SparkSession) -> SparkSession:
    ship(spark)
    spark.dataSource.register(SpoolSource)
    return spark


def _messages(files: DataFrame) -> DataFrame:
    # a cast leaves the bytes alone, whether they are valid UTF-8 or not
    return files.select("chat_id", "msg_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("content").cast("string").alias("text"))


def read_spool(spark: SparkSession, path: str, slices: int = 4) -> DataFrame:
    """Messages of a spool: chat_id, msg_id (file name), ts (file time), text (whole content, empty ones too).

    ``slices`` tasks share the files of a chat.
    """
    return _messages(_known(spark).read.format("spool").option("slices", slices).load(path))


def stream_spool(
    spark: SparkSession,
    path: str,
    max_files_per_trigger: int = 10_000,
    after: str = "delete",
    archive: str | None = None,
    quiet_seconds: float = 0,
) -> DataFrame:
    """The same as a stream of new files; a run takes at most ``max_files_per_trigger``, the oldest first.

    Files of a run are deleted once the next run begins or the query starts again (``after="delete"``), moved to
    the folder ``archive`` (``after="archive"``), or left (``after="keep"``: then their names are kept for good).
    A failure between taking and handling files neither loses nor doubles them, as long as the query starts
    again with its checkpoint. One query reads a spool at a time. Files younger than ``quiet_seconds`` wait,
    for writers that don't rename files into place.

    A query that ends (trigger ``availableNow``) makes one run.
    """
    reader = _known(spark).readStream.format("spool").option("maxFilesPerTrigger", max_files_per_trigger)
    reader = reader.option("after", after).option("quietSeconds", quiet_seconds)
    return _messages((reader.option("archive", archive) if archive else reader).load(path))


def write_spool(messages: DataFrame, path: str) -> None:
    """Add messages(chat_id, text) to a spool, one file each; null texts are empty. All of them appear at the end."""
    out = messages.select(
        F.col("chat_id").cast("long").alias("chat_id"), F.coalesce("text", F.lit("")).cast("binary").alias("content")
    )
    _known(messages.sparkSession)
    out.write.format("spool").mode("append").save(path)
