"""Running stateful streams: the state store they need, and a run over all that is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from alertfold.plans.storage import scratch_path
from alertfold.sources.outbox import write_outbox, write_run

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State of stateful processors lives in RocksDB; a run stores its changes, not the whole state."""
    spark.conf.set(_PROVIDER, _ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def run_to_outbox(stream: DataFrame, key: str | None = None) -> DataFrame:
    """Run a stream over everything available into a new outbox, and read it; no rows where nothing came."""
    spark = stream.sparkSession
    use_rocksdb(spark)
    path, checkpoint = scratch_path(spark, "outbox"), scratch_path(spark, "checkpoint")
    query = write_outbox(stream, path, checkpoint, key)
    query.awaitTermination()
    write_run(spark.createDataFrame([], stream.schema), path, 0)
    return spark.read.schema(stream.schema).parquet(path).select(*stream.columns)
