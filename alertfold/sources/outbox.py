"""The outbox: what is to be sent or deleted. Every run of a stream owns one directory of it and replaces
that directory when the run is repeated, so a failure between writing and committing leaves no doubles.
Directories are named by the stream, whose id its checkpoint keeps, and by the run, so that several streams and
streams that begin anew share an outbox."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

_STREAM = "sql.streaming.queryId"
_IDLE_RUNS = "spark.sql.streaming.noDataMicroBatches.enabled"


class FirstOfKey(StatefulProcessor):
    """Lets the first row of a key through, and forgets the key ``keep_seconds`` later."""

    def __init__(self, keep_seconds: int) -> None:
        self.keep_seconds = keep_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean", 1000 * self.keep_seconds)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        if not self.seen.exists():
            self.seen.update((True,))
            yield next(rows)
        for _ in rows:  # the others are read to their end and left out
            pass

    def close(self) -> None:
        pass


def write_run(rows: DataFrame, path: str, batch_id: int) -> None:
    """Write the rows of one run of the stream that is running, or of none."""
    stream = rows.sparkSession.sparkContext.getLocalProperty(_STREAM)
    rows.write.mode("overwrite").parquet(f"{path}/run={stream or 'table'}-{batch_id}")


def start_runs(
    stream: DataFrame,
    run: Callable[[DataFrame, int], None],
    checkpoint: str,
    every: str | None = None,
    idle_runs: bool = True,
) -> StreamingQuery:
    """Call ``run`` per trigger. ``every`` is the tick ('10 seconds'); without it, all that is there is taken
    and the query ends.

    State that expires by the clock always asks for another run, so that such a query would not end: without
    ``every`` it needs ``idle_runs`` off, and forgets when the next rows come.
    """
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    conf = stream.sparkSession.conf
    before = conf.get(_IDLE_RUNS)
    conf.set(_IDLE_RUNS, before if idle_runs else "false")
    try:
        return writer.start()  # which takes its own copy of the settings
    finally:
        conf.set(_IDLE_RUNS, before)


def write_outbox(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    key: str | None = None,
    every: str | None = None,
    keep_seconds: int | None = None,
    idle_runs: bool = True,
) -> StreamingQuery:
    """Start writing a stream to the outbox.

    With ``key``, a row whose key was seen before is left out, also across runs: the keys are kept in the
    query's state, so a run costs its own rows and not a scan of the outbox. They are kept for good, or with
    ``keep_seconds`` for that time on the clock after the row that passed: choose it longer than a message can
    come again, and the state stays as large as that time's messages.
    """
    rows = stream
    if key is not None and keep_seconds is None:
        rows = stream.dropDuplicates([key])
    elif key is not None:
        rows = stream.groupBy(key).transformWithState(FirstOfKey(keep_seconds), stream.schema, "Append", "ProcessingTime")
    expires = key is not None and keep_seconds is not None
    idle_runs = idle_runs and not (expires and every is None)
    return start_runs(rows, lambda part, batch_id: write_run(part, path, batch_id), checkpoint, every, idle_runs)
