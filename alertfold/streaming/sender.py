"""The sender: every tick, what came in for a chat is compacted and put into the outbox."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from alertfold.operators.folding import compact, to_outbox
from alertfold.options import Options
from alertfold.sources.outbox import start_runs, write_run


def send_batches(
    messages: DataFrame,
    path: str,
    checkpoint: str,
    opts: Options = Options(),
    mute_log: Callable[[], DataFrame] | None = None,
    every: str | None = None,
) -> StreamingQuery:
    """Start compacting a stream of messages(chat_id, ts, seq, text), one tick per trigger.

    ``every`` is the tick, ``f'{opts.wait} seconds'`` for a sender that stays; ``mute_log`` is read anew for
    each tick. The source's trigger limit bounds a tick.
    """

    def run(rows: DataFrame, batch_id: int) -> None:
        muted = mute_log() if mute_log else None
        write_run(to_outbox(compact(rows, opts, muted, tick=batch_id)), path, batch_id)

    return start_runs(messages, run, checkpoint, every)


def with_arrival_order(messages: DataFrame) -> DataFrame:
    """Add ``seq`` to spool messages, which have a file time and a name but no number: a hash of
    the name decides ties, the same way in every run."""
    return messages.withColumn("seq", F.xxhash64("msg_id"))
