"""Prompts and replies as a stream: a prompt waits in state until its user writes in its chat."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class WaitingPrompts(StatefulProcessor):
    """State per key: the prompts without a reply so far, as (seq, text)."""

    def __init__(self, keys: Sequence[str], wait_seconds: int | None = None) -> None:
        self.row = Row(*keys, "seq", "text", "reply_seq", "reply_text")
        self.wait_ms = None if wait_seconds is None else 1000 * wait_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getListState("waiting", "seq bigint, text string", self.wait_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        before = [(r[0], r[1]) for r in self.waiting.get()] if self.waiting.exists() else []
        new: list[tuple] = []
        answered = False
        for row in sorted(rows, key=lambda r: (r.seq, r.is_prompt)):
            if row.is_prompt:
                new.append((row.seq, row.text))
                continue
            for seq, text in before + new:
                yield self.row(*key, seq, text, row.seq, row.text)
            before, new, answered = [], [], True
        if answered:
            self.waiting.clear()
        if new:  # earlier ones stay as they are, with their own time to live
            self.waiting.appendList(new)

    def close(self) -> None:
        pass


def pair_replies_stream(
    messages: DataFrame, keys: Sequence[str] = ("chat_id", "username"), wait_seconds: int | None = None
) -> DataFrame:
    """Answered prompts of a stream of messages(<keys>, seq, is_prompt, text): reply_seq, reply_text.

    A prompt waits until it is answered, or with ``wait_seconds`` for that time on the clock; then it is
    forgotten, which bounds the state. See ``idle_runs`` of ``start_runs`` for queries that are to end.
    """
    types = {f.name: f.dataType.simpleString() for f in messages.schema.fields}
    out = ", ".join([f"{k} {types[k]}" for k in keys])
    rows = messages.select(*keys, F.col("seq").cast("long").alias("seq"), "is_prompt", "text")
    return rows.groupBy(*keys).transformWithState(
        WaitingPrompts(keys, wait_seconds),
        f"{out}, seq bigint, text string, reply_seq bigint, reply_text string",
        "Append",
        "None" if wait_seconds is None else "ProcessingTime",
    )
