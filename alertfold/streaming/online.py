"""Online compaction: every message is decided on as it arrives, against the recent history of its chat."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby, islice, repeat
from typing import TYPE_CHECKING

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from alertfold.functions.distance import epoch_micros
from alertfold.functions.templates import ONLINE_FOOTER
from alertfold.operators.mutes import apply_mutes, drop_muted
from alertfold.options import Options
from alertfold.plans.ordered import shuffle_tasks
from alertfold.plans.storage import scratch_path
from alertfold.streaming.history import BEGIN, ENTRIES, History
from alertfold.streaming.mutes import hear
from alertfold.streaming.packs import frame, in_order, packed, rows_of, unpacked
from alertfold.streaming.rules import Entry, decide

if TYPE_CHECKING:
    import pandas as pd

OUTBOX = (
    "chat_id bigint, seq bigint, action string, message_id int, text string,"
    " is_group boolean, pattern string, cnt int"
)
_STATE_ONLY = f"last_id int, cut bigint, bucket bigint, {ENTRIES}"
_FIELDS = [field.split()[0] for field in OUTBOX.split(", ")]
_ROWS_AT_ONCE = 2_000
_ENTRY_NAMES = ["message_id", "text", "micros", "pattern", "cnt"]
_ENTRY = pa.struct(zip(_ENTRY_NAMES, [pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int32()]))
_ARROW = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.int32()]
_ARROW += [pa.int32(), pa.int64(), pa.int64(), pa.list_(_ENTRY)]


def decisions(chat_id: int, messages: Iterable[tuple[int, int, str]], history: History, opts: Options) -> Iterator[tuple]:
    """Outbox rows for messages (micros, seq, text) of one chat in order; the history goes along."""
    for micros, seq, text in messages:
        chosen = decide(text, history.recent(micros), opts)
        history.last_id += 1
        sent = chosen.text if chosen.pattern is None else f"{chosen.pattern}{ONLINE_FOOTER}{chosen.cnt}"
        for old in chosen.replaces:
            yield chat_id, seq, "DELETE", old, None, None, None, None
        yield chat_id, seq, "SEND", history.last_id, sent, chosen.pattern is not None, chosen.pattern, chosen.cnt
        history.remove(chosen.replaces)
        history.add(Entry(history.last_id, sent, micros, chosen.pattern, chosen.cnt))


class OnlineCompaction(StatefulProcessor):
    """State per chat: the sent messages young enough to matter, by minute, and the last message id given out.

    Decisions of a chat depend on each other, so a chat is one sequence; chats run in parallel. The rows of
    one call are those of one chat in one trigger; they come and go in packs and are sorted through files, so that
    no more than the recent history is held. A run reads the newest minutes as far as decisions look and writes the
    minutes it has changed, however long the history is.
    """

    def __init__(self, opts: Options, quiet_seconds: int | None = None) -> None:
        self.opts, self.quiet_ms = opts, None if quiet_seconds is None else 1000 * quiet_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.index = handle.getValueState("index", "last_id int, cut bigint, seen bigint, buckets array<bigint>")
        self.minutes = handle.getMapState("minutes", "bucket bigint", ENTRIES)

    # the store of a History

    def load(self, bucket: int) -> list[tuple]:
        return [tuple(row) for row in self.minutes.getValue((bucket,))[0]]

    def save(self, bucket: int, entries: list[tuple]) -> None:
        self.minutes.updateValue((bucket,), (entries,))

    def drop(self, bucket: int) -> None:
        self.minutes.removeKey((bucket,))

    def _index(self) -> tuple[int, int, int, list[int]]:
        if not self.index.exists():
            return 0, BEGIN, 0, []
        last_id, cut, seen, buckets = self.index.get()
        return last_id, cut, seen, list(buckets)

    def _is_quiet(self, seen: int, timerValues: object) -> bool:
        return self.quiet_ms is not None and seen + self.quiet_ms <= timerValues.getCurrentProcessingTimeInMs()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        held: list[bytes] = []
        messages = in_order(_messages(rows, held), ["micros", "seq"])
        some = list(islice(messages, _ROWS_AT_ONCE))  # by now all packs are read
        if not self.index.exists():
            self._begin(held, timerValues)
        last_id, cut, seen, buckets = self._index()
        if self._is_quiet(seen, timerValues):  # and its timer has not fired yet
            self.minutes.clear()
            buckets = []
        history = History(self, buckets, cut, last_id, self.opts)
        while some:
            yield frame(_outbox(list(decisions(_chat_id(key[0]), some, history, self.opts))))
            history.forget(some[-1][0])
            some = list(islice(messages, _ROWS_AT_ONCE))
        history.settle()
        if self.quiet_ms is not None:
            seen = timerValues.getCurrentProcessingTimeInMs()
            self.handle.registerTimer(seen + self.quiet_ms)
        self.index.update((history.last_id, history.cut, seen, history.buckets))

    def _begin(self, held: list[bytes], timerValues: object) -> None:
        """Buckets of a history that was built elsewhere, or none; only a chat that is new takes them."""
        last_id, cut, seen, buckets = self._index()
        for row in (row for pack in held for b in rows_of(pack) for row in b.to_pylist()):
            last_id, cut = max(last_id, row["last_id"]), max(cut, row["cut"])
            if row["bucket"] is not None:
                self.save(row["bucket"], [tuple(e[n] for n in _ENTRY_NAMES) for e in row["entries"]])
                buckets.append(row["bucket"])
        if held:
            seen = seen if self.quiet_ms is None else timerValues.getCurrentProcessingTimeInMs()
            self.index.update((last_id, cut, seen, sorted(buckets)))

    def handleExpiredTimer(
        self, key: tuple, timerValues: object, expiredTimerInfo: object
    ) -> Iterator[pd.DataFrame]:
        """Forget the history of a chat that has been quiet, but not its last id."""
        last_id, cut, seen, buckets = self._index()
        if self._is_quiet(seen, timerValues):
            self.minutes.clear()
            self.index.update((last_id, cut, seen, []))
        return iter(())

    def close(self) -> None:
        pass


def _messages(parts: Iterable[pd.DataFrame], held: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Packs of messages; those of a history that a chat begins with are put aside."""
    for part in parts:
        for pack, begins in zip(part["pack"], part.get("held", repeat(False))):
            if begins:
                held.append(pack)
            else:
                yield from rows_of(pack)


def _outbox(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(_FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, _ARROW)], _FIELDS)


def _chat_id(key: str) -> int | None:
    return int(key) if key else None


def _by_chat(rows: DataFrame) -> DataFrame:
    """(chat, pack) per chat; the chat as a text, as keys must not be null."""
    return packed(rows.withColumn("chat", F.coalesce(F.col("chat_id").cast("string"), F.lit(""))).drop("chat_id"), "chat")


def _timed(messages: DataFrame) -> DataFrame:
    return messages.select(
        F.col("chat_id").cast("long").alias("chat_id"),
        F.col("seq").cast("long").alias("seq"),
        "text",
        epoch_micros(messages).alias("micros"),
    )


def compact_stream(
    messages: DataFrame,
    opts: Options = Options(),
    mute_log: DataFrame | None = None,
    state: DataFrame | None = None,
    quiet_seconds: int | None = None,
) -> DataFrame:
    """Outbox rows for a stream of messages(chat_id, ts, seq, text).

    For a backlog use :func:`alertfold.operators.folding.compact`, or :func:`compact_backlog` where the stream is to
    go on from it: here a chat's rows of one run are put in order in one task, through files where there are many, so
    runs should be bounded, as ``stream_queue`` and ``stream_spool`` bound them.
    ``ts`` is the time of the event. Every message is sent, however late: there is no watermark, a late one looks
    at the history around its own time, and goes out alone where that is gone. Muted ones are dropped:
    a ``mute_log`` that is a stream acts from the run that brings a command (see :func:`hear`), a table acts as it
    stands when the stream starts. ``state``, of :func:`compact_backlog`, is what a new query begins with;
    give it when the query starts again as well, where chats that are known leave it.

    A chat keeps the history beside its newest message and its last id. With ``quiet_seconds``, the history of a
    chat without messages for that time on the clock is forgotten, the id is not. See ``idle_runs`` of
    ``start_runs`` for queries that are to end.
    """
    if not messages.isStreaming:
        raise ValueError("online compaction takes a stream; compact() and compact_backlog() take tables")
    if mute_log is not None:
        messages = hear(messages, mute_log) if mute_log.isStreaming else drop_muted(messages, mute_log)
    time_mode = "None" if quiet_seconds is None else "ProcessingTime"
    packs = _by_chat(_timed(messages).select("chat_id", "micros", "seq", "text"))
    if state is not None:
        before = _by_chat(_streamed(state)).withColumn("held", F.lit(True))
        packs = packs.withColumn("held", F.lit(False)).unionByName(before)
    processor = OnlineCompaction(opts, quiet_seconds)
    return unpacked(
        packs.groupBy("chat").transformWithStateInPandas(processor, "pack binary", "Append", time_mode), OUTBOX
    )


def _streamed(state: DataFrame) -> DataFrame:
    """A table as a stream whose first run brings all of it. (Beside an initial state PySpark would hold all that the
    first run brings for a key.)"""
    folder = scratch_path(state.sparkSession, "state")
    state.write.parquet(folder)
    # a pattern, as a query that starts again also looks at files it has read from the folder of its first start
    return state.sparkSession.readStream.schema(state.schema).parquet(f"{folder}/*")


class _Held(dict):
    """A store in memory."""

    def load(self, bucket: int) -> list[tuple]:
        return self[bucket]

    def save(self, bucket: int, entries: list[tuple]) -> None:
        self[bucket] = entries

    def drop(self, bucket: int) -> None:
        self.pop(bucket, None)


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int | None, int, int, str]]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("chat_id", "micros", "seq", "text")))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [*_FIELDS, "last_id", "cut", "bucket", "entries"]
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), _ARROW)], names)


def compact_backlog(
    messages: DataFrame, opts: Options = Options(), mute_log: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(outbox, state) of a table of messages, as if a stream had brought them in order of time.

    Each chat is gone through in one pass over its sorted rows, with no more than its recent history in memory,
    however long the backlog; chats run in parallel. ``state`` holds what :func:`compact_stream` has to begin with,
    a row per chat and minute of its history. Both are read from one table in the shared folder. ``mute_log`` is a
    table.
    """
    heard = messages if mute_log is None else apply_mutes(messages, mute_log)
    timed = _timed(heard)
    ordered = timed.repartition(shuffle_tasks(timed), "chat_id").sortWithinPartitions("chat_id", "micros", "seq")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for chat, rows in groupby(_rows(batches), key=lambda r: r[0]):
            store = _Held()
            history = History(store, [], BEGIN, 0, opts)
            while some := [row[1:] for row in islice(rows, _ROWS_AT_ONCE)]:
                out += [(*row, None, None, None, None) for row in decisions(chat, some, history, opts)]
                history.settle()
                if len(out) >= _ROWS_AT_ONCE:
                    yield _batch(out)
                    out = []
            none = (None,) * (len(_FIELDS) - 1)
            for bucket in history.buckets or [None]:
                entries = [dict(zip(_ENTRY_NAMES, e)) for e in store.get(bucket, ())]
                out.append((chat, *none, history.last_id, history.cut, bucket, entries))
        if out:
            yield _batch(out)

    folder = scratch_path(messages.sparkSession, "backlog")
    ordered.mapInArrow(run, f"{OUTBOX}, {_STATE_ONLY}").write.parquet(folder)
    both = messages.sparkSession.read.parquet(folder)
    sent = both.filter(F.col("action").isNotNull()).select(*_FIELDS)
    return sent, both.filter(F.col("last_id").isNotNull()).select("chat_id", "last_id", "cut", "bucket", "entries")
