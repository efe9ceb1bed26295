"""Mutes on a running stream: messages and mute commands meet in state, so a mute acts from the run that brings it.

State is keyed by slot, a bounded number of them, not by chat: a command for everyone goes to every slot, and so
reaches chats that nobody has heard of yet. The messages of a chat are dealt over several slots, and commands
for the chat go to all of those, so that a busy chat is not one task.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from math import inf
from pickle import dump, load
from tempfile import SpooledTemporaryFile
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from alertfold.functions.distance import epoch_micros
from alertfold.operators.mutes import ALL_CHATS
from alertfold.streaming.packs import RUN_BYTES, frame, joined, packed, rows_of, unpacked

if TYPE_CHECKING:
    import pandas as pd

SLOTS, SPREAD = 256, 8
DAY = 86_400
_ENTRIES = "entries array<struct<micros: bigint, seq: bigint, muted: boolean>>"

_KINDS = (np.int64, np.int64, np.bool_)

Timeline = list[tuple[int, int, bool]]


def muted_at(timeline: Timeline, micros: int | None) -> bool:
    """The state that the last entry at or before a time sets; without one, or without a time, not muted."""
    if micros is None:
        return False
    at = bisect_right(timeline, (micros, inf, True))
    return at > 0 and timeline[at - 1][2]


def forget(timeline: Timeline, before: int) -> Timeline:
    """Entries from a time on, and the one that holds at that time."""
    at = bisect_right(timeline, (before, inf, True))
    return timeline[max(0, at - 1) :]


class _Line:
    """The commands of one scope as columns: times, numbers, states; in order once it is settled."""

    def __init__(self, entries: Timeline = ()) -> None:
        self.parts = [tuple(np.array(c, k) for c, k in zip(zip(*entries) if entries else ((), (), ()), _KINDS))]

    def add(self, batch: pa.RecordBatch) -> None:
        self.parts.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))

    def settle(self) -> _Line:
        """Sort what came in, each command once."""
        if len(self.parts) > 1:
            micros, seq, muted = (np.concatenate(c) for c in zip(*self.parts))
            self.parts = []
            order = np.lexsort((muted, seq, micros))
            micros, seq, muted = micros[order], seq[order], muted[order]
            new = np.ones(len(order), bool)
            new[1:] = (micros[1:] != micros[:-1]) | (seq[1:] != seq[:-1]) | (muted[1:] != muted[:-1])
            self.parts = [(micros[new], seq[new], muted[new])]
        return self

    def mutes(self, times: np.ndarray) -> np.ndarray:
        """``muted_at`` for many times."""
        micros, _, muted = self.parts[0]
        at = np.searchsorted(micros, times, "right")
        return np.concatenate(([False], muted))[at]

    def kept(self, keep_micros: int) -> list[tuple]:
        """What is left of it, ``keep_micros`` before the last entry, as ``forget`` leaves it."""
        micros, seq, muted = self.parts[0]
        start = max(0, int(np.searchsorted(micros, micros[-1] - keep_micros, "right")) - 1)
        return list(zip(micros[start:].tolist(), seq[start:].tolist(), muted[start:].tolist()))


class MuteGate(StatefulProcessor):
    """State per slot: for every scope its mute commands of the last ``keep_seconds``, in order."""

    def __init__(self, keep_seconds: int) -> None:
        self.keep_micros = 1_000_000 * keep_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.log = handle.getMapState("log", "scope string", _ENTRIES)

    def _line(self, scope: str) -> _Line:
        held = self.log.getValue((scope,)) if self.log.containsKey((scope,)) else None
        return _Line([tuple(e) for e in held[0]] if held else ())

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        """Packs of commands have a scope. Those of messages wait, in a file where they are many, until all
        commands are known."""
        known: dict[str, _Line] = {}
        with SpooledTemporaryFile(max_size=RUN_BYTES) as waiting:
            count = 0
            for part in rows:
                for scope, pack in zip(part["scope"], part["pack"]):
                    if scope:
                        if scope not in known:
                            known[scope] = self._line(scope)
                        for batch in rows_of(pack):
                            known[scope].add(batch)
                    else:
                        dump(pack, waiting)
                        count += 1
            for scope, line in known.items():
                self.log.updateValue((scope,), (line.settle().kept(self.keep_micros),))
            waiting.seek(0)
            messages = (batch for _ in range(count) for batch in rows_of(load(waiting)))
            for heard in joined(self._heard(batch, known) for batch in messages):
                yield frame(heard)

    def _heard(self, messages: pa.RecordBatch, known: dict[str, _Line]) -> pa.RecordBatch:
        scopes = pc.dictionary_encode(messages.column("scope"))
        names = scopes.dictionary.to_pylist()
        for scope in {ALL_CHATS, *names} - set(known):
            known[scope] = self._line(scope)
        at, scope_of = messages.column("micros"), scopes.indices.to_numpy()
        times = at.fill_null(0).to_numpy()
        muted = known[ALL_CHATS].mutes(times)
        for place, scope in enumerate(names):
            own = scope_of == place
            muted[own] |= known[scope].mutes(times[own])
        muted &= at.is_valid().to_numpy(zero_copy_only=False)
        return messages.select(["row"]).filter(pa.array(~muted))

    def close(self) -> None:
        pass


def _slot(home: Column, step: Column, slots: int) -> Column:
    return F.pmod(home + step, F.lit(slots)).cast("int").alias("slot")


def hear(
    messages: DataFrame, mute_log: DataFrame, slots: int = SLOTS, spread: int = SPREAD, keep_seconds: int = DAY
) -> DataFrame:
    """The messages(chat_id, ts, ...) of a stream that are heard, given a stream of mute_log(ts, seq, scope, muted).

    A message is judged by the commands with a time at or before its own that have come by the end of its run: a
    mute silences its chat (or with scope ``*`` all chats) from the run that brings it, and messages sent before
    stay sent. Where all commands come in time, the result is that of ``apply_mutes``. Muted messages are dropped.
    Behind a run, commands are kept for ``keep_seconds`` before the newest of their scope, and the last one for
    good; a message that comes later than that is heard. Entries without time, seq or state are left out,
    and those whose scope is no chat id.

    ``slots`` and ``spread`` (slots of one chat) belong to the state: keep them when a query starts again.
    """
    types = {f.name: f.dataType for f in messages.schema.fields}
    home = F.pmod(F.xxhash64(F.col("chat_id").cast("string")), F.lit(slots))
    payload = F.struct(*messages.columns)
    told = messages.select(
        _slot(home, F.pmod(F.xxhash64(payload), F.lit(spread)), slots),
        F.coalesce(F.col("chat_id").cast("string"), F.lit("")).alias("scope"),
        epoch_micros(messages).alias("micros"),
        payload.alias("row"),
    )
    everyone = F.col("scope") == ALL_CHATS
    scope = F.when(everyone, F.col("scope")).otherwise(F.col("scope").try_cast("bigint").cast("string"))
    whole = mute_log.withColumn("scope", scope).dropna(subset=["ts", "seq", "scope", "muted"])
    scope_home = F.pmod(F.xxhash64("scope"), F.lit(slots))
    steps = F.sequence(F.lit(0), F.when(everyone, F.lit(slots - 1)).otherwise(F.lit(spread - 1)))
    entries = whole.select("scope", epoch_micros(whole).alias("micros"), F.col("seq").cast("long").alias("seq"), "muted")
    # packs of commands go to the slots, not each command
    commands = packed(entries, "scope").select("*", F.explode(steps).alias("step")).select(
        _slot(F.when(everyone, F.lit(0)).otherwise(scope_home), F.col("step"), slots), "scope", "pack"
    )
    both = packed(told, "slot").withColumn("scope", F.lit("")).unionByName(commands)
    row = T.StructType([T.StructField("row", T.StructType([T.StructField(n, types[n]) for n in messages.columns]))])
    gated = both.groupBy("slot").transformWithStateInPandas(MuteGate(keep_seconds), "pack binary", "Append", "None")
    return unpacked(gated, row).select("row.*")
