"""The history of one chat in buckets of a minute: read from the newest on as far as a decision looks, written
only where it has changed."""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator
from typing import Protocol

from alertfold.options import Options
from alertfold.streaming.rules import Entry, nearby

MINUTE = 60_000_000
BEGIN = -(1 << 62)
ENTRIES = "entries array<struct<message_id: int, text: string, micros: bigint, pattern: string, cnt: int>>"


class Store(Protocol):
    """Where buckets are kept: number -> entries as rows."""

    def load(self, bucket: int) -> list[tuple]: ...

    def save(self, bucket: int, entries: list[tuple]) -> None: ...

    def drop(self, bucket: int) -> None: ...


class History:
    """Entries by time. ``buckets`` lists the buckets that are kept; of what is in them, entries up to ``cut`` are
    gone already."""

    def __init__(self, store: Store, buckets: list[int], cut: int, last_id: int, opts: Options) -> None:
        self.store, self.buckets, self.cut, self.last_id, self.opts = store, sorted(buckets), cut, last_id, opts
        self.loaded: dict[int, list[Entry]] = {}
        self.home: dict[int, int] = {}  # bucket of each entry that was seen
        self.changed: set[int] = set()
        self.saved = set(buckets)

    def _bucket(self, number: int) -> list[Entry]:
        if number not in self.loaded:
            kept = [Entry(*row) for row in self.store.load(number) if row[2] > self.cut]
            self.loaded[number] = kept
            self.home.update((e.message_id, number) for e in kept)
        return self.loaded[number]

    def _newest_first(self, micros: int) -> Iterator[Entry]:
        """Entries that may be near a time; buckets too old for it are not read."""
        oldest = micros - (self.opts.history_max_age_minutes + 1) * MINUTE
        for number in reversed(self.buckets):
            if (number + 1) * MINUTE <= oldest:
                break
            yield from reversed(self._bucket(number))

    def recent(self, micros: int) -> list[Entry]:
        return nearby(self._newest_first(micros), micros, self.opts)

    def add(self, entry: Entry) -> None:
        number = entry.micros // MINUTE
        if number not in self.loaded and number not in self.saved:
            insort(self.buckets, number)
            self.loaded[number] = []
        insort(self._bucket(number), entry, key=lambda e: (e.micros, e.message_id))
        self.home[entry.message_id] = number
        self.changed.add(number)

    def remove(self, message_ids: list[int]) -> None:
        """Entries that ``recent`` has shown."""
        for message_id in message_ids:
            number = self.home.pop(message_id)
            self.loaded[number] = [e for e in self.loaded[number] if e.message_id != message_id]
            self.changed.add(number)

    def _newest(self) -> int | None:
        return next((b[-1].micros for b in map(self._bucket, reversed(self.buckets)) if b), None)

    def forget(self, micros: int) -> None:
        """Within a run whose messages come in order, up to a time so far: forget what no later one can see, and
        what ``settle`` would forget."""
        newest = self._newest()
        if newest is not None:
            self._drop(self._oldest(min(newest, micros)))

    def settle(self) -> None:
        """Forget what is too old beside the newest entry, and write the buckets that have changed."""
        newest = self._newest()
        if newest is not None:
            self.cut = max(self.cut, self._oldest(newest))
        self._drop(self.cut)
        for number in self.changed:
            rows = [(e.message_id, e.text, e.micros, e.pattern, e.cnt) for e in self.loaded[number]]
            self.store.save(number, rows)
            self.saved.add(number)
        self.changed = set()

    def _oldest(self, micros: int) -> int:
        """The last time that is too old beside one."""
        return micros - (self.opts.history_max_age_minutes + 1) * MINUTE

    def _drop(self, cut: int) -> None:
        """Drop entries up to a time, and buckets without any."""
        kept = []
        for number in self.buckets:
            gone = (number + 1) * MINUTE <= cut + 1
            if number in self.loaded:
                entries = self.loaded[number]
                self.loaded[number] = [e for e in entries if e.micros > cut]
                for e in entries if len(entries) > len(self.loaded[number]) else ():
                    if e.micros <= cut:
                        del self.home[e.message_id]
                gone = gone or not self.loaded[number]
            if not gone:
                kept.append(number)
                continue
            self.loaded.pop(number, None)
            self.changed.discard(number)
            if number in self.saved:
                self.store.drop(number)
                self.saved.remove(number)
        self.buckets = kept
