"""The message spool as a Spark data source: ``<spool>/<chat>/<file>``, one message per file, bytes as they are.

Empty files are messages too. Reading a table lists chat by chat inside the tasks. A stream claims files: the
reader writes the names of new files as claim n to ``<spool>/.claims`` before it offers offset n, so a restart
reads exactly the claimed files again, and a claim that never became an offset is offered first. When Spark goes on
behind offset n, all files claimed up to n have been handled; they are deleted, moved to an archive, or kept.
Writing stages files and shows them when the whole job has ended.

Files are opened with ``pyarrow.fs``, so a spool is a local path or a URI of a file system known to it.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from collections.abc import Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamReader,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

MUTE_MARKER = "sending_off"
SCHEMA = "chat_id bigint, msg_id string, ts timestamp, content binary"
_ARROW = pa.schema(
    [("chat_id", pa.int64()), ("msg_id", pa.string()), ("ts", pa.timestamp("us", "UTC")), ("content", pa.binary())]
)
# <chat>, or chat_id=<chat> where Spark wrote the spool
_CHAT = re.compile(r"(?:chat_id=)?(-?[0-9]+)")
_BATCH_BYTES = 4 << 20
_FILES_PER_PARTITION = 2_000
_THREADS = 16


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri.rstrip("/")
    system, path = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))
    return system, path.rstrip("/")


def _listed(system: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
    return system.get_file_info(fs.FileSelector(folder, allow_not_found=True))


def chat_folders(system: fs.FileSystem, spool: str) -> list[tuple[int, str]]:
    """(chat, folder name) of all chats, in order."""
    found = [(_CHAT.fullmatch(i.base_name), i) for i in _listed(system, spool) if i.type == fs.FileType.Directory]
    return sorted((int(match[1]), info.base_name) for match, info in found if match)


def _is_message(info: fs.FileInfo) -> bool:
    return info.type == fs.FileType.File and info.base_name != MUTE_MARKER and info.base_name[0] not in "._"


def _micros(info: fs.FileInfo) -> int:
    return info.mtime_ns // 1000


@dataclass
class Slice(InputPartition):
    """The files of one chat whose name falls into one of ``of`` slices."""

    folder: str
    number: int
    of: int


@dataclass
class Named(InputPartition):
    """Files by name: (folder, name, time in microseconds, bytes)."""

    files: list[tuple[str, str, int, int]]


def _batches(system: fs.FileSystem, spool: str, files: Iterable[tuple[str, str, int]]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple[int, str, int, bytes]] = []
    held = 0
    for folder, name, micros in files:
        with system.open_input_stream(f"{spool}/{folder}/{name}") as file:
            content = file.read()
        rows.append((int(_CHAT.fullmatch(folder)[1]), name, micros, content))
        held += len(content) + 100
        if held >= _BATCH_BYTES:
            yield _record_batch(rows)
            rows, held = [], 0
    if rows:
        yield _record_batch(rows)


def _record_batch(rows: list[tuple[int, str, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


class SpoolReader(DataSourceReader):
    """All messages there are: a task per chat and slice, which lists its folder itself."""

    def __init__(self, uri: str, slices: int) -> None:
        self.uri, self.slices = uri, slices

    def partitions(self) -> Sequence[InputPartition]:
        system, spool = opened(self.uri)
        return [Slice(folder, n, self.slices) for _, folder in chat_folders(system, spool) for n in range(self.slices)]

    def read(self, partition: Slice | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no chats
            return
        system, spool = opened(self.uri)
        mine = [
            (partition.folder, i.base_name, _micros(i))
            for i in _listed(system, f"{spool}/{partition.folder}")
            if _is_message(i) and hashlib.md5(i.base_name.encode()).digest()[0] % partition.of == partition.number
        ]
        yield from _batches(system, spool, sorted(mine))


class Claims:
    """Numbered lists of files in ``<spool>/.claims``. A list appears whole or not at all."""

    def __init__(self, uri: str) -> None:
        self.system, self.spool = opened(uri)
        self.folder = f"{self.spool}/.claims"

    def numbers(self) -> list[int]:
        names = [i.base_name for i in _listed(self.system, self.folder)]
        return sorted(int(n) for n in names if n.isdigit())

    def files(self, number: int) -> list[tuple[str, str, int, int]]:
        with self.system.open_input_stream(f"{self.folder}/{number}") as file:
            return [tuple(f) for f in json.loads(file.read())]

    def write(self, number: int, files: list[tuple[str, str, int, int]]) -> None:
        self.system.create_dir(self.folder)
        staged = f"{self.folder}/.{number}"
        with self.system.open_output_stream(staged) as file:
            file.write(json.dumps(files).encode())
        self.system.move(staged, f"{self.folder}/{number}")

    def clear(self, number: int, archive: str | None) -> None:
        """Remove the files of a claim, or move them to ``archive``; then leave the claim empty."""
        files = self.files(number)

        def settle(entry: tuple[str, str, int, int]) -> None:
            folder, name, micros, size = entry
            place = f"{self.spool}/{folder}/{name}"
            info = self.system.get_file_info(place)
            if info.type != fs.FileType.File or (_micros(info), info.size) != (micros, size):
                return  # gone already, or another message of the same name
            if archive is None:
                self.system.delete_file(place)
            else:
                self.system.move(place, f"{archive}/{folder}/{name}")

        if archive is not None:
            for folder in {f[0] for f in files}:
                self.system.create_dir(f"{archive}/{folder}")
        with ThreadPoolExecutor(_THREADS) as pool:
            list(pool.map(settle, files))
        if files:
            self.write(number, [])

    def drop(self, number: int) -> None:
        self.system.delete_file(f"{self.folder}/{number}")


class SpoolStream(DataSourceStreamReader):
    """New files, claimed in the order of their time and name."""

    def __init__(self, uri: str, max_files: int, after: str, archive: str | None, quiet_seconds: float) -> None:
        self.uri, self.max_files, self.after, self.quiet_seconds = uri, max_files, after, quiet_seconds
        self.archive = None if archive is None else opened(archive)[1]
        self.planned = 0

    def initialOffset(self) -> dict:
        """Claims of a query that was given up are read again; what it had handled and cleared is empty."""
        return {"claim": 0}

    def latestOffset(self) -> dict:
        """Spark asks for it only when the run it planned before has ended, and its claims with it."""
        claims = Claims(self.uri)
        self._settled(claims, self.planned)
        known = claims.numbers()
        last = known[-1] if known else 0
        new = self._new(claims, known)
        if new:
            last += 1
            claims.write(last, new)
        return {"claim": last}

    def _new(self, claims: Claims, known: list[int]) -> list[tuple[str, str, int, int]]:
        taken = {tuple(f) for n in known for f in claims.files(n)}
        before = None if self.quiet_seconds <= 0 else int((time.time() - self.quiet_seconds) * 1_000_000)
        found = []
        for _, folder in chat_folders(claims.system, claims.spool):
            for info in _listed(claims.system, f"{claims.spool}/{folder}"):
                entry = (folder, info.base_name, _micros(info), info.size) if _is_message(info) else None
                if entry and entry not in taken and (before is None or entry[2] <= before):
                    found.append(entry)
        found.sort(key=lambda f: (f[2], f[1], f[0]))
        return found[: self.max_files]

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        claims = Claims(self.uri)
        if start["claim"] < end["claim"]:  # equal where a query starts again, whatever has become of its last run
            self._settled(claims, start["claim"])
        self.planned = end["claim"]
        files = [f for n in claims.numbers() if start["claim"] < n <= end["claim"] for f in claims.files(n)]
        return [Named(files[k : k + _FILES_PER_PARTITION]) for k in range(0, len(files), _FILES_PER_PARTITION)]

    def read(self, partition: Named | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no files
            return
        system, spool = opened(self.uri)
        yield from _batches(system, spool, [f[:3] for f in partition.files])

    def commit(self, end: dict) -> None:
        self._settled(Claims(self.uri), end["claim"])

    def _settled(self, claims: Claims, upto: int) -> None:
        """All claims up to ``upto`` have been handled."""
        if self.after == "keep":
            return
        done = [n for n in claims.numbers() if n <= upto]
        for number in done:
            claims.clear(number, self.archive if self.after == "archive" else None)
        for number in done[:-1]:  # the last one keeps the count
            claims.drop(number)


class SpoolWriter(DataSourceArrowWriter):
    """Rows of (chat_id, content) as files. A task that is repeated writes the same files again."""

    def __init__(self, uri: str) -> None:
        self.uri, self.job = uri, uuid.uuid4().hex

    def _staged(self) -> tuple[fs.FileSystem, str, str]:
        system, spool = opened(self.uri)
        return system, spool, f"{spool}/.staged-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, _, staged = self._staged()
        part, made, row = TaskContext.get().partitionId(), set(), 0
        for batch in iterator:
            for chat, content in zip(batch.column("chat_id").to_pylist(), batch.column("content").to_pylist()):
                name = hashlib.sha256(f"{self.job} {part} {row}".encode()).hexdigest()[:16].upper()
                row += 1
                if chat is None:
                    raise ValueError("a message needs a chat")
                if chat not in made:
                    system.create_dir(f"{staged}/{chat}")
                    made.add(chat)
                hidden = f"{staged}/{chat}/.{TaskContext.get().taskAttemptId()}-{name}"
                with system.open_output_stream(hidden) as file:
                    file.write(content or b"")
                system.move(hidden, f"{staged}/{chat}/{name}")
        return WriterCommitMessage()

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, spool, staged = self._staged()
        folders = [i.base_name for i in _listed(system, staged)]
        for chat in folders:
            system.create_dir(f"{spool}/{chat}")
        files = [(chat, i.base_name) for chat in folders for i in _listed(system, f"{staged}/{chat}") if _is_message(i)]
        with ThreadPoolExecutor(_THREADS) as pool:
            list(pool.map(lambda f: system.move(f"{staged}/{f[0]}/{f[1]}", f"{spool}/{f[0]}/{f[1]}"), files))
        self._remove(system, staged)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, _, staged = self._staged()
        self._remove(system, staged)

    @staticmethod
    def _remove(system: fs.FileSystem, staged: str) -> None:
        if system.get_file_info(staged).type == fs.FileType.Directory:
            system.delete_dir(staged)


class SpoolSource(DataSource):
    """Format ``spool``. Options: ``path``; for tables ``slices`` (tasks per chat); for streams ``maxFilesPerTrigger``,
    ``after`` (what happens to handled files: delete, archive, keep), ``archive`` (folder), ``quietSeconds`` (files
    younger than that are still being written)."""

    @classmethod
    def name(cls) -> str:
        return "spool"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> SpoolReader:
        return SpoolReader(self.options["path"], int(self.options.get("slices", 4)))

    def streamReader(self, schema: StructType) -> SpoolStream:
        after = self.options.get("after", "delete")
        if after not in ("delete", "archive", "keep") or (after == "archive") != ("archive" in self.options):
            raise ValueError("after is delete, keep, or archive with the option archive")
        return SpoolStream(
            self.options["path"],
            int(self.options.get("maxFilesPerTrigger", 10_000)),
            after,
            self.options.get("archive"),
            float(self.options.get("quietSeconds", 0)),
        )

    def writer(self, schema: StructType, overwrite: bool) -> SpoolWriter:
        if overwrite:
            raise ValueError("a spool is only added to")
        return SpoolWriter(self.options["path"])
