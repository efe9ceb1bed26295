"""Rows of stateful streams in packs: a pack holds the rows of a key in one Arrow batch, as an Arrow stream.

A processor takes and gives packs one after the other, so neither the rows of a key nor what it makes of them are held
in Python at once, however many come in a run. Types pass as they are, nulls included.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from contextlib import ExitStack
from heapq import merge
from operator import itemgetter
from tempfile import TemporaryFile
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

if TYPE_CHECKING:
    import pandas as pd

RUN_BYTES = 16 << 20  # sorted in memory at once
_GIVEN_BYTES = 4 << 20
_READ_BYTES = 128 << 10  # of each run at once


def to_pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def rows_of(pack: bytes) -> Iterator[pa.RecordBatch]:
    yield from pa.ipc.open_stream(pack)


def frame(batch: pa.RecordBatch) -> pd.DataFrame:
    """A batch as the one pack of a processor's output."""
    import pandas as pd  # here, as other workers and the driver's start sooner without it

    return pd.DataFrame({"pack": [to_pack(batch)]})


def packed(rows: DataFrame, key: str) -> DataFrame:
    """(key, pack) of rows with a key that is never null; packs hold the other columns."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pc.dictionary_encode(batch.column(key))
            place = found.indices.to_numpy()
            ordered = batch.drop_columns([key]).take(pa.array(np.argsort(place, kind="stable")))
            ends = np.cumsum(np.bincount(place, minlength=len(found.dictionary)))
            packs = [to_pack(ordered.slice(low, high - low)) for low, high in zip([0, *ends], ends)]
            yield pa.RecordBatch.from_arrays([found.dictionary, pa.array(packs, pa.binary())], [key, "pack"])

    return rows.mapInArrow(run, T.StructType([rows.schema[key], T.StructField("pack", T.BinaryType())]))


def unpacked(packs: DataFrame, schema: T.StructType | str) -> DataFrame:
    """The rows in a column ``pack``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return joined(rows for batch in batches for pack in batch.column("pack") for rows in rows_of(pack.as_py()))

    return packs.mapInArrow(run, schema)


def joined(batches: Iterable[pa.RecordBatch], size: int = _GIVEN_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of many small batches in batches of some bytes; those without rows are left out."""
    batches = (b for b in batches if b.num_rows)
    while held := list(_until(batches, size)):
        yield from _whole(held).to_batches()


def _whole(batches: list[pa.RecordBatch]) -> pa.Table:
    return pa.Table.from_batches(batches).combine_chunks()


def _tuples(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def in_order(batches: Iterable[pa.RecordBatch], by: Sequence[str], run_bytes: int = RUN_BYTES) -> Iterator[tuple]:
    """All rows by the columns named, which come first; equal ones as they came.

    Rows are sorted by runs of some bytes. All runs but the last wait in files of the worker's temporary folder.
    """
    batches = iter(batches)
    with ExitStack() as files:
        runs = []
        while held := list(_until(batches, run_bytes)):
            size = sum(b.nbytes for b in held)
            whole = _whole(held).sort_by([(name, "ascending") for name in by])
            ordered = whole.to_batches(max(1, whole.num_rows * _READ_BYTES // max(1, size)))
            if size >= run_bytes:
                file = files.enter_context(TemporaryFile())
                with pa.ipc.new_stream(file, whole.schema) as out:
                    for batch in ordered:
                        out.write_batch(batch)
                file.seek(0)
                ordered = pa.ipc.open_stream(file)
            runs.append(_tuples(ordered))
            del held, whole, ordered
        yield from merge(*runs, key=itemgetter(*range(len(by)))) if len(runs) > 1 else (runs[0] if runs else ())


def _until(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches up to the one with which they reach a size."""
    for batch in batches:
        yield batch
        size -= batch.nbytes
        if size <= 0:
            return
