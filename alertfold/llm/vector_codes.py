"""Compressing vectors to one code byte per part: product quantisation with Lloyd's rounds over cover trees.

Every vector is cut into equal parts, and every part position has a codebook of its own. Tasks gather their vectors
in chunks and grow a cover tree per chunk and part position once; the trees are written to the shared folder, so a
round reads them again instead of the vectors. In a round a task hands whole subtrees to the entry that must be
nearest to all of their points, by the triangle inequality, and adds their running sums; only where several entries
remain possible it goes down, at last to single points. Sums leave a task as one row per entry, and the driver gets
no more than the codebooks.

All arithmetic is on integers, so codes, errors and codebooks are the same in whichever order rows come.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertfold.llm.cover_tree import Forest, grow, labels, sums
from alertfold.llm.wordstream import release
from alertfold.plans.storage import scratch_path

SCALE = 256
PARTS, ENTRIES, ROUNDS = 16, 64, 2
CHUNK = 4096
LIMIT = 1 << 24
"""Scaled components lie below this, so that squared distances fit 64 bits."""

_KINDS = {"points": np.int32, "reach": np.int64}


def usable(vector: str) -> Column:
    """Vectors with components, all of them finite numbers."""
    value = F.col(vector)
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x) < float("inf")))
    return value.isNotNull() & (F.size(value) > 0) & finite


def scaled(values: np.ndarray) -> np.ndarray:
    """Components as integers, rounded down."""
    out = np.floor(SCALE * values.astype(np.float64))
    if len(out) and np.abs(out).max() >= LIMIT:
        raise ValueError(f"components must lie below {LIMIT // SCALE} in magnitude")
    return out.astype(np.int64)


@dataclass
class Codebooks:
    """``entries`` of shape (parts, entries, components of a part)."""

    entries: np.ndarray

    def replaced(self, sums_of: Iterable[tuple[int, int, int, list[int]]]) -> Codebooks:
        """Entries moved to the mean of their parts, rounded down; those without any stay."""
        new = self.entries.copy()
        for part, entry, count, total in sums_of:
            new[part, entry] = [s // count for s in total]
        return Codebooks(new)

    def text(self) -> str:
        """All components as decimal integers, by part, entry and place."""
        return ",".join(map(str, self.entries.ravel().tolist()))


def first_codebooks(vectors: DataFrame, key: str, vector: str, parts: int, entries: int) -> Codebooks | None:
    """Parts of the vectors with the smallest keys (nulls last, ties by the vector); None where there is no vector."""
    rows = vectors.orderBy(F.col(key).asc_nulls_last(), vector).limit(entries).select(vector).collect()
    if not rows:
        return None
    if len({len(r[0]) for r in rows}) > 1 or len(rows[0][0]) % parts:
        raise ValueError(f"vectors must have one length, a multiple of {parts}")
    values = scaled(np.array([r[0] for r in rows], np.float64).ravel()).reshape(len(rows), parts, -1)
    return Codebooks(np.ascontiguousarray(values.transpose(1, 0, 2)))


def _forest_row(rows: pa.Table, parts: int, length: int) -> pa.RecordBatch:
    vectors = rows.column("vector").combine_chunks()
    if (np.array(vectors.value_lengths()) != length).any():
        raise ValueError("vectors must have one length")
    values = scaled(vectors.flatten().to_numpy(zero_copy_only=False)).reshape(len(rows), parts, -1)
    forest = grow(np.ascontiguousarray(values.transpose(1, 0, 2)))
    own = rows.column("row").combine_chunks()
    arrays = [pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), own)]
    for name in Forest.FIELDS:
        arrays.append(pa.array([getattr(forest, name).astype(_KINDS.get(name, np.int32)).tobytes()], pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, ["rows", *Forest.FIELDS])


def _forests(batch: pa.RecordBatch, parts: int, width: int) -> Iterator[tuple[pa.Array, Forest]]:
    for at in range(batch.num_rows):
        fields = {
            name: np.frombuffer(batch.column(name)[at].as_buffer(), _KINDS.get(name, np.int32)).astype(np.int64)
            for name in Forest.FIELDS
        }
        fields["points"] = fields["points"].reshape(-1, width)
        yield batch.column("rows")[at].values, Forest(**fields, sets=parts)


def _grown(vectors: DataFrame, vector: str, parts: int, length: int, chunk: int) -> DataFrame:
    """Rows of at most ``chunk`` vectors each, with the trees over their parts."""
    own = [c for c in vectors.columns if c != vector]
    rows = vectors.select(F.struct(*own).alias("row"), F.col(vector).cast("array<double>").alias("vector"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            while batch.num_rows:
                room = chunk - sum(b.num_rows for b in held)
                held.append(batch.slice(0, room))
                batch = batch.slice(min(room, batch.num_rows))
                if sum(b.num_rows for b in held) == chunk:
                    yield _forest_row(pa.Table.from_batches(held), parts, length)
                    held = []
        if held:
            yield _forest_row(pa.Table.from_batches(held), parts, length)
        release()

    schema = T.StructType([T.StructField("rows", T.ArrayType(rows.schema["row"].dataType))])
    for name in Forest.FIELDS:
        schema = schema.add(name, T.BinaryType())
    return rows.mapInArrow(run, schema)


def _summed(trees: DataFrame, books: Codebooks) -> list[tuple[int, int, int, list[int]]]:
    """(part, entry, number of its parts, their sum) of every entry that has any."""
    parts, entries, width = books.entries.shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for _, forest in _forests(batch, parts, width):
                more, number = sums(forest, books.entries)
                total += more
                count += number
        part, entry = np.nonzero(count)
        names = ["part", "entry", "count", *[f"s{k}" for k in range(width)]]
        columns = [part, entry, count[part, entry], *[total[part, entry, k] for k in range(width)]]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names)
        release()

    names = ["count", *[f"s{k}" for k in range(width)]]
    schema = ", ".join(f"{n} bigint" for n in ["part", "entry", *names])
    found = trees.mapInArrow(run, schema).groupBy("part", "entry").agg(*[F.sum(n).alias(n) for n in names])
    return [(r[0], r[1], r[2], list(r[3:])) for r in found.collect()]


def _coded(trees: DataFrame, books: Codebooks) -> DataFrame:
    parts, _, width = books.entries.shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, forest in _forests(batch, parts, width):
                code = labels(forest, books.entries).reshape(parts, -1)
                points = np.empty_like(forest.points)
                points[forest.original] = forest.points
                chosen = np.take_along_axis(books.entries, code[:, :, None], 1)
                error = ((points.reshape(parts, -1, width) - chosen) ** 2).sum((0, 2))
                bytes_of = np.ascontiguousarray(code.T.astype(np.uint8)).tobytes()
                fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(parts), len(rows), [None, pa.py_buffer(bytes_of)])
                yield pa.RecordBatch.from_arrays([rows, pc.cast(fixed, pa.binary()), pa.array(error)], ["row", "code", "error"])
        release()

    row = trees.schema["rows"].dataType.elementType
    schema = T.StructType([T.StructField("row", row)]).add("code", T.BinaryType()).add("error", T.LongType())
    return trees.mapInArrow(run, schema)


def compress(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    chunk: int = CHUNK,
) -> tuple[DataFrame, Codebooks]:
    """(coded, codebooks). ``coded`` has ``row`` (all columns but the vector), ``code`` (a byte per part: the number of
    its codebook's nearest entry) and ``error`` (squared distances, summed over parts).

    Components count as floor(256 x). Codebooks begin with the parts of the ``entries`` smallest keys, nulls last,
    ties by the vector; each round assigns all parts to their nearest entries, ties to the lower number, and moves
    every used entry to the mean, rounded down. With fewer vectors there are fewer entries. Vectors that are null,
    have no components or hold null or non-finite ones are left out; all others must have one length, a multiple
    of ``parts``, and components below 65,536 in magnitude, else the job ends with a ValueError. Repeated rows are
    coded one by one. Without vectors there are no rows and no entries. ``row`` is one struct, so no column clashes.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an entry's number must fit a byte")
    kept = vectors.filter(usable(vector))
    books = first_codebooks(kept, key, vector, parts, entries)
    length = parts if books is None else books.entries.shape[0] * books.entries.shape[2]
    folder = scratch_path(vectors.sparkSession, "trees")
    _grown(kept, vector, parts, length, chunk).write.parquet(folder)
    trees = vectors.sparkSession.read.parquet(folder)
    if books is None:
        books = Codebooks(np.zeros((parts, 0, 1), np.int64))
        return _coded(trees, books), books
    for _ in range(rounds):
        books = books.replaced(_summed(trees, books))
    return _coded(trees, books), books
