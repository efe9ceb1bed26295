"""Words of many texts at once, as numpy arrays over one byte buffer.

A batch of texts is one buffer of UTF-8 bytes; words, their hashes and hashes of word sequences come from a
fixed number of array passes, whatever the number of texts. A text never shares a word with its neighbour.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
PIECE_BYTES, PIECE_ROWS = 1 << 20, 2048
ROWS_PER_BATCH = 1000


def mixed(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads close ones apart (the finaliser of splitmix64)."""
    x = values + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
BLANK_SEPARATED = ~_SPACE
"""Bytes of words that match [^\\x20\\x09-\\x0D]+."""

_ALNUM = np.ones(256, bool)
_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False
LETTERS_AND_DIGITS = _ALNUM
"""Bytes of words that match [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ once A-Z is lower case."""

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class WordStream:
    """Words of the texts of a batch, in order: word i is ``data[start[i]:end[i]]`` and stands in text ``text[i]``.

    ``first[t]:first[t + 1]`` are the words of text t. Offsets are bytes of the buffer; text t begins at
    ``offset[t]``.
    """

    data: np.ndarray
    offset: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    first: np.ndarray

    @property
    def count(self) -> np.ndarray:
        """Words per text."""
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash per word, from its bytes eight at a time."""
        size = self.end - self.start
        out = mixed(size.astype(np.uint64), 1)
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eights = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
        left, at = np.arange(len(size)), 0
        while len(left):
            rest = np.minimum(size[left] - at, 8)
            out[left] = mixed((out[left] * _ODD) ^ (eights[self.start[left] + at] & _MASKS[rest]), 2)
            at += 8
            left = left[size[left] > at]
        return out

    def starts_of(self, size: int) -> np.ndarray:
        """Words at which a sequence of ``size`` words of one text starts."""
        at = np.arange(len(self.start))
        return at[self.first[self.text + 1] - at >= size] if len(at) else at


def sequence_hashes(words: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the ``size`` word hashes from each position that has as many; sizes double on the way."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    power, width, out, done = mixed(words, seed + 3), 1, None, 0
    while done < size:
        if size & width:
            part = power[done : done + len(words) - size + 1]
            out = part if out is None else mixed(out * _ODD + part, seed + 4)
            done += width
        if done < size:
            power = mixed(power[:-width] * _ODD + power[width:], seed + 5)
            width *= 2
    return out


def words_of(texts: pa.Array, kind: np.ndarray, lower: bool) -> WordStream:
    """The words of a binary Arrow array. A null text has none."""
    if texts.null_count:
        texts = texts.fill_null(b"")
    texts = texts.cast(pa.large_binary())
    offset = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    data, offset = data[offset[0] : offset[-1]], offset - offset[0]
    if lower:
        data = _LOWER[data]
    inside = kind[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offset] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:-1]
    ends[:-1] &= ~inside[1:] | cut[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offset)
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    return WordStream(data, offset, start, end, text, first)


def normalised(stream: WordStream) -> tuple[str, np.ndarray]:
    """All words with a blank around each, texts kept apart by a line feed; and where each word ends in it.

    A character stands for a byte.
    """
    size = stream.end - stream.start
    last = np.zeros(len(size), bool)
    last[stream.first[1:][stream.count > 0] - 1] = True
    step = size + np.where(last, 3, 1)
    begin = 1 + np.cumsum(step) - step
    out = np.full(int(step.sum()) + 1, 0x20, np.uint8)
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(begin, size) + at] = stream.data[np.repeat(stream.start, size) + at]
    out[begin[last] + size[last] + 1] = 0x0A
    return out.tobytes().decode("latin-1"), begin + size


def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Batches of a column ``row`` cut so that their texts hold about PIECE_BYTES, each with its texts as bytes.

    A piece has at most PIECE_ROWS rows; a longer text is a piece of its own.
    """
    for batch in batches:
        texts = pc.struct_field(batch.column("row"), "text")
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // PIECE_BYTES
        changes = (np.diff(part) > 0) | (np.arange(1, batch.num_rows) % PIECE_ROWS == 0)
        cuts = [0, *(np.flatnonzero(changes) + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts, cuts[1:]):
            if high > low:
                yield batch.slice(low, high - low), texts.slice(low, high - low).cast(pa.large_binary())
    release()


def release() -> None:
    """Hand memory that Arrow and the C library hold in reserve back: workers live on after their task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def short_batches(docs: DataFrame) -> None:
    """Let Arrow batches of the session hold ROWS_PER_BATCH rows where nobody has set another number.

    Rows here carry whole texts; batches of the default 10,000 rows cost memory on both sides of the pipe.
    """
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(name) == "10000":
        conf.set(name, str(ROWS_PER_BATCH))


def as_rows(docs: DataFrame) -> DataFrame:
    """All columns as one struct ``row``, so that added columns never clash with those of the table."""
    short_batches(docs)
    return docs.select(F.struct(*docs.columns).alias("row"))


def word_bytes(stream: WordStream, keep: np.ndarray) -> pa.Array:
    """The kept words of each text with one blank between, as bytes."""
    kept = np.flatnonzero(keep)
    size = stream.end[kept] - stream.start[kept]
    per_text = np.bincount(stream.text[kept], minlength=len(stream.count))
    last = np.zeros(len(kept), bool)
    last[np.cumsum(per_text)[per_text > 0] - 1] = True
    step = size + ~last
    begin = np.cumsum(step) - step
    out = np.full(int(step.sum()), 0x20, np.uint8)
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(begin, size) + at] = stream.data[np.repeat(stream.start[kept], size) + at]
    ends = np.append(0, np.cumsum(step))[np.append(0, np.cumsum(per_text))].astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(per_text), [None, pa.py_buffer(ends), pa.py_buffer(out)])
