"""Stretches of text that repeat with a period: all maximal runs of words, and the text without the repetitions.

Harmonic grid: for every period p the positions 0, p, 2p, ... of a document are anchors. A run with period p of
at least two periods covers two neighbouring anchors, and reaches as far as both have words in common, forwards
and backwards. All periods of a document of n words have about n ln n anchors. Common extensions come from
:class:`CommonExtension`, once over the words and once over the words in reverse.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from alertfold.llm.common_extension import CommonExtension
from alertfold.llm.wordstream import BLANK_SEPARATED, WordStream, as_rows, pieces, word_bytes, words_of

MIN_WORDS = 12
ANCHORS_AT_ONCE = 1 << 20
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def word_names(stream: WordStream) -> np.ndarray:
    """A number per word: equal words, and only they, have equal numbers."""
    size = stream.end - stream.start
    ends = np.cumsum(size)
    at = np.arange(int(size.sum())) - np.repeat(ends - size, size)
    data = stream.data[np.repeat(stream.start, size) + at]
    offsets = pa.py_buffer(np.append(0, ends).astype(np.int64))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, offsets, pa.py_buffer(data)])
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _anchors(count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, position in it, period) of all anchors that have another one period later, some at a time."""
    most = count // 2
    text = np.repeat(np.arange(len(count)), most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    many = (count[text] - 1) // period
    until = np.cumsum(many)
    low = 0
    while low < len(text):
        before = until[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(until, before + ANCHORS_AT_ONCE, "right")))
        n = many[low:high]
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        p = np.repeat(period[low:high], n)
        yield np.repeat(text[low:high], n), place * p, p
        low = high


def runs_of(names: np.ndarray, first: np.ndarray, min_words: int = MIN_WORDS) -> np.ndarray:
    """Rows (text, start, length, period) of all runs, in this order, of texts whose words are ``first[t]:first[t+1]``.

    A run is as long as its smallest period allows, at least twice that period and ``min_words``.
    """
    count = np.diff(first)
    ends = np.arange(len(count) + 1)
    # a symbol of its own before, between and behind the texts
    line = np.empty(len(names) + len(ends), np.int64)
    begin = first[:-1] + ends[:-1] + 1
    marks = np.append(begin - 1, len(line) - 1)
    inner = np.ones(len(line), bool)
    inner[marks] = False
    line[inner] = names + len(ends)
    line[marks] = ends
    forward: CommonExtension | None = None
    backward: CommonExtension | None = None
    found = []
    for text, place, period in _anchors(count):
        i = begin[text] + place
        same = line[i] == line[i + period]
        text, i, period = text[same], i[same], period[same]
        if not len(i):
            continue
        if forward is None:
            forward, backward = CommonExtension(line), CommonExtension(line[::-1])
        ahead = forward.lengths(i, i + period)
        last = len(line) - 1
        behind = backward.lengths(last - (i + period - 1), last - (i - 1))
        length = behind + ahead + period
        long = length >= np.maximum(min_words, 2 * period)
        start = i - behind - begin[text]
        found.append(np.stack([text[long], start[long], length[long], period[long]], axis=1))
    if not found:
        return np.zeros((0, 4), np.int64)
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    # the same stretch is met at several anchors, and with multiples of its period
    smallest = np.append(True, (np.diff(rows[:, :3], axis=0) != 0).any(axis=1)) if len(rows) else np.zeros(0, bool)
    rows = rows[smallest]
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def repeated_words(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which words stand in a run behind its first period."""
    change = np.zeros(int(first[-1]) + 1, np.int64)
    start = first[rows[:, 0]] + rows[:, 1]
    np.add.at(change, start + rows[:, 3], 1)
    np.add.at(change, start + rows[:, 2], -1)
    return np.cumsum(change[:-1]) > 0


def find_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Rows of ``docs`` as ``row``, with ``n_words``, ``runs`` (by start, then period) and ``collapsed``: the text's
    words, joined by one blank, without those that stand in a run behind its first period.

    Words are [^\\x20\\x09-\\x0D]+ and compared as they are. Rows are worked on alone: repeated rows and repeated or
    null doc_ids each give their own row, and no column of ``docs`` can clash. A null or empty text has no words, no
    runs and an empty ``collapsed``; an empty table gives none. A text is held whole in its task, with working
    arrays of about 60 times its words. No shuffle.
    """
    rows = as_rows(docs)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            stream = words_of(texts, BLANK_SEPARATED, lower=False)
            found = runs_of(word_names(stream), stream.first, min_words)
            kept = word_bytes(stream, ~repeated_words(found, stream.first))
            per_text = np.append(0, np.cumsum(np.bincount(found[:, 0], minlength=batch.num_rows)))
            values = pa.StructArray.from_arrays(
                [pa.array(np.ascontiguousarray(found[:, k]), pa.int64()) for k in (1, 2, 3)], ["start", "length", "period"]
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    pa.array(stream.count.astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(per_text, pa.int32()), values),
                    kept.cast(pa.string()),
                ],
                ["row", "n_words", "runs", "collapsed"],
            )

    schema = T.StructType(
        [
            T.StructField("row", rows.schema["row"].dataType),
            *T.StructType.fromDDL(f"n_words bigint, runs {RUNS}, collapsed string").fields,
        ]
    )
    return rows.mapInArrow(scan, schema)
