"""Substring dedup by recompression: word sequences that occurred earlier in the corpus are cut out.

Rounds replace runs of a symbol, then pairs of neighbours, by new symbols. A symbol's name is a hash of what it
replaces and a pair is formed by the names alone, so all tasks name equal sequences alike without a dictionary,
and equal windows of words get the same symbols, but for some at their ends whose fate the outside decides.
Every window is thus represented by an inner symbol that depends on its words alone, one of the highest round
that leaves any. Spark counts these symbols over the corpus; only windows whose symbol occurs more than once can
repeat. They are brought together by symbol, verified by hashes of all their words, and all but the earliest go.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertfold.llm.wordstream import (
    BLANK_SEPARATED,
    WordStream,
    as_rows,
    mixed,
    pieces,
    sequence_hashes,
    short_batches,
    word_bytes,
    words_of,
)
from alertfold.plans.storage import checkpointed

WINDOW = 20
PAIR_ROUNDS = 4
MIN_FILTER_BITS, MAX_FILTER_BITS = 20, 28
"""The filter of repeated symbols has 2 ** bits bits: 16 for each symbol as long as they fit, 32 MB at most."""
_ODD = np.uint64(0xD6E8FEB86659FD93)
_NO_ID = (1 << 63) - 1


@dataclass
class Level:
    """Symbols of a round in the order of the words: names, and the word at which each begins."""

    name: np.ndarray
    begin: np.ndarray

    def span(self, words: int) -> np.ndarray:
        return np.diff(np.append(self.begin, words))


def _runs(words: np.ndarray, text: np.ndarray) -> tuple[Level, np.ndarray]:
    """Maximal runs of one word in a text; and the run of each word."""
    fresh = np.ones(len(words), bool)
    fresh[1:] = (words[1:] != words[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(fresh)
    length = np.diff(np.append(begin, len(words))).astype(np.uint64)
    name = np.where(length == 1, words[begin], mixed(words[begin] * _ODD + length, 11))
    return Level(name, begin), np.cumsum(fresh) - 1


def _pairs(level: Level, text: np.ndarray, number: int) -> tuple[Level, np.ndarray, np.ndarray]:
    """Pairs of a left and a right symbol side by side in a text become one.

    Also the new symbol of each old one, and which old ones are left: about half, by a bit of the name.
    """
    left = (mixed(level.name, 20 + number) & np.uint64(1)).astype(bool)
    owner = text[level.begin]
    starts = np.zeros(len(left), bool)
    starts[:-1] = left[:-1] & ~left[1:] & (owner[1:] == owner[:-1])
    second = np.zeros(len(left), bool)
    second[1:] = starts[:-1]
    first = np.flatnonzero(~second)
    name = level.name[first].copy()
    paired = np.flatnonzero(starts)
    name[starts[first]] = mixed(level.name[paired] * _ODD + level.name[paired + 1], 40 + number)
    return Level(name, level.begin[first]), np.cumsum(~second) - 1, left


def window_symbols(words: np.ndarray, text: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For the window at each start: a symbol that its words alone decide, and where that symbol begins.

    The inner symbols of a window are followed through the rounds; those at its ends that could join with the
    outside are left off. Of the last round with inner symbols, the one with the longest span represents the
    window, ties by name, then by place.
    """
    low, high = starts.copy(), starts + window - 1
    chosen, place = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.int64)
    active = np.arange(len(starts))
    level = Level(words, np.arange(len(words)))
    for number in range(PAIR_ROUNDS + 2):
        if number == 0:
            above, up = _runs(words, text)
            next_low, next_high = up[low] + 1, up[high] - 1
        elif number <= PAIR_ROUNDS:
            above, up, left = _pairs(level, text, number)
            next_low, next_high = up[low] + ~left[low], up[high] - left[high]
        done = np.flatnonzero(next_low > next_high) if number <= PAIR_ROUNDS else np.arange(len(active))
        if len(done):
            at = _best(level, low[done], high[done], len(words))
            chosen[active[done]], place[active[done]] = level.name[at], level.begin[at]
        if number <= PAIR_ROUNDS:
            go = np.flatnonzero(next_low <= next_high)
            active, low, high, level = active[go], next_low[go], next_high[go], above
    return chosen, place


def _best(level: Level, low: np.ndarray, high: np.ndarray, words: int) -> np.ndarray:
    span = np.minimum(level.span(words), 255).astype(np.uint64)
    rank = ((np.uint64(255) - span) << np.uint64(56)) | (mixed(level.name, 60) >> np.uint64(8))
    best = low.copy()
    for step in range(1, int((high - low).max()) + 1):
        other = np.minimum(low + step, high)
        best = np.where(rank[other] < rank[best], other, best)
    return best


@dataclass
class _Piece:
    """A piece of the corpus with its texts in the order of doc_id, and the windows in it."""

    stream: WordStream
    doc: np.ndarray
    key: np.ndarray
    words: np.ndarray
    starts: np.ndarray
    symbol: np.ndarray
    place: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch, texts: pa.Array, window: int) -> _Piece:
        doc, key = batch.column("doc").to_numpy(), batch.column("key").to_numpy()
        order = np.argsort(doc, kind="stable")
        stream = words_of(texts.take(pa.array(order)), BLANK_SEPARATED, lower=False)
        words, starts = stream.hashes(), stream.starts_of(window)
        symbol, place = window_symbols(words, stream.text, starts, window)
        return cls(stream, doc[order], key[order], words, starts, symbol, place)


def _keyed(docs: DataFrame) -> DataFrame:
    """Texts with the key of their document and of the text itself; rows without doc_id come last."""
    short_batches(docs)
    return docs.select(
        F.struct("text").alias("row"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc"),
        F.xxhash64("text").alias("key"),
    )


def repeated_symbols(keyed: DataFrame, window: int) -> DataFrame:
    """(symbol) of those that represent windows at two or more places of the corpus."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            piece = _Piece.of(batch, texts, window)
            order = np.lexsort((piece.place, piece.symbol))
            symbol, place = piece.symbol[order], piece.place[order]
            other = np.ones(len(order), bool)
            other[1:] = (symbol[1:] != symbol[:-1]) | (place[1:] != place[:-1])
            symbol, times = np.unique(symbol[other], return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(symbol.view(np.int64)), pa.array(np.minimum(times, 2).astype(np.int32))], ["symbol", "times"]
            )

    counted = keyed.mapInArrow(count, "symbol long, times int").groupBy("symbol").agg(F.sum("times").alias("times"))
    return counted.filter("times > 1").select("symbol")


def symbol_filter(symbols: DataFrame) -> np.ndarray:
    """A bitmap of 64-bit numbers, of bounded size, in which the slot of every given symbol is set."""
    held = checkpointed(symbols)
    bits = min(max((16 * held.count()).bit_length(), MIN_FILTER_BITS), MAX_FILTER_BITS)
    slot = F.col("symbol").bitwiseAND(F.lit((1 << bits) - 1))
    bit = F.expr(f"shiftleft(1L, cast((symbol & {(1 << bits) - 1}) % 64 AS int))")
    marks = held.groupBy(F.shiftright(slot, 6).alias("number")).agg(F.bit_or(bit).alias("marks")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[marks.column("number").to_numpy()] = marks.column("marks").to_numpy().view(np.uint64)
    return out


def _is_marked(marks: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    slot = symbol & np.uint64(64 * len(marks) - 1)
    return ((marks[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1)).astype(bool)


def _lists(columns: list[np.ndarray], cuts: np.ndarray) -> list[pa.Array]:
    return [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(c)) for c in columns]


def _ranges(doc: np.ndarray, key: np.ndarray, start: np.ndarray, window: int) -> list[np.ndarray]:
    """Word ranges (doc, key, first, last) that windows in order of (doc, key, start) cover."""
    fresh = np.ones(len(start), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (start[1:] > start[:-1] + window)
    at = np.flatnonzero(fresh)
    last = start[np.append(at[1:], len(start)) - 1] + window - 1
    return [doc[at], key[at], start[at].astype(np.int32), last.astype(np.int32)]


def _later(doc: np.ndarray, start: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Which windows, sorted in groups of equal ones by (doc, start), stand behind the first of their group."""
    first = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    return (doc != doc[first]) | (start != start[first])


_FIELDS = ["bucket", "symbol", "window", "doc", "key", "first", "last"]
_SCHEMA = (
    "bucket int, symbol array<long>, window array<long>, doc array<long>, key array<long>, first array<int>,"
    " last array<int>"
)


def repeated_ranges(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc, key, first, last): word ranges covered by windows that also start earlier in the corpus.

    A task settles the windows that repeat within its own piece, so a passage that a third of all documents
    hold sends one window per piece. Rows that share a doc_id are judged by (doc_id, start): equal places do
    not remove each other.
    """
    keyed = _keyed(docs)
    marks = docs.sparkSession.sparkContext.broadcast(symbol_filter(repeated_symbols(keyed, window)))
    tasks = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    buckets = 8 * tasks

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            p = _Piece.of(batch, texts, window)
            kept = np.flatnonzero(_is_marked(marks.value, p.symbol))
            at, symbol = p.starts[kept], p.symbol[kept]
            hashes = sequence_hashes(p.words, window)[at] if len(at) else np.zeros(0, np.uint64)
            text = p.stream.text[at]
            doc, key, start = p.doc[text], p.key[text], at - p.stream.first[text]
            order = np.lexsort((start, doc, hashes))
            fresh = np.ones(len(order), bool)
            fresh[1:] = hashes[order][1:] != hashes[order][:-1]
            later = np.zeros(len(order), bool)
            later[order] = _later(doc[order], start[order], fresh)
            if later.any():
                ranges = _ranges(doc[later], key[later], start[later], window)
                none = np.zeros(0, np.int64)
                lists = _lists([none, none], np.zeros(2, np.int32)) + _lists(ranges, np.array([0, len(ranges[0])]))
                place = int(ranges[1][0] % buckets)
                yield pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), *lists], _FIELDS)
            first = np.flatnonzero(~later)
            bucket = (mixed(symbol[first], 70) % np.uint64(buckets)).astype(np.int32)
            order = first[np.argsort(bucket, kind="stable")]
            used, cuts = np.unique(np.sort(bucket), return_index=True)
            number = start[order].astype(np.int32)
            values = [symbol[order].view(np.int64), hashes[order].view(np.int64), doc[order], key[order], number, number]
            lists = _lists(values, np.append(cuts, len(order)))
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *lists], _FIELDS)

    def settle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list[np.ndarray]] = []
        for batch in batches:
            settled = np.array(batch.column("symbol").value_lengths()) == 0
            for known in (True, False):
                part = batch.filter(pa.array(settled == known))
                columns = [part.column(name).flatten().to_numpy() for name in _FIELDS[1:]]
                if known and len(columns[2]):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns[2:]], _FIELDS[3:])
                elif not known:
                    found.append(columns[:5])
        if not found:
            return
        symbol, hashes, doc, key, start = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((start, doc, symbol, hashes))
        symbol, hashes, doc, key, start = (c[order] for c in (symbol, hashes, doc, key, start))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (symbol[1:] != symbol[:-1])
        later = np.flatnonzero(_later(doc, start, fresh))
        later = later[np.lexsort((start[later], key[later], doc[later]))]
        if len(later):
            ranges = _ranges(doc[later], key[later], start[later].astype(np.int64), window)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in ranges], _FIELDS[3:])

    sent = keyed.mapInArrow(send, _SCHEMA).repartition(tasks, "bucket")
    return sent.mapInArrow(settle, "doc long, key long, first int, last int")


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: row (all its columns), n_words, n_removed, kept (the words left, one blank between).

    A word goes if a window of ``window`` words covers it whose words also stand at an earlier start: in a
    document with a smaller doc_id, or earlier in the same one. Texts shorter than a window stay whole; a null
    text has no words.
    """
    ranges = checkpointed(
        repeated_ranges(docs, window).groupBy("doc", "key").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    )
    named = as_rows(docs).withColumn("doc", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(_NO_ID)))
    both = named.withColumn("key", F.xxhash64("row.text")).join(ranges, ["doc", "key"], "left").select("row", "ranges")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            stream = words_of(texts, BLANK_SEPARATED, lower=False)
            lists = batch.column("ranges")
            owner = np.repeat(np.arange(len(texts)), np.array(lists.value_lengths().fill_null(0)))
            values = lists.flatten()
            edge = np.zeros(len(stream.start) + 1, np.int64)
            np.add.at(edge, stream.first[owner] + values.field("first").to_numpy(), 1)
            np.add.at(edge, stream.first[owner] + values.field("last").to_numpy() + 1, -1)
            keep = np.cumsum(edge[:-1]) == 0
            removed = np.bincount(stream.text[~keep], minlength=len(texts))
            columns = {
                "row": batch.column("row"),
                "n_words": pa.array(stream.count, pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "kept": word_bytes(stream, keep).cast(pa.string()),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    row = both.schema["row"].dataType.simpleString()
    return both.mapInArrow(cut, f"row:{row},n_words:bigint,n_removed:bigint,kept:string")
