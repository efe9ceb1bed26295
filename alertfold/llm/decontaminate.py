"""Benchmark decontamination: one Aho-Corasick automaton over test items, each text scanned once.

A pattern is a window of consecutive item words, normalised and set between blanks. Documents are normalised
in the same way, many in one pass, and every match is mapped back to words and characters of the original.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertfold.llm.wordstream import LETTERS_AND_DIGITS, WordStream, as_rows, normalised, pieces, words_of
from alertfold.plans.storage import checkpointed

WINDOW = 10
MAX_AUTOMATON_BYTES = 4 << 20
"""Bytes of patterns in one automaton; a larger benchmark is scanned for in several passes."""
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RANGE = pa.struct([(name, pa.int64()) for name in ("first", "last", "begin", "end")])
_RANGES = "array<struct<first:bigint,last:bigint,begin:bigint,end:bigint>>"


def words(text: Column) -> Column:
    """Words of a text with A-Z in lower case, in the JVM."""
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(window, item_id), distinct: all windows of each item; the whole of a shorter one.

    Items without words, and rows whose item_id or text is null, have none. Rows of one item_id are one item.
    """
    worded = items.filter("item_id IS NOT NULL").select("item_id", words(F.col("text")).alias("_words"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("_words") - window + 1, F.lit(1)))
    each = F.transform(starts, lambda at: F.array_join(F.slice("_words", at, window), " "))
    return worded.filter(F.size("_words") > 0).select(F.explode(each).alias("window"), "item_id").distinct()


def blocks(windows: DataFrame, max_bytes: int) -> list[Callable[[], dict[str, list]]]:
    """The windows and their items in blocks of about ``max_bytes``, as functions that load one each."""
    held = checkpointed(windows)
    size = held.agg(F.sum(F.octet_length("window") + 16)).first()[0] or 0
    count = -(-size // max_bytes)

    def load(block: int) -> dict[str, list]:
        patterns: dict[str, list] = {}
        for row in held.filter(F.pmod(F.xxhash64("window"), F.lit(count)) == block).toLocalIterator():
            patterns.setdefault(row.window, []).append(row.item_id)
        return patterns

    return [lambda block=block: load(block) for block in range(count)]


def _automaton(patterns: dict[str, list]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for text, items in patterns.items():
        out.add_word(f" {text} ".encode().decode("latin-1"), (text.count(" ") + 1, items))
    out.make_automaton()
    return out


def _covered(stream: WordStream, known: list[list[dict]], first: np.ndarray, last: np.ndarray) -> pa.Array:
    """Matches and the ranges known before, merged per text."""
    old = [(stream.first[t] + r["first"], stream.first[t] + r["last"]) for t, ranges in enumerate(known) for r in ranges]
    opened = np.zeros(len(stream.start) + 1, np.int64)
    np.add.at(opened, np.concatenate([first, [o[0] for o in old]]).astype(np.int64), 1)
    np.add.at(opened, np.concatenate([last, [o[1] for o in old]]).astype(np.int64) + 1, -1)
    inside = np.cumsum(opened[:-1]) > 0
    fresh = np.ones(len(inside), bool)
    fresh[1:] = stream.text[1:] != stream.text[:-1]
    low = np.flatnonzero(inside & (fresh | ~np.concatenate([[False], inside[:-1]])))
    high = np.flatnonzero(inside & np.concatenate([fresh[1:] | ~inside[1:], [True]])) if len(inside) else low
    chars = np.concatenate([[0], np.cumsum((stream.data & 0xC0) != 0x80)])
    text = stream.text[low]
    before, zero = stream.first[text], chars[stream.offset[text]]
    values = (low - before, high - before, chars[stream.start[low]] - zero, chars[stream.end[high]] - zero)
    ranges = pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in values], fields=list(_RANGE))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(known) + 1)), pa.int32()), ranges)


def _pass(rows: DataFrame, patterns: dict[str, list]) -> DataFrame:
    """Scan ``row.text`` with one automaton and add what it matches to ``hits`` and ``item_ids``."""
    given = rows.sparkSession.sparkContext.broadcast(patterns)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(given.value)
        for batch, texts in pieces(batches):
            stream = words_of(texts, LETTERS_AND_DIGITS, lower=True)
            text, ends = normalised(stream)
            found = list(automaton.iter(text)) if given.value else []
            last = np.searchsorted(ends, np.array([at for at, _ in found], np.int64))
            first = last - np.array([size for _, (size, _) in found], np.int64) + 1
            items = [set(known) for known in batch.column("item_ids").to_pylist()]
            for owner, (_, (_, named)) in zip(stream.text[first].tolist(), found):
                items[owner].update(named)
            columns = {
                "row": batch.column("row"),
                "n_words": pa.array(stream.count, pa.int64()),
                "hits": _covered(stream, batch.column("hits").to_pylist(), first, last),
                "item_ids": pa.array([sorted(named) for named in items], batch.schema.field("item_ids").type),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return rows.mapInArrow(run, rows.schema)


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_bytes: int = MAX_AUTOMATON_BYTES) -> DataFrame:
    """Per row of ``docs``: row (all its columns), n_words, hits, item_ids.

    ``hits`` are the parts of the text that matches cover, in order: words ``first`` to ``last`` from 0, and
    characters from ``begin`` up to ``end``. ``item_ids`` are the items with a window in the text, sorted. A null
    text has no words; repeated rows count on their own; without items nothing is hit. Nothing is shuffled. A
    benchmark above ``max_bytes`` takes one pass per block.
    """
    item_type = items.schema["item_id"].dataType.simpleString()
    out = as_rows(docs).select(
        "row",
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast(_RANGES).alias("hits"),
        F.array().cast(f"array<{item_type}>").alias("item_ids"),
    )
    for number, load in enumerate(blocks(item_windows(items, window), max_bytes) or [dict]):
        out = _pass(checkpointed(out) if number else out, load())
    return out


def without_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` whose text holds no window of any item, with all their columns."""
    return scan(docs, items, window).filter(F.size("hits") == 0).select("row.*")
