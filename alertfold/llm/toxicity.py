"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Texts are normalised to lower-case words with a blank around each; a feature is the presence of an n-gram, by a
hashed slot. The ratio of a slot is the log of how much likelier it is in toxic texts, counted over all
labelled rows in Spark. The slots that tell the classes apart best carry weights, which logistic regression
fits on a bounded sample of rows, each feature scaled by its ratio.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertfold.llm import labelled
from alertfold.llm.small_side import joined
from alertfold.llm.wordstream import LETTERS_AND_DIGITS, as_rows, mixed, normalised, pieces, short_batches, words_of

SIZES = (3, 4, 5, 6)
SLOT_BITS = 20
CHUNK_BITS = 14
MAX_FEATURES = 6_000
MIN_SCORE = 12.0
SAMPLE_PER_CLASS = 2_000
"""Labelled rows of each class at most, for the weights. Ratios are counted over all labelled rows."""
_SMOOTHING = 1.0
_CHUNKS = ["chunk", "clean", "toxic"]
_ROUNDS, _RATE, _PENALTY = 250, 0.05, 1e-4


def grams(texts: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, slot) of the distinct n-grams of each text, in order; ``wanted`` keeps the slots marked in it."""
    stream = words_of(texts, LETTERS_AND_DIGITS, lower=True)
    line, _ = normalised(stream)
    data = np.frombuffer(line.encode("latin-1"), np.uint8)
    breaks = np.flatnonzero(data == 0x0A)
    places = np.arange(len(data))
    room = np.append(breaks, len(data))[np.searchsorted(breaks, places)] - places
    owner = np.flatnonzero(stream.count > 0)[np.searchsorted(breaks, places[: breaks[-1] + 1])] if len(breaks) else places[:0]
    rolling = np.zeros(len(data), np.uint64)
    found = []
    for width in range(1, max(SIZES) + 1):
        count = len(data) - width + 1
        if count <= 0:
            break
        rolling = rolling[:count] * np.uint64(0x100000001B3) + data[width - 1 :]
        if width in SIZES:
            at = np.flatnonzero(room[:count] >= width)
            slot = mixed(rolling[at], width) >> np.uint64(64 - SLOT_BITS)
            if wanted is not None:
                keep = wanted[slot]
                at, slot = at[keep], slot[keep]
            at, slot = at[at < len(owner)], slot[at < len(owner)]
            found.append((owner[at].astype(np.uint64) << np.uint64(SLOT_BITS)) | slot)
    keys = np.concatenate(found) if found else np.zeros(0, np.uint64)
    keys.sort()
    keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
    return (keys >> np.uint64(SLOT_BITS)).astype(np.int64), (keys & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)


def slot_counts(rows: DataFrame) -> DataFrame:
    """(slot, clean, toxic): texts of each class with an n-gram of the slot, from rows of (text, label).

    Tasks add up counts of all slots and hand them on in chunks, so what is shuffled doesn't grow with texts.
    """
    chunk = 1 << CHUNK_BITS

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << SLOT_BITS), np.int32)
        for batch, texts in pieces(batches):
            label = batch.column("label").to_numpy()
            text, slot = grams(texts)
            for of in (0, 1):
                counts[of] += np.bincount(slot[label[text] == of], minlength=1 << SLOT_BITS).astype(np.int32)
        held = [c for c in range(1 << (SLOT_BITS - CHUNK_BITS)) if counts[:, c * chunk : (c + 1) * chunk].any()]
        lists = [[counts[of, c * chunk : (c + 1) * chunk] for c in held] for of in (0, 1)]
        kind = pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), *(pa.array(x, kind) for x in lists)], _CHUNKS)

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            values = [batch.column(of).flatten().to_numpy().reshape(-1, chunk) for of in (1, 2)]
            for row, c in enumerate(batch.column(0).to_pylist()):
                totals[c] = totals.get(c, 0) + np.stack([values[0][row], values[1][row]]).astype(np.int64)
        for c, both in totals.items():
            slot = np.flatnonzero(both.any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (slot + c * chunk, *both[:, slot])], ["slot", *_CHUNKS[1:]])

    parts = rows.select(F.struct("text").alias("row"), "label")
    tasks = max(1, min(64, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    counted = parts.mapInArrow(count, "chunk int, clean array<int>, toxic array<int>")
    return counted.repartition(tasks, "chunk").mapInArrow(add, "slot bigint, clean bigint, toxic bigint")


@dataclass(frozen=True)
class Model:
    """Weights by slot; a text scores the logistic function of ``bias`` plus the weights of its slots."""

    weight: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        text, slot = grams(texts, self.weight != 0)
        return _logistic(self.bias + np.bincount(text, self.weight[slot], minlength=len(texts)))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def _regression(
    row: np.ndarray, column: np.ndarray, scale: np.ndarray, label: np.ndarray, importance: np.ndarray
) -> tuple[np.ndarray, float]:
    """Weights of scaled presence features by gradient steps of adaptive size."""
    value = scale[column]
    weights, moment, square = (np.zeros(len(scale) + 1) for _ in range(3))
    weights[:-1] = 0.1
    for step in range(1, _ROUNDS + 1):
        z = np.bincount(row, value * weights[column], minlength=len(label)) + weights[-1]
        error = importance * (_logistic(z) - label)
        gradient = np.append(np.bincount(column, value * error[row], minlength=len(scale)), error.sum())
        gradient[:-1] += _PENALTY * weights[:-1]
        moment = 0.9 * moment + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        weights -= _RATE * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return weights[:-1] * scale, float(weights[-1])


def fit(
    docs: DataFrame,
    rows: DataFrame,
    max_features: int = MAX_FEATURES,
    per_class: int = SAMPLE_PER_CLASS,
) -> Model:
    """Learn from ``docs`` (doc_id, text) and ``rows`` (doc_id, label).

    Counts take all rows, the weights at most ``per_class`` rows of each class (the smallest text of a doc_id that
    ``docs`` repeats) and the ``max_features`` slots that tell the classes apart best, of those with a chi-squared
    score of MIN_SCORE at least. What reaches the driver is bounded by ``max_features`` and ``per_class``. Without rows of both classes every text gets their share of label 1, or
    0.5 without any row.
    """
    short_batches(docs)
    clean, toxic = labelled.class_sizes(rows)
    nothing = np.zeros(1 << SLOT_BITS)
    if not clean or not toxic:
        return Model(nothing, 0.0 if clean + toxic == 0 else 500.0 * np.sign(toxic - clean))
    known = joined(docs.select("doc_id", "text"), rows, ["doc_id"], "inner")
    p, q = (F.col("toxic") + _SMOOTHING) / (toxic + 2 * _SMOOTHING), (F.col("clean") + _SMOOTHING) / (clean + 2 * _SMOOTHING)
    share = (F.col("toxic") + F.col("clean")) / (clean + toxic)
    deviation = (F.col("toxic") / toxic - F.col("clean") / clean) ** 2 / (share * (1 - share) + 1e-9)
    ranked = slot_counts(known.select("text", "label")).select(
        "slot", F.log(p / q).alias("ratio"), (deviation * clean * toxic / (clean + toxic)).alias("chi")
    )
    best = ranked.filter(F.col("chi") >= MIN_SCORE).orderBy(F.desc("chi"), "slot").limit(max_features).collect()
    slots = np.array([r.slot for r in best], np.int64)
    ratios = np.array([r.ratio for r in best], np.float64)
    wanted = np.zeros(1 << SLOT_BITS, bool)
    wanted[slots] = True

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            text, slot = grams(texts, wanted)
            cuts = pa.array(np.searchsorted(text, np.arange(len(texts) + 1)), pa.int32())
            lists = pa.ListArray.from_arrays(cuts, pa.array(slot.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("label"), lists], ["label", "slots"])

    chosen = labelled.texts_of(joined(docs.select("doc_id", "text"), labelled.sample(rows, per_class), ["doc_id"], "inner"))
    seen = chosen.select(F.struct("text").alias("row"), "label").mapInArrow(extract, "label int, slots array<int>")
    table = seen.toArrow().combine_chunks()
    label = table.column("label").to_numpy()
    lists = table.column("slots").combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray) else lists.chunk(0)
    row = np.repeat(np.arange(len(label)), lists.value_lengths().to_numpy(zero_copy_only=False))
    place = np.full(1 << SLOT_BITS, -1)
    place[slots] = np.arange(len(slots))
    share_of = np.where(label == 1, toxic / max(1, label.sum()), clean / max(1, (1 - label).sum())) / (clean + toxic)
    weights, bias = _regression(row, place[lists.flatten().to_numpy()], ratios, label.astype(np.float64), share_of)
    nothing[slots] = weights
    return Model(nothing, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of ``docs``: row (all its columns) and ``score``, the probability of label 1.

    Whole texts count, very long ones too; null and empty texts have no features. Rows are independent, repeated
    ones get equal scores; nothing is shuffled. An empty table gives none.
    """
    rows = as_rows(docs)
    given = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(given.value.score(texts))], ["row", "score"])

    return rows.mapInArrow(run, f"{rows.schema.simpleString()[7:-1]},score:double")
