"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, filters slide over them, and each filter's largest value in a chunk describes that chunk.
Chunks overlap by half and cover the whole document. A small layer turns a chunk into a logit; the document's
probability is the logistic function of the mean over its chunks.

The network is trained on a bounded sample of labelled rows, a bounded number of chunks of each.
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
from alertfold.llm.wordstream import as_rows, pieces, short_batches

STRIDE, TAPS = 4, 6
"""A filter sees STRIDE * TAPS bytes and moves by STRIDE."""
BLOCK = 256
"""Bytes by which chunks move; a chunk is two blocks."""
DEPTH, FILTERS, HIDDEN = 8, 64, 16
SAMPLE_PER_CLASS = 1_200
CHUNKS_PER_ROW = 6
_TAIL = STRIDE * (TAPS - 1)
_SPOTS = BLOCK // STRIDE
_TILE = 256
_EPOCHS, _BATCH, _RATE = 6, 64, 4e-3
_CUT_SHARE, _CUT_BYTES = 0.3, (16, 256)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


@dataclass
class Network:
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def fresh(cls, seed: int) -> Network:
        draw = np.random.default_rng(seed)
        width = STRIDE * DEPTH
        shapes = ((256, DEPTH), (TAPS, width, FILTERS), (FILTERS,), (FILTERS + 1, HIDDEN), (HIDDEN,), (HIDDEN,), (1,))
        scales = (0.5, (TAPS * width) ** -0.5, 0.0, FILTERS**-0.5, 0.0, HIDDEN**-0.5, 0.0)
        return cls(*(draw.normal(0, 1, s).astype(np.float32) * np.float32(k) for s, k in zip(shapes, scales)))

    def parts(self) -> list[np.ndarray]:
        return list(self.__dict__.values())

    def responses(self, data: np.ndarray) -> np.ndarray:
        """Filter values at each position of a flat byte array; the last TAPS - 1 strides only lend context."""
        steps = self.embed[data].reshape(-1, STRIDE * DEPTH)
        count = len(steps) - TAPS + 1
        out = steps[:count] @ self.filters[0]
        for tap in range(1, TAPS):
            out += steps[tap : tap + count] @ self.filters[tap]
        return out

    def logits(self, pooled: np.ndarray, fill: np.ndarray) -> np.ndarray:
        """Logit of each chunk from its largest filter values and the share of it that holds text."""
        active = np.column_stack([np.maximum(pooled + self.bias, 0), fill]).astype(np.float32)
        hidden = np.maximum(active @ self.dense + self.dense_bias, 0)
        return hidden @ self.out + self.out_bias[0]

    def score(self, texts: pa.Array) -> np.ndarray:
        """Probability of label 1 for each text, from all its bytes."""
        texts = texts.fill_null(b"") if texts.null_count else texts
        offset = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        size = np.diff(offset)
        blocks = (size + _TAIL) // BLOCK + 1
        first = np.cumsum(blocks) - blocks
        data = np.zeros(int(blocks.sum()) * BLOCK + _TAIL, np.uint8)
        raw = texts.buffers()[2]
        if raw is not None and size.sum():
            at = np.arange(int(size.sum())) + np.repeat(first * BLOCK - (np.cumsum(size) - size), size)
            data[at] = np.frombuffer(raw, np.uint8)[offset[0] : offset[-1]]
        length = np.repeat(size, blocks) - (np.arange(int(blocks.sum())) - np.repeat(first, blocks)) * BLOCK
        largest = np.empty((len(length), FILTERS), np.float32)
        for low in range(0, len(length), _TILE):
            high = min(low + _TILE, len(length))
            values = self.responses(data[low * BLOCK : high * BLOCK + _TAIL]).reshape(high - low, _SPOTS, FILTERS)
            # a position counts if it starts in the text; an empty text has its first one
            inside = np.arange(_SPOTS) * STRIDE < length[low:high, None]
            partial = np.flatnonzero(~inside.all(axis=1))
            values[partial] = np.where(inside[partial, :, None], values[partial], -np.inf)
            largest[low:high] = values.max(axis=1)
        empty = np.flatnonzero(size == 0)
        if len(empty):
            largest[first[empty]] = self.responses(np.zeros(STRIDE * TAPS, np.uint8))[0]
        last = np.zeros(len(length), bool)
        last[first + blocks - 1] = True
        pooled = largest.copy()
        pooled[:-1] = np.where(last[:-1, None], largest[:-1], np.maximum(largest[:-1], largest[1:]))
        # the last block is a chunk of its own only where there is no other
        use = ~last
        use[first[blocks == 1]] = True
        fill = np.clip(length[use] / (2 * BLOCK), 0, 1)
        value, owner = self.logits(pooled[use], fill), np.repeat(np.arange(len(size)), blocks)[use]
        return _logistic(np.bincount(owner, value, minlength=len(size)) / np.bincount(owner, minlength=len(size)))


def _gradients(
    net: Network, data: np.ndarray, length: np.ndarray, label: np.ndarray, weight: np.ndarray
) -> list[np.ndarray]:
    """Gradients of the weighted log loss over chunks (rows of ``data``), in the order of the network's parts."""
    count, width = len(data), STRIDE * DEPTH
    inside = np.arange(2 * _SPOTS) * STRIDE < np.maximum(length, 1)[:, None]
    steps = net.embed[data].reshape(count, -1, width)
    spots = steps.shape[1] - TAPS + 1
    values = sum(steps[:, tap : tap + spots] @ net.filters[tap] for tap in range(TAPS))
    values = np.where(inside[:, :, None], values, -np.inf)
    best = values.argmax(axis=1)
    pooled = np.take_along_axis(values, best[:, None], axis=1)[:, 0] + net.bias
    active = np.column_stack([np.maximum(pooled, 0), length / (2 * BLOCK)]).astype(np.float32)
    before = active @ net.dense + net.dense_bias
    hidden = np.maximum(before, 0)
    error = weight * (_logistic(hidden @ net.out + net.out_bias[0]) - label)
    d_before = (error[:, None] * net.out) * (before > 0)
    d_pooled = (d_before @ net.dense[:-1].T) * (pooled > 0)
    chunk = np.arange(count)[:, None]
    d_filters = np.empty_like(net.filters)
    d_embed = np.zeros((256, DEPTH), np.float64)
    for tap in range(TAPS):
        seen = steps[chunk, best + tap]
        d_filters[tap] = np.einsum("cfw,cf->wf", seen, d_pooled)
        d_seen = (d_pooled[:, :, None] * net.filters[tap].T[None]).reshape(-1, DEPTH)
        at = (best + tap)[:, :, None] * STRIDE + np.arange(STRIDE)
        code = data[chunk[:, :, None], at].reshape(-1)
        for d in range(DEPTH):
            d_embed[:, d] += np.bincount(code, d_seen[:, d], minlength=256)
    return [
        d_embed,
        d_filters,
        d_pooled.sum(axis=0),
        active.T @ d_before,
        d_before.sum(axis=0),
        hidden.T @ error,
        error.sum(keepdims=True),
    ]


def train(data: np.ndarray, length: np.ndarray, label: np.ndarray, weight: np.ndarray, seed: int = 7) -> Network:
    """A network from chunks of 2 * BLOCK + _TAIL bytes, of which ``length`` are text.

    In every round some chunks are cut short, so that short texts are known too.
    """
    net, draw = Network.fresh(seed), np.random.default_rng(seed)
    moments = [(np.zeros(p.shape), np.zeros(p.shape)) for p in net.parts()]
    step = 0
    for epoch in range(_EPOCHS):
        order = draw.permutation(len(data))
        for low in range(0, len(order), _BATCH):
            take = order[low : low + _BATCH]
            step += 1
            rate = _RATE * (1 - epoch / _EPOCHS)
            short = np.where(draw.random(len(take)) < _CUT_SHARE, draw.integers(*_CUT_BYTES, len(take)), 2 * BLOCK)
            size = np.minimum(length[take], short)
            end = np.where(size < length[take], size, data.shape[1])
            seen = np.where(np.arange(data.shape[1]) < end[:, None], data[take], 0)
            grads = _gradients(net, seen, size, label[take], weight[take] / len(take))
            for part, grad, (m, v) in zip(net.parts(), grads, moments):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad**2 - v)
                part -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def _chunks_of(texts: list[bytes], most: int) -> Iterator[tuple[int, int, bytes]]:
    """(text, length, bytes) of up to ``most`` chunks of each text, spread evenly."""
    span = 2 * BLOCK
    for index, text in enumerate(texts):
        count = max(1, (len(text) + _TAIL) // BLOCK)
        for at in sorted(set(np.linspace(0, count - 1, min(most, count)).astype(int))):
            part = text[at * BLOCK : at * BLOCK + span + _TAIL]
            yield index, min(span, len(text) - at * BLOCK), part.ljust(span + _TAIL, b"\0")


def fit(
    docs: DataFrame, rows: DataFrame, per_class: int = SAMPLE_PER_CLASS, chunks: int = CHUNKS_PER_ROW
) -> Network | float:
    """Learn from ``docs`` (doc_id, text) and ``rows`` (doc_id, label).

    At most ``per_class`` rows of each class and ``chunks`` chunks of each reach the driver: where ``docs`` repeats a
    doc_id, the smallest of its texts. Classes weigh as in ``rows``. Without rows of both classes the result is a fixed score: that of the class there is, or 0.5.
    """
    short_batches(docs)
    sizes = labelled.class_sizes(rows)
    if not all(sizes):
        return 0.5 if not any(sizes) else float(sizes[1] > 0)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            label = batch.column("label").to_pylist()
            found = list(_chunks_of([t or b"" for t in texts.to_pylist()], chunks))
            count = np.bincount([f[0] for f in found], minlength=len(label))
            columns = [
                pa.array([label[f[0]] for f in found], pa.int32()),
                pa.array([1.0 / count[f[0]] for f in found]),
                pa.array([f[1] for f in found], pa.int32()),
                pa.array([f[2] for f in found], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["label", "share", "length", "data"])

    chosen = labelled.texts_of(joined(docs.select("doc_id", "text"), labelled.sample(rows, per_class), ["doc_id"], "inner"))
    cuts = chosen.select(F.struct("text").alias("row"), "label").mapInArrow(
        cut, "label int, share double, length int, data binary"
    )
    table = cuts.orderBy("data", "length", "label").toArrow()
    if not table.num_rows:
        return 0.5
    label = table.column("label").to_numpy()
    share = table.column("share").to_numpy()
    taken = np.array([share[label == 0].sum(), share[label == 1].sum()])
    weight = share * (np.array(sizes) / np.maximum(taken, 1e-9))[label]
    weight *= len(weight) / weight.sum()
    data = np.frombuffer(b"".join(table.column("data").to_pylist()), np.uint8).reshape(len(label), -1)
    return train(data, table.column("length").to_numpy(), label.astype(np.float32), weight.astype(np.float32))


def score(docs: DataFrame, model: Network | float) -> DataFrame:
    """Per row of ``docs``: row (all its columns) and ``score``, the probability of label 1.

    Whole texts count, very long ones too; null is scored as empty. Rows are independent, repeated ones get equal
    scores; nothing is shuffled. An empty table gives none.
    """
    rows = as_rows(docs)
    given = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            known = given.value
            value = np.full(len(texts), known) if isinstance(known, float) else known.score(texts)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(value.astype(np.float64))], ["row", "score"])

    return rows.mapInArrow(run, f"{rows.schema.simpleString()[7:-1]},score:double")
