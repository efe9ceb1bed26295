"""Packing tokenised documents into sequences of fixed capacity, with hardly any padding.

Harmonic packing: a piece of length n belongs to class ``k = capacity // n``, and a sequence of class k takes
exactly k pieces of it, whichever they are. A class needs to know nothing but its own open sequence, so every
worker fills its own sequences alone, without a shuffle. Documents are cut so that pieces fill their class well:
whole sequences first; then of the rest, again and again, the longest piece whose class leaves at most ``slack``
tokens of a sequence empty.

What a worker's open sequences hold at its end is less than a sequence per class. It is joined, cut into full
sequences, and the remainder into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from alertfold.llm.wordstream import as_rows, pieces

CAPACITY = 1024
SLACK = 16
END = 0
SEGMENT = 1 << 16
LONG = 256
SEQUENCES_PER_WORKER = 1 << 36
SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
)
_ROWS_PER_BATCH = 4096

# fixed value: how byte-level vocabularies split a text before any merge
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# a blank between two characters that are surely no white space: there a word begins, and no merge goes across words
_CUT = re.compile("(?<=[!-~\u00c0-\u00ff]) (?=[!-~\u00c0-\u00ff])")
_PLAIN = re.compile("[\x00-\x7f\u00c0-\u00ff]*")
_BLANKS = re.compile(r"\s{%d}" % LONG)


def segments(text: str) -> Iterator[str]:
    """Parts of a text, which together have its tokens, of about SEGMENT characters where it can be cut there."""
    low = 0
    while len(text) - low > SEGMENT:
        found = _CUT.search(text, low + SEGMENT)
        if not found:
            break
        yield text[low : found.start()]
        low = found.start()
    yield text[low:] if low else text


def _ranked(definition: str) -> tiktoken.Encoding | None:
    """The same vocabulary for a faster encoder of the same kind, where merges are in the order of their ids."""
    data = json.loads(definition)
    model, before = data["model"], data.get("pre_tokenizer") or {}
    vocabulary, extra = model.get("vocab", {}), {t["content"] for t in data.get("added_tokens", [])}
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model.get("merges", [])]
    made = [vocabulary.get("".join(m), -1) for m in merges]
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "end_of_word_suffix", "byte_fallback"))
    bytewise = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    if not (plain and bytewise and data.get("normalizer") is None and made == sorted(made) and made[:1] > [-1]):
        return None
    # the usual letters of byte-level vocabularies: printable bytes stand for themselves, the others follow from 256
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if token not in extra}
    return tiktoken.Encoding("ranked", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


class Tokens:
    """Ids of texts by the tokenizer of a definition.

    Texts of ASCII and Latin letters without very long words go through an encoder that is several times as fast
    and gives the same ids; tests hold both against each other. All others go through the tokenizer itself.
    """

    def __init__(self, definition: str) -> None:
        self.tokenizer = Tokenizer.from_str(definition)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranked = _ranked(definition)

    def _fast(self, text: str) -> bool:
        """Whether both encoders split alike, and in time proportional to the text."""
        if self.ranked is None or not (text.isascii() or _PLAIN.fullmatch(text)):
            return False
        short = max(map(len, text.split()), default=0) < LONG and not _BLANKS.search(text)
        return short and not any(s in text for s in self.special)

    def ids(self, text: str) -> np.ndarray:
        """Ids of a text, and END."""
        found = []
        for part in segments(text):
            if self._fast(part):
                found.append(self.ranked.encode_to_numpy(part, disallowed_special=()).astype(np.uint32))
            else:
                found.append(np.array(self.tokenizer.encode(part, add_special_tokens=False).ids, np.uint32))
        return np.concatenate([*found, np.array([END], np.uint32)])


@cache
def _tokens(definition: str) -> Tokens:
    return Tokens(definition)


@cache
def _longest(capacity: int, slack: int) -> list[int]:
    """For each rest the longest piece not above it whose class fills a sequence up to ``slack``."""
    out = [0]
    for n in range(1, capacity + 1):
        out.append(n if capacity % n <= slack else out[-1])
    return out


def piece_lengths(length: int, capacity: int = CAPACITY, slack: int = SLACK) -> list[int]:
    """How a document of ``length`` tokens is cut."""
    out = [capacity] * (length // capacity)
    rest = length % capacity
    while rest:
        out.append(_longest(capacity, slack)[rest])
        rest -= out[-1]
    return out


class Bins:
    """The open sequences of one worker, one per class."""

    def __init__(self, worker: int, capacity: int) -> None:
        self.open: dict[int, list[tuple]] = {}
        self.capacity = capacity
        self.next = worker * SEQUENCES_PER_WORKER
        self.out: list[tuple] = []

    def _close(self, held: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in held:
            self.out.append((doc, start, len(ids), ids.tobytes(), total, self.next, offset))
            offset += len(ids)
        self.next += 1

    def add(self, doc: int | None, start: int, ids: np.ndarray, total: int) -> None:
        k = self.capacity // len(ids)
        held = self.open.setdefault(k, [])
        held.append((doc, start, ids.copy(), total))
        if len(held) == k:
            self._close(self.open.pop(k))

    def finish(self) -> None:
        """Join what is left, in the order of classes, into full sequences and powers of two."""
        left = [piece for k in sorted(self.open) for piece in self.open[k]]
        self.open = {}
        tokens = sum(len(ids) for _, _, ids, _ in left)
        rest = tokens % self.capacity
        room = [self.capacity] * (tokens // self.capacity)
        room += [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        held: list[tuple] = []
        for doc, start, ids, total in left:
            while len(ids):
                free = room[0] - sum(len(h[2]) for h in held)
                held.append((doc, start, ids[:free], total))
                start, ids = start + min(free, len(ids)), ids[free:]
                if len(held[-1][2]) == free:
                    self._close(held)
                    held = []
                    room.pop(0)

    def batch(self) -> pa.RecordBatch:
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        kinds = [pa.binary() if n == "ids" else pa.int64() for n in names]
        rows, self.out = self.out, []
        columns = list(zip(*rows)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, slack: int = SLACK) -> DataFrame:
    """Pieces of the documents (doc_id, text) in sequences of ``capacity`` tokens: doc_id, start (the document's ids
    before the piece), length, ids (unsigned 32-bit, little-endian), doc_tokens (all ids of the document),
    sequence_id, offset (place of the piece in its sequence).

    A document's ids are those of the tokenizer in the file ``tokenizer_path``, without special tokens around
    them, and END. Every id lies in exactly one piece; a null or empty text has just END. Rows are packed one by
    one: repeated rows and repeated or null doc_ids each bring their own pieces. Other columns of ``docs`` play
    no part. An empty table gives no rows. A sequence is full but for at most ``slack`` tokens of padding, or as
    long as a power of two. ``capacity`` must be a power of two.

    sequence_id is unique, not gapless: its upper bits are the worker's. A long text is tokenised by segments cut
    between words, but its ids are held whole in its task. The file is read where the query starts and
    sent to the executors.
    """
    if capacity < 2 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    with open(tokenizer_path, encoding="utf-8") as file:
        sent = docs.sparkSession.sparkContext.broadcast(file.read())  # a vocabulary: a few megabytes

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        tokens = _tokens(sent.value)
        bins = Bins(TaskContext.get().partitionId(), capacity)
        for batch, texts in pieces(batches):
            for doc, text in zip(pc.struct_field(batch.column("row"), "doc_id").to_pylist(), texts):
                ids = tokens.ids((text.as_py() or b"").decode())
                at = 0
                for length in piece_lengths(len(ids), capacity, slack):
                    bins.add(doc, at, ids[at : at + length], len(ids))
                    at += length
                if len(bins.out) >= _ROWS_PER_BATCH:
                    yield bins.batch()
        bins.finish()
        yield bins.batch()

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return as_rows(narrow).mapInArrow(run, SCHEMA)
