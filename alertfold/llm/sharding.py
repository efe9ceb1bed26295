"""Sharding by jump consistent hashing: no ring table, and a new shard takes rows only into itself.

A document's shard depends on its doc_id and the number of shards alone. Places within a shard follow a second
part of the same digest; they are counted over digest prefixes, so no shard is sorted in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_CELL = 50_000
_MULTIPLIER = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key: where a chain of ever longer jumps, drawn from the key, passes ``shards``."""
    state = keys.astype(np.uint64)
    out = np.zeros(len(state), np.int64)
    moving = np.arange(len(state))
    while len(moving):
        state[moving] = state[moving] * _MULTIPLIER + np.uint64(1)
        drawn = (state[moving] >> np.uint64(33)).astype(np.float64) + 1.0
        landed = np.floor((out[moving] + 1.0) * (float(1 << 31) / drawn))
        moving, landed = moving[landed < shards], landed[landed < shards]
        out[moving] = landed.astype(np.int64)
    return out


def shards_of(key: Column, counts: Sequence[int]) -> Column:
    """Jump hashes of a string key, an array with one for each number of shards; null counts as the empty string."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def places(parts: pa.Array) -> pa.Array:
        keys = parts.to_numpy(zero_copy_only=False).astype(np.int64)
        found = np.stack([jump(keys, n) for n in counts], axis=1).astype(np.int32)
        cuts = np.arange(len(keys) + 1, dtype=np.int32) * len(counts)
        return pa.ListArray.from_arrays(pa.array(cuts), pa.array(found.ravel()))

    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return places(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"))


def with_slots(rows: DataFrame, shard: str, order: list[str], total: int) -> DataFrame:
    """Add ``slot``: 0, 1, ... within each shard, by ``order``, whose first column is a hex digest.

    Rows equal in all of ``order`` take their places in any order. ``total`` is about the number of rows; it
    sets how many digest digits divide a shard into cells that are numbered on their own. ``rows`` must not have
    columns ``cell``, ``place`` and ``before``.
    """
    digits = max(1, math.ceil(math.log(max(1, total / ROWS_PER_CELL), 16)) + 1)
    celled = rows.withColumn("cell", F.substring(order[0], 1, digits))
    before = Window.partitionBy(shard).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = celled.groupBy(shard, "cell").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select(shard, "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy(shard, "cell").orderBy(*order)) - 1
    return (
        celled.withColumn("place", place)
        .join(offsets, [shard, "cell"])
        .withColumn("slot", (F.col("place") + F.col("before")).cast("long"))
        .drop("cell", "place", "before")
    )


def into_shards(docs: DataFrame, shards: int) -> DataFrame:
    """All columns of ``docs`` in their order, then ``shard``, ``slot`` and ``grown_shard`` (with one shard more),
    which replace columns of the same names.

    Rows of one doc_id, null included, share a shard; their places in it follow a digest of doc_id and text, so
    that no single doc_id fills a cell. Null texts count no bytes. An empty table gives none.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    text = F.xxhash64("text")
    own = [c for c in docs.columns if c not in ("shard", "slot", "grown_shard")]
    hashed = docs.select(
        F.struct(*own).alias("row"),
        shards_of(F.col("doc_id"), (shards, shards + 1)).alias("places"),
        F.md5(F.concat_ws(":", key, text.cast("string"))).alias("digest"),
        F.col("doc_id").cast("string").alias("key"),
        text.alias("text"),
    )
    shard = {"shard": F.get("places", F.lit(0)), "grown_shard": F.get("places", F.lit(1))}
    placed = hashed.withColumns(shard).drop("places")
    slotted = with_slots(placed, "shard", ["digest", "key", "text"], docs.count())
    return slotted.select("row.*", "shard", "slot", "grown_shard")
