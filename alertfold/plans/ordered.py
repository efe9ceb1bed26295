"""Ordered work per key (numbering, nearest value, recent rows) that survives hot keys.

A window function puts all rows of one key into one task. That is the cheapest plan for ordinary keys, so
they keep it: one hash shuffle. Keys above ``hot_rows`` rows, or as many times ROW_BYTES of texts, are taken out,
range-partitioned by (key, order) so that each spans many parts, solved per part, and joined with what earlier
parts carry over. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertfold.plans.storage import checkpointed

HOT_ROWS = 1_000_000
MAX_HOT_KEYS = 100_000
ROW_BYTES = 64  # of texts count as a row
_PART, _AT = "_part", "_at_row"
_MASK = (1 << 33) - 1  # of monotonically_increasing_id: the row within its partition


def _rows(df: DataFrame) -> Column:
    """Number of rows, long texts counted by their bytes."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    size = sum((F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)).cast("long") for c in texts), F.lit(0).cast("long"))
    return F.greatest(F.count(F.lit(1)), F.floor(F.coalesce(F.sum(size), F.lit(0)) / ROW_BYTES).cast("long"))


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int) -> DataFrame | None:
    """Keys with too many or too large rows for one task, or None. At most MAX_HOT_KEYS rows.

    The bar is never below total / MAX_HOT_KEYS, so no more than MAX_HOT_KEYS keys can lie above it, and
    every other key holds at most one MAX_HOT_KEYS-th of the rows or ``hot_rows``.
    """
    return _hot_keys(df, keys, hot_rows)[0]


def _hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int) -> tuple[DataFrame | None, int]:
    """The same, and the rows of all keys."""
    sizes = df.groupBy(*keys).agg(_rows(df).alias("_n"))
    top = sizes.agg(F.max("_n").alias("largest"), F.sum("_n").alias("total")).first()
    if top.largest is None or top.largest <= hot_rows:
        return None, 0
    bar = max(hot_rows, top.total // MAX_HOT_KEYS)
    hot = sizes.filter(F.col("_n") > bar).select(*keys)
    rows = hot.take(MAX_HOT_KEYS)
    return (df.sparkSession.createDataFrame(rows, hot.schema) if rows else None), top.total


def shuffle_tasks(df: DataFrame) -> int:
    """The configured number of shuffle tasks. Given to repartition, AQE keeps it."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def split_hot(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], hot_rows: int | None
) -> tuple[DataFrame | None, DataFrame | None]:
    """(ordinary rows, hot rows with a ``_part`` number that grows with the order and their place in the part)."""
    if hot_rows is None:
        return df, None
    if keys:
        hot, rows = _hot_keys(df, keys, hot_rows)
        if hot is None:
            return df, None
        renamed = F.broadcast(hot.select([F.col(k).alias(f"_hot_{k}") for k in keys]))
        same = F.lit(True)
        for key in keys:
            same = same & df[key].eqNullSafe(renamed[f"_hot_{key}"])
        cold = df.join(renamed, same, "left_anti")
        hot_part = df.join(renamed, same, "left_semi")
    else:
        rows = df.agg(_rows(df)).first()[0]
        if rows <= hot_rows:
            return df, None
        cold, hot_part = None, df
    parts = max(shuffle_tasks(df), rows // HOT_ROWS)
    spread = hot_part.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit(_MASK))
    return cold, checkpointed(spread.withColumns({_PART: F.spark_partition_id(), _AT: at}))


def _merge(cold: DataFrame | None, hot: DataFrame | None) -> DataFrame:
    if hot is None:
        return cold
    return hot if cold is None else cold.unionByName(hot)


def _with_carry(hot: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join the per-part carry: one row per (hot key, part), so at most MAX_HOT_KEYS + parts rows."""
    side = carry.select(
        F.col(_PART).alias("_carry_part"), *[F.col(k).alias(f"_carry_{k}") for k in keys], "_carry"
    )
    same = hot[_PART] == side["_carry_part"]
    for key in keys:
        same = same & hot[key].eqNullSafe(side[f"_carry_{key}"])
    return hot.join(F.broadcast(side), same, "left").drop("_carry_part", *[f"_carry_{k}" for k in keys])


def _number_parts(hot: DataFrame, keys: Sequence[str], out: str, total: str | None = None) -> DataFrame:
    """Parts are sorted, so a row's number is its place behind the first of its key; rows do not move again."""
    sizes = hot.groupBy(*keys, _PART).agg(F.count(F.lit(1)).alias("_n"), F.min(_AT).alias("_first"))
    before = Window.partitionBy(*keys).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum("_n").over(before), F.lit(0))
    whole = F.sum("_n").over(Window.partitionBy(*keys))
    carry = sizes.withColumn("_carry", F.struct((earlier - F.col("_first") + 1).alias("shift"), whole.alias("whole")))
    carried = _with_carry(hot, carry, keys)
    counts = {out: F.col(_AT) + F.col("_carry.shift")} | ({} if total is None else {total: F.col("_carry.whole")})
    return carried.withColumns(counts).drop(_PART, _AT, "_carry")


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    out: str = "rn",
    hot_rows: int | None = HOT_ROWS,
    total: str | None = None,
) -> DataFrame:
    """Add ``out``: 1, 2, ... per key in the given order, and ``total``, if named: the rows of the key.

    The order must be unique within a key. Both come from the same pass over the sorted rows.
    """
    cold, hot = split_hot(df, keys, order, hot_rows)
    if cold is not None:
        cold = cold.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
        if total is not None:
            cold = cold.withColumn(total, F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    if hot is not None:
        hot = _number_parts(hot, keys, out, total)
    return _merge(cold, hot)


def nearest(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    out: str,
    after: bool = False,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Add ``out``: the nearest non-null ``value`` strictly before each row (or after it) within its key.

    The frame always grows from one end, so each part is one sorted pass, in both directions.
    """
    cold, hot = split_hot(df, keys, order, hot_rows)
    direction = [F.col(c).desc() for c in order] if after else [F.col(c).asc() for c in order]

    def scan(by: Sequence[str]) -> Column:
        frame = Window.partitionBy(*by).orderBy(*direction).rowsBetween(Window.unboundedPreceding, -1)
        return F.last(value, ignorenulls=True).over(frame)

    if cold is not None:
        cold = cold.withColumn(out, scan(keys))
    if hot is not None:
        position = F.when(F.col(value).isNotNull(), F.struct(*order))
        pick = F.min_by if after else F.max_by
        ends = hot.groupBy(*keys, _PART).agg(pick(F.col(value), position).alias("_end"))
        part_order = F.col(_PART).desc() if after else F.col(_PART).asc()
        passed = Window.partitionBy(*keys).orderBy(part_order).rowsBetween(Window.unboundedPreceding, -1)
        carry = ends.withColumn("_carry", F.last("_end", ignorenulls=True).over(passed))
        hot = (
            _with_carry(hot.withColumn(out, scan([*keys, _PART])), carry, keys)
            .withColumn(out, F.coalesce(F.col(out), F.col("_carry")))
            .drop(_PART, _AT, "_carry")
        )
    return _merge(cold, hot)


def previous_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    payload: Sequence[str],
    count: int,
    out: str,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Add ``out``: the ``payload`` of up to ``count`` rows before each row, oldest first.

    A hot key is numbered and cut into cells of many rows; each cell also receives the last ``count`` rows
    of the cell before it, so every row still sees all its predecessors.
    """
    entry = F.struct(*payload)
    cold, hot = split_hot(df, keys, order, hot_rows)

    def look_back(by: Sequence[str]) -> Column:
        return F.collect_list(entry).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(-count, -1))

    if cold is not None:
        cold = cold.withColumn(out, look_back(keys))
    if hot is not None:
        cell_rows = max(100 * count, 1000)
        ranked = _number_parts(hot, keys, "_rn")
        own = F.floor((F.col("_rn") - 1) / cell_rows)
        near_end = (F.col("_rn") - 1) % cell_rows >= cell_rows - count
        copies = F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own))
        cells = ranked.withColumn("_own", own).withColumn("_cell", F.explode(copies))
        hot = (
            cells.withColumn(out, look_back([*keys, "_cell"]))
            .filter(F.col("_cell") == F.col("_own"))
            .drop("_rn", "_own", "_cell")
        )
    return _merge(cold, hot)
