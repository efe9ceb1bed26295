"""Pages and chunks of ordered lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertfold.plans.ordered import HOT_ROWS, numbered


def paginate(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    size: int = 5,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Add ``rn``, ``page`` (from 0) and ``pages`` per list. The order must be unique within a list.

    Places and page counts come from one pass over the sorted rows; only the search for lists too long for a task
    reads the keys once more. The one list without keys is counted and numbered by its parts.
    """
    placed = numbered(df, keys, order, "rn", hot_rows, "_total")
    page = F.floor((F.col("rn") - 1) / size).cast("long")
    pages = F.ceil(F.col("_total") / size).cast("long")
    return placed.withColumns({"page": page, "pages": pages}).drop("_total")


def chunk(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    size: int = 10,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Lists cut into chunks of ``size`` values: chunk (from 0), items."""
    placed = numbered(df, keys, order, "_rn", hot_rows).withColumn(
        "chunk", F.floor((F.col("_rn") - 1) / size).cast("long")
    )
    packed = F.sort_array(F.collect_list(F.struct("_rn", F.col(value).alias("item"))))
    return placed.groupBy(*keys, "chunk").agg(F.transform(packed, lambda p: p["item"]).alias("items"))
