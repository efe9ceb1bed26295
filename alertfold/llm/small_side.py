"""Joins with a side that is usually small: its rows are counted before anything is broadcast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 200_000


def joined(
    big: DataFrame, small: DataFrame, keys: Sequence[str], how: str, max_rows: int = MAX_BROADCAST_ROWS
) -> DataFrame:
    """``big`` joined with ``small`` on null-safe ``keys``; broadcast up to ``max_rows`` rows, else shuffled.

    Both ways give the same rows. ``small`` should hold narrow columns and be cheap to read twice.
    """
    mark = "_k_"
    while any(c.startswith(mark) for c in (*big.columns, *small.columns)):  # a prefix that no column has
        mark = "_" + mark
    side = small.select(*[F.col(k).alias(mark + k) for k in keys], *[c for c in small.columns if c not in keys])
    same = F.lit(True)
    for key in keys:
        same = same & big[key].eqNullSafe(side[mark + key])
    if small.limit(max_rows + 1).count() <= max_rows:
        side = F.broadcast(side)
    return big.join(side, same, how).drop(*[mark + k for k in keys])
