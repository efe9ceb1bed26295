"""Boxes: the messages of one chat that are looked at together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertfold.functions.distance import slot_start
from alertfold.plans.ordered import HOT_ROWS, numbered, shuffle_tasks

BOX = ["chat_id", "tick", "box"]


def assign_boxes(
    messages: DataFrame,
    wait: int = 10,
    max_messages: int = 50,
    hot_rows: int | None = HOT_ROWS,
    tick: int | None = None,
) -> DataFrame:
    """Add ``tick`` (start second of the tick), ``box`` (number in the tick) and ``pos`` (place in the box).

    Within a chat and tick, messages are cut into boxes of ``max_messages`` in arrival order; none is lost.
    Needs ``chat_id``, ``ts`` and ``seq``. With ``tick``, all messages belong to that one.
    """
    ticked = messages.withColumn("tick", slot_start(messages, wait) if tick is None else F.lit(tick).cast("long"))
    placed = numbered(ticked, ["chat_id", "tick"], ["ts", "seq"], "_rn", hot_rows)
    return (
        placed.withColumn("box", F.floor((F.col("_rn") - 1) / max_messages).cast("long"))
        .withColumn("pos", ((F.col("_rn") - 1) % max_messages).cast("int"))
        .drop("_rn")
    )


def batch_gate(boxed: DataFrame, min_approx: int = 5) -> DataFrame:
    """Add ``compacted``: whether the box has more than ``min_approx`` messages."""
    size = F.count(F.lit(1)).over(Window.partitionBy(*BOX))
    return boxed.withColumn("compacted", size > min_approx)


def pack_boxes(boxed: DataFrame) -> DataFrame:
    """One row per box with ``msgs``, its messages in arrival order; the box size bounds the array.

    Boxes are spread on their own, although the partitioning by (chat, tick) of :func:`assign_boxes` would
    do: comparing the messages of a box costs far more than moving them, and boxes have a bounded size where
    a chat's tick has none. The number of tasks is kept, because the work is heavy for its bytes.
    """
    # a key of its own, because constant chats or ticks would make Spark shuffle again
    spread = boxed.withColumn("_key", F.xxhash64(*BOX)).repartition(shuffle_tasks(boxed), "_key")
    messages = F.sort_array(F.collect_list(F.struct("pos", "seq", "text")))
    return spread.groupBy("_key", *BOX).agg(messages.alias("msgs")).drop("_key")
