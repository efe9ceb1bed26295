"""Prompts and the messages that answer them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertfold.plans.ordered import HOT_ROWS, nearest


def pair_replies(
    prompts: DataFrame,
    replies: DataFrame,
    keys: Sequence[str] = ("chat_id", "username"),
    order: str = "seq",
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Each prompt with the next reply under the same keys: reply_<order>, reply_text.

    One reply answers every prompt waiting for it; a prompt without one keeps nulls.
    """
    extra = [c for c in prompts.columns if c not in keys]
    asked = prompts.select(*keys, *extra, F.lit(None).cast(_reply_type(replies, order)).alias("_reply"))
    given = replies.select(
        *keys, order, F.struct(F.col(order).alias("at"), F.col("text").alias("text")).alias("_reply")
    )
    both = asked.withColumn("_prompt", F.lit(1)).unionByName(
        given.withColumn("_prompt", F.lit(0)), allowMissingColumns=True
    )
    # at equal order values a reply comes first, so it does not answer the prompt beside it
    found = nearest(both, list(keys), [order, "_prompt"], "_reply", "_next", after=True, hot_rows=hot_rows)
    return found.filter(F.col("_prompt") == 1).select(
        *keys, *extra, F.col("_next.at").alias(f"reply_{order}"), F.col("_next.text").alias("reply_text")
    )


def _reply_type(replies: DataFrame, order: str) -> str:
    return f"struct<at:{replies.schema[order].dataType.simpleString()},text:string>"
