"""Recent history of a chat, and matching of messages with recent templates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertfold.functions.distance import epoch_micros
from alertfold.functions.templates import matches
from alertfold.plans.ordered import HOT_ROWS, previous_rows

_MINUTE = 60_000_000


def recent_history(
    messages: DataFrame,
    check_count: int = 20,
    max_age_minutes: int = 60,
    payload: Sequence[str] = (),
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """For each message the entries before it in its chat: newest first, at most ``check_count``, as long as
    their age in whole minutes is within the limit.

    Gives the message's columns plus hist_rank (1 = newest), hist_seq, age_minutes and ``hist_<payload>``.
    """
    names = messages.columns
    seen = _entries(messages, check_count, max_age_minutes, payload, hot_rows)
    return seen.select(*names, "hist_rank", "hist_seq", "age_minutes", *[f"hist_{c}" for c in payload])


def _entries(
    messages: DataFrame, check_count: int, max_age_minutes: int, payload: Sequence[str], hot_rows: int | None
) -> DataFrame:
    """Rows of :func:`recent_history`. Entries leave their array first, so that age and all filters behind it are
    compiled; what fails them is never copied."""
    names = messages.columns
    seen = previous_rows(messages, ["chat_id"], ["ts", "seq"], ["ts", "seq", *payload], check_count, "_before", hot_rows)
    entries = seen.select(*names, F.size("_before").alias("_n"), F.posexplode("_before").alias("_i", "_e"))
    passed = epoch_micros(messages) - epoch_micros(messages, value=F.col("_e.ts"))
    age = F.floor(passed / _MINUTE).cast("long")
    young = entries.withColumn("age_minutes", age).filter(F.col("age_minutes") <= max_age_minutes)
    return young.select(
        *names,
        (F.col("_n") - F.col("_i")).cast("long").alias("hist_rank"),
        F.col("_e.seq").alias("hist_seq"),
        "age_minutes",
        *[F.col(f"_e.{c}").alias(f"hist_{c}") for c in payload],
    )


def match_templates(
    entries: DataFrame,
    check_count: int = 20,
    max_age_minutes: int = 60,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Messages with the recent group entries whose template they match.

    ``entries(chat_id, ts, seq, text, pattern, cnt)`` is the chat's history in order; ``pattern`` is null
    for single messages. A message meets at most ``check_count`` templates, however many its chat has.
    Templates are taken apart and tried only on texts that begin and end like them.
    """
    seen = _entries(entries, check_count, max_age_minutes, ["pattern", "cnt"], hot_rows)
    pattern, text = F.col("hist_pattern"), F.col("text")
    likely = F.startswith(text, F.substring_index(pattern, "?", 1)) & F.endswith(text, F.substring_index(pattern, "?", -1))
    hopeful = seen.filter(pattern.isNotNull() & likely).select(
        "chat_id", "seq", "text", "hist_rank", "hist_seq", "hist_pattern", "hist_cnt"
    )
    return hopeful.filter(matches(pattern, text))


def merged_counts(matched: DataFrame) -> DataFrame:
    """Count of the merged group per message: its matched groups plus the message itself."""
    return matched.groupBy("chat_id", "seq").agg((F.sum("hist_cnt") + 1).alias("cnt"))
