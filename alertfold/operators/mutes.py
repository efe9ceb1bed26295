"""Mutes: messages of a muted chat, or of any chat under a global mute, are dropped.

``mute_log(ts, seq, scope, muted)``, scope ``*`` or a chat id. A logged state holds from its own time until
the next entry of the same scope; no entry means not muted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertfold.functions.distance import slot_start
from alertfold.plans.ordered import HOT_ROWS, nearest

ALL_CHATS = "*"
MAX_BROADCAST_HOURS = 500_000
_HOUR = 3600


def mute_intervals(mute_log: DataFrame, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Times of silence: scope, since, till (exclusive; null while it lasts)."""
    # _at is the value the next entry offers to the one before it
    timed = mute_log.withColumn("_at", F.col("ts"))
    ended = nearest(timed, ["scope"], ["ts", "seq"], "_at", "till", after=True, hot_rows=hot_rows)
    silent = ended.filter(F.col("muted") & (F.col("till").isNull() | (F.col("till") > F.col("ts"))))
    return silent.select("scope", F.col("ts").alias("since"), "till")


def drop_muted(
    messages: DataFrame, mute_log: DataFrame, hot_rows: int | None = HOT_ROWS, max_hours: int = MAX_BROADCAST_HOURS
) -> DataFrame | None:
    """Drop muted messages with broadcast hash joins, so that messages do not move; works on streams too.

    Ended silences are cut by the hour and met on it; of those that last there is one per scope. Their
    number is taken from the log first: above ``max_hours`` a stream meets them in shuffled joins, and a table
    gets None, as there is a better way for it.
    """
    spans = mute_intervals(mute_log, hot_rows)
    # the end itself is no longer silent, so a silence may reach one hour too far, never too short
    spans = spans.withColumns({"_first": slot_start(spans, _HOUR, "since"), "_last": slot_start(spans, _HOUR, "till")})
    lasting, everyone = F.col("till").isNull(), F.col("scope") == ALL_CHATS
    known = spans.agg(
        F.sum(F.when(lasting, 1).otherwise((F.col("_last") - F.col("_first")) / _HOUR + 1)).alias("rows"),
        F.min(F.when(lasting & everyone, F.col("since"))).cast("string").alias("stopped"),
    ).first()
    few = (known.rows or 0) <= max_hours
    if not few and not messages.isStreaming:
        return None

    def side(rows: DataFrame) -> DataFrame:
        return F.broadcast(rows) if few else rows.hint("merge")

    chat = F.col("scope").try_cast("bigint").alias("_mute_chat")
    hours = spans.filter(~lasting).withColumn("_mute_hour", F.explode(F.sequence("_first", "_last", F.lit(_HOUR))))
    of_chats = hours.filter(~everyone).select(chat, "_mute_hour", "since", "till")
    of_all = hours.filter(everyone).select("_mute_hour", "since", "till")
    stopped_chats = spans.filter(lasting & ~everyone).select(chat, "since")

    same_chat = F.col("chat_id") == F.col("_mute_chat")
    begun = F.col("ts") >= F.col("since")
    within = (F.col("_hour") == F.col("_mute_hour")) & begun & (F.col("ts") < F.col("till"))
    timed = messages.withColumn("_hour", slot_start(messages, _HOUR))
    if known.stopped is not None:
        timed = timed.filter(F.col("ts") < F.lit(known.stopped).cast(messages.schema["ts"].dataType))
    return (
        timed.join(side(of_chats), same_chat & within, "left_anti")
        .join(side(of_all), within, "left_anti")
        .join(side(stopped_chats), same_chat & begun, "left_anti")
        .drop("_hour")
    )


def _state_at(messages: DataFrame, log: DataFrame, key: str, out: str, hot_rows: int | None) -> DataFrame:
    """Add the last logged state at or before each message, per key. One sorted pass, no range join."""
    names = messages.columns
    marked = messages.withColumn("_is_message", F.lit(1)).withColumn("_state", F.lit(None).cast("boolean"))
    entries = log.select(key, "ts", "seq", F.lit(0).alias("_is_message"), F.col("muted").alias("_state"))
    both = marked.unionByName(entries, allowMissingColumns=True)
    seen = nearest(both, [key], ["ts", "_is_message", "seq"], "_state", out, hot_rows=hot_rows)
    return seen.filter(F.col("_is_message") == 1).select(*names, out)


def _drop_by_state(messages: DataFrame, mute_log: DataFrame, hot_rows: int | None) -> DataFrame:
    """The way for logs of any size: messages and log sorted together.

    The global log has a single timeline, so it is cut by the hour: the state an hour starts with, and the
    changes within. Only the list of hours is handled in one place.
    """
    own = mute_log.filter(F.col("scope") != ALL_CHATS).withColumn("chat_id", F.col("scope").try_cast("bigint"))
    by_chat = _state_at(messages, own, "chat_id", "_muted", hot_rows)
    heard = by_chat.filter(~F.coalesce("_muted", F.lit(False))).drop("_muted")

    everyone = mute_log.filter(F.col("scope") == ALL_CHATS)
    everyone = everyone.withColumn("_hour", slot_start(everyone, _HOUR))
    hours = messages.select(slot_start(messages, _HOUR).alias("_hour")).distinct()
    ends = everyone.groupBy("_hour").agg(F.max_by("muted", F.struct("ts", "seq")).alias("_end"))
    starts = nearest(hours.join(ends, "_hour", "full"), [], ["_hour"], "_end", "_start", hot_rows=hot_rows)
    timed = heard.withColumn("_hour", slot_start(heard, _HOUR))
    seen = _state_at(timed, everyone, "_hour", "_within", hot_rows)
    state = F.coalesce("_within", "_start", F.lit(False))
    return seen.join(starts.drop("_end"), "_hour", "left").filter(~state).select(*messages.columns)


def apply_mutes(
    messages: DataFrame,
    mute_log: DataFrame,
    hot_rows: int | None = HOT_ROWS,
    max_hours: int = MAX_BROADCAST_HOURS,
) -> DataFrame:
    """Drop messages sent while their chat, or every chat, was muted."""
    heard = drop_muted(messages, mute_log, hot_rows, max_hours)
    return _drop_by_state(messages, mute_log, hot_rows) if heard is None else heard
