"""State changes applied to tables: every log is reduced to one row per id before it meets the table.

A small log is broadcast, so that the table is not moved; :mod:`alertfold.sources.tables` keeps tables of which only
the touched part is read and rewritten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW_SECONDS = 86_400  # a maintenance lasts a day from its creation or renewal
PERIOD_SECONDS = 3_600  # with one period of an hour
ONE_TIME_PERIOD = 0
ACKNOWLEDGE, MESSAGE = 2, 4  # bits of an event action
MAX_BROADCAST_ROWS = 200_000
_DATES = ("active_since", "active_till", "timeperiods")


def _is_small(log: DataFrame, max_rows: int) -> bool:
    """Whether what a log comes to may be broadcast: its rows are counted, as far as it matters."""
    return log.limit(max_rows + 1).count() <= max_rows


def _met(base: DataFrame, changes: DataFrame, key: str, small: bool) -> DataFrame:
    """Every row of the table with the change of its key, if any. Few changes go to the table, which stays."""
    return base.join(F.broadcast(changes) if small else changes, key, "left")


def apply_maintenance_log(base: DataFrame, log: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Maintenances after a log of creates, renewals and deletes.

    ``base(maintenanceid, name, active_since, active_till, groupids, timeperiods)``,
    ``log(ts, seq, op, maintenanceid, name, groupid)`` with op create, renew or delete. A renewal only
    counts while the maintenance exists: not after a delete. A log of up to ``max_rows`` rows, here and below,
    is sent to the table, which then does not move.
    """
    at = F.struct("ts", "seq")
    is_life = F.col("op").isin("create", "delete")
    life = F.max(F.when(is_life, F.struct("ts", "seq", "op", "name", "groupid"))).alias("life")
    renewed = F.max(F.when(F.col("op") == "renew", at)).alias("renewed")
    changes = log.groupBy("maintenanceid").agg(life, renewed)
    created = F.coalesce(F.col("life.op") == "create", F.lit(False))

    def dated(rows: DataFrame, renewal: Column, begun: Column, name: Column, groups: Column) -> DataFrame:
        start = F.when(renewal, F.col("renewed.ts")).otherwise(begun)
        period = F.struct(
            F.lit(ONE_TIME_PERIOD).alias("timeperiod_type"),
            F.lit(PERIOD_SECONDS).alias("period"),
            start.alias("start_date"),
        )
        return rows.select(
            "maintenanceid",
            name.alias("name"),
            F.coalesce(start, "active_since").alias("active_since"),
            F.coalesce(start + F.make_dt_interval(secs=F.lit(WINDOW_SECONDS)), "active_till").alias("active_till"),
            groups.alias("groupids"),
            F.when(start.isNotNull(), F.array(period)).otherwise(F.col("timeperiods")).alias("timeperiods"),
        )

    # what is created anew owes nothing to the table, and what the table has stays unless the log ends its life
    kept = _met(base, changes, "maintenanceid", _is_small(log, max_rows)).filter(F.col("life").isNull())
    old = dated(kept, F.col("renewed").isNotNull(), F.lit(None).cast(log.schema["ts"].dataType), F.col("name"), F.col("groupids"))
    blank = {f.name: F.lit(None).cast(f.dataType) for f in base.schema if f.name in _DATES}
    fresh = changes.filter(created).withColumns(blank)
    later = F.col("renewed") > F.struct(F.col("life.ts").alias("ts"), F.col("life.seq").alias("seq"))
    new = dated(fresh, F.coalesce(later, F.lit(False)), F.col("life.ts"), F.col("life.name"), F.array("life.groupid"))
    return old.unionAll(new)


def apply_ack_log(events: DataFrame, acks: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Events with acknowledgements applied. ``acks(eventid, mask)``; bit 2 acknowledges."""
    masks = acks.groupBy("eventid").agg(F.bit_or("mask").alias("_mask"))
    marked = F.coalesce(F.col("_mask").bitwiseAND(ACKNOWLEDGE) != 0, F.lit(False))
    joined = _met(events, masks, "eventid", _is_small(acks, max_rows))
    return joined.withColumn("acknowledged", F.col("acknowledged") | marked).drop("_mask")


def apply_action_log(actions: DataFrame, log: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Actions with the last logged status of each. ``log(ts, seq, actionid, status)``."""
    last = log.groupBy("actionid").agg(F.max_by("status", F.struct("ts", "seq")).alias("_status"))
    joined = _met(actions, last, "actionid", _is_small(log, max_rows))
    return joined.withColumn("status", F.coalesce("_status", "status")).drop("_status")
