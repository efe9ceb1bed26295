"""Lists over maintenances, actions, problems, host groups and screens."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Prefixes users see in the maintenance list.
ACTIVE, PLANNED, ENDED = "🛠 ", "⏰ ", "❌ "

ENABLED, DISABLED = 0, 1
_GRAPH = 0  # resource type of a graph on a screen


def _listed(df: DataFrame, limit: int | None) -> DataFrame:
    return df if limit is None else df.limit(limit)


def _moment(now: datetime) -> Column:
    return F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz")


def maintenance_status(maintenances: DataFrame, now: datetime, limit: int | None = None) -> DataFrame:
    """All maintenances by name, labelled active, planned or ended: maintenanceid, label."""
    at = _moment(now)
    state = (
        F.when((F.col("active_since") < at) & (at < F.col("active_till")), ACTIVE)
        .when(at < F.col("active_since"), PLANNED)
        .otherwise(ENDED)
    )
    ordered = maintenances.select("maintenanceid", "name", F.concat(state, "name").alias("label"))
    return _listed(ordered.orderBy("name", "maintenanceid"), limit).select("maintenanceid", "label")


def list_actions(actions: DataFrame, status: int = ENABLED, limit: int | None = None) -> DataFrame:
    """Actions of one status by name."""
    chosen = actions.filter(F.col("status") == status).select("actionid", "name")
    return _listed(chosen.orderBy("name", "actionid"), limit)


def list_screens(screens: DataFrame, limit: int | None = None) -> DataFrame:
    """Screens by name."""
    return _listed(screens.select("screenid", "name").orderBy("name", "screenid"), limit)


def latest_event(events: DataFrame) -> DataFrame:
    """Newest event per object; the larger id wins a tie. Combines before the shuffle."""
    newest = F.max(F.struct("clock", "eventid", "value", "acknowledged")).alias("e")
    last = events.groupBy("objectid").agg(newest)
    return last.select("objectid", "e.eventid", "e.clock", "e.value", "e.acknowledged")


def open_problems(
    triggers: DataFrame,
    events: DataFrame,
    now: datetime,
    group: int | None = None,
    min_severity: int = 5,
    within_seconds: int = 1_209_600,
    limit: int | None = None,
) -> DataFrame:
    """Monitored triggers of high severity whose last event is a recent, unacknowledged problem."""
    since = _moment(now) - F.make_dt_interval(secs=F.lit(within_seconds))
    watched = triggers.filter(F.col("monitored") & (F.col("severity") >= min_severity))
    if group is not None:
        watched = watched.filter(F.col("groupid") == group)
    # an object whose newest event is older has no event in the window, so older events needn't be read
    last = latest_event(events.filter(F.col("clock") >= since)).filter((F.col("value") == 1) & ~F.col("acknowledged"))
    found = watched.join(last, F.col("triggerid") == F.col("objectid"))
    return _listed(found.select("triggerid", "groupid", "description"), limit)


def host_groups(groups: DataFrame, limit: int | None = None) -> DataFrame:
    """Groups with monitored hosts by name."""
    chosen = groups.filter("monitored_hosts").select("groupid", "name")
    return _listed(chosen.orderBy("name", "groupid"), limit)


def groups_with_problems(groups: DataFrame, problems: DataFrame, limit: int | None = None) -> DataFrame:
    """Monitored groups that have open problems. The problems shrink to their groups before the join."""
    affected = problems.select("groupid").distinct()
    return host_groups(groups.join(affected, "groupid", "left_semi"), limit)


def screen_graphs(screens: DataFrame, items: DataFrame, screenid: int | None = None) -> DataFrame:
    """Graphs on screens: screenid, resourceid."""
    graphs = items.filter(F.col("resourcetype") == _GRAPH).select("screenid", "resourceid")
    known = screens.select("screenid")
    if screenid is not None:
        graphs, known = (side.filter(F.col("screenid") == screenid) for side in (graphs, known))
    return graphs.join(known, "screenid", "left_semi")


def with_names(df: DataFrame, names: DataFrame, key: str, name: str = "name") -> DataFrame:
    """Add the name that belongs to ``key``; null where there is none.

    ``names`` has one row per key. No hint: its size decides whether it is broadcast, and AQE splits hot
    keys when it is not.
    """
    return df.join(names.select(key, name), key, "left")
