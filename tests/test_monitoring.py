from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from alertfold.operators import changelog, commands, monitoring
from alertfold.operators.history import match_templates, merged_counts, recent_history
from alertfold.operators.paging import chunk, paginate
from alertfold.operators.replies import pair_replies

NOW = datetime(2024, 1, 10)


def test_maintenance_is_ended_at_its_very_start(spark):
    rows = [
        (1, "b", NOW, NOW + timedelta(1)),
        (2, "a", NOW - timedelta(1), NOW + timedelta(1)),
        (3, "c", NOW + timedelta(1), NOW + timedelta(2)),
        (4, "d", NOW - timedelta(2), NOW),
    ]
    df = spark.createDataFrame(
        rows, "maintenanceid long, name string, active_since timestamp_ntz, active_till timestamp_ntz"
    )
    listed = [tuple(r) for r in monitoring.maintenance_status(df, NOW).collect()]
    assert listed == [(2, "🛠 a"), (1, "❌ b"), (3, "⏰ c"), (4, "❌ d")]
    assert [r[0] for r in monitoring.maintenance_status(df, NOW, limit=2).collect()] == [2, 1]


@pytest.fixture(scope="module")
def monitored(spark):
    triggers = spark.createDataFrame(
        [
            (1, 10, "full", 5, True),
            (2, 10, "low severity", 4, True),
            (3, 20, "unwatched", 5, False),
            (4, 20, "acknowledged", 5, True),
            (5, 30, "old", 5, True),
            (6, 30, "solved", 5, True),
            (7, 10, "at the limit", 5, True),
        ],
        "triggerid long, groupid long, description string, severity int, monitored boolean",
    )
    day = lambda n: NOW - timedelta(n)
    events = spark.createDataFrame(
        [
            (100, 1, day(3), 0, False), (101, 1, day(2), 1, False), (102, 2, day(2), 1, False),
            (103, 3, day(2), 1, False), (104, 4, day(2), 1, True), (105, 5, day(15), 1, False),
            (106, 6, day(3), 1, False), (107, 6, day(3), 0, False), (108, 7, day(14), 1, False),
        ],
        "eventid long, objectid long, clock timestamp_ntz, value int, acknowledged boolean",
    )
    return triggers, events


def test_open_problems(monitored):
    triggers, events = monitored
    problems = monitoring.open_problems(triggers, events, NOW)
    assert {r.triggerid for r in problems.collect()} == {1, 7}
    assert monitoring.open_problems(triggers, events, NOW, group=20).count() == 0
    newest = {r.objectid: r.eventid for r in monitoring.latest_event(events).collect()}
    assert newest[1] == 101 and newest[6] == 107  # the larger id wins a tie


def test_acknowledging_closes_a_problem(spark, monitored):
    triggers, events = monitored
    acks = spark.createDataFrame([(101, 4), (101, 2), (108, 4)], "eventid long, mask int")
    after = changelog.apply_ack_log(events, acks)
    assert {r.triggerid for r in monitoring.open_problems(triggers, after, NOW).collect()} == {7}


def test_groups_with_problems(spark, monitored):
    groups = spark.createDataFrame(
        [(10, "z", True), (20, "y", True), (30, "x", False)], "groupid long, name string, monitored_hosts boolean"
    )
    problems = monitoring.open_problems(*monitored, NOW)
    assert [r.name for r in monitoring.groups_with_problems(groups, problems).collect()] == ["z"]
    assert [r.name for r in monitoring.host_groups(groups).collect()] == ["y", "z"]


def test_maintenance_log(spark):
    period = "array<struct<timeperiod_type:int,period:int,start_date:timestamp_ntz>>"
    base = spark.createDataFrame(
        [(i, f"m{i}", NOW, NOW + timedelta(1), [i], []) for i in (1, 2, 3, 4)],
        "maintenanceid long, name string, active_since timestamp_ntz, active_till timestamp_ntz,"
        f" groupids array<long>, timeperiods {period}",
    )
    at = lambda h: NOW + timedelta(hours=h)
    log = spark.createDataFrame(
        [
            (at(1), 1, "renew", 2, None, None), (at(2), 2, "renew", 2, None, None),
            (at(1), 3, "renew", 3, None, None), (at(2), 4, "delete", 3, None, None),
            (at(1), 5, "delete", 4, None, None), (at(2), 6, "renew", 4, None, None),
            (at(3), 7, "create", 9, "new", 77), (at(4), 8, "renew", 8, None, None),
        ],
        "ts timestamp_ntz, seq long, op string, maintenanceid long, name string, groupid long",
    )
    rows = {r.maintenanceid: r for r in changelog.apply_maintenance_log(base, log).collect()}
    assert set(rows) == {1, 2, 9}  # neither a renewal after a delete nor one of an unknown id counts
    assert rows[1].active_since == NOW and rows[1].timeperiods == []
    assert (rows[2].active_since, rows[2].active_till) == (at(2), at(26))
    assert rows[2].timeperiods[0] == (0, 3600, at(2)) and rows[2].groupids == [2]
    assert (rows[9].name, rows[9].groupids, rows[9].active_till) == ("new", [77], at(27))


def test_commands(spark):
    data = [
        "main", "main x", "action.enable", "action.enable 5", "action.enable.page 2", "action.enable.page",
        "problems.select.page 3", "problems.select.page 3 1", "screen.select.refresh 5 1 2", "", "button.empty",
        "maintenance.create.select.grp 4", "action.stopall now",
    ]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(data)], "seq long, data string")
    parsed = {r.data: r for r in commands.parse_commands(df).collect()}
    assert {d for d in data if parsed[d].known} == {
        "main", "action.enable", "action.enable 5", "action.enable.page 2", "problems.select.page 3 1",
        "screen.select.refresh 5 1 2", "maintenance.create.select.grp 4",
    }
    assert parsed["screen.select.refresh 5 1 2"].args == ["5", "1", "2"]


def test_empty_names_are_no_administrators(spark):
    presses = spark.createDataFrame([("", 1), ("ann", 2), ("bob", 3)], "username string, seq long")
    admins = spark.createDataFrame([("",), ("ann",)], "username string")
    assert [r.seq for r in commands.authorize(presses, admins).collect()] == [2]
    assert {r.seq for r in commands.refused(presses, admins).collect()} == {1, 3}
    assert [tuple(r) for r in commands.user_list(admins).collect()] == [(1, "ann")]


def test_start_command(spark):
    texts = ["/start", "/start@fold", "/start@other", "/start now", "start"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    found = df.filter(commands.is_start_command(F.col("text"), "fold")).collect()
    assert [r.text for r in found] == ["/start", "/start@fold"]


def test_fan_out_takes_any_number_of_chats(spark):
    audit = spark.createDataFrame([(1, "t"), (2, "u")], "seq long, audit_text string")
    chats = spark.createDataFrame([(-100500900800700,), (2,), (2,)], "chat_id long")
    rows = commands.fan_out(audit, chats).collect()
    assert {(r.notify_chat_id, r.seq, r.audit_text) for r in rows} == {
        (c, *t) for c in (-100500900800700, 2) for t in ((1, "t"), (2, "u"))
    }
    assert len(rows) == 4
    assert commands.fan_out(audit, chats.limit(0)).count() == 0
    many = spark.range(20_000).withColumnRenamed("id", "chat_id")
    assert commands.fan_out(audit, many).count() == 40_000


def test_one_reply_answers_all_waiting_prompts(spark):
    prompts = spark.createDataFrame(
        [(1, "a", 1, "p1"), (1, "a", 2, "p2"), (1, "a", 9, "p3"), (1, "b", 1, "p4"), (2, "a", 4, "p5")],
        "chat_id long, username string, seq long, text string",
    )
    replies = spark.createDataFrame(
        [(1, "a", 3, "r1"), (1, "a", 4, "r2"), (2, "a", 4, "same place"), (2, "a", 5, "r3")],
        "chat_id long, username string, seq long, text string",
    )
    for hot_rows in (None, 2):
        found = {r.text: r.reply_text for r in pair_replies(prompts, replies, hot_rows=hot_rows).collect()}
        assert found == {"p1": "r1", "p2": "r1", "p3": None, "p4": None, "p5": "r3"}


def test_history_age_counts_whole_minutes(messages_of):
    rows = messages_of([(1, 0, "61:00"), (1, 1, "60:59"), (1, 3660, "now"), (2, 3000, "elsewhere")])
    seen = recent_history(rows).filter("text = 'now'").collect()
    assert [(r.hist_seq, r.age_minutes, r.hist_rank) for r in seen] == [(1, 60, 1)]


def test_history_is_counted_newest_first(messages_of):
    rows = messages_of([(1, i, f"m{i}") for i in range(30)])
    for hot_rows in (None, 5):
        seen = recent_history(rows, check_count=3, hot_rows=hot_rows).filter("seq = 20").collect()
        assert sorted((r.hist_rank, r.hist_seq) for r in seen) == [(1, 19), (2, 18), (3, 17)]


def test_merged_counts_add_the_message(spark, messages_of):
    rows = messages_of([(1, 0, "g"), (1, 1, "g"), (1, 2, "disk 95 full")])
    pattern = F.when(F.col("seq") == 0, "disk ?? full").when(F.col("seq") == 1, "disk ? full")
    entries = rows.withColumn("pattern", pattern).withColumn("cnt", F.col("seq") + 2)
    matched = match_templates(entries).filter("seq = 2")
    assert matched.count() == 2
    assert [r.cnt for r in merged_counts(matched).collect()] == [6]


def test_pages_and_chunks(spark):
    df = spark.range(12).selectExpr("id", "id % 2 AS list")
    for hot_rows in (None, 3):
        pages = paginate(df, [], ["id"], hot_rows=hot_rows).collect()
        assert sorted((r.id, r.page, r.pages) for r in pages) == [(i, i // 5, 3) for i in range(12)]
        per_list = paginate(df, ["list"], ["id"], hot_rows=hot_rows).collect()
        assert {(r.id, r.page, r.pages) for r in per_list} == {(i, i // 2 // 5, 2) for i in range(12)}
        chunks = chunk(df, ["list"], ["id"], "id", 4, hot_rows=hot_rows).collect()
        assert sorted((r.list, r.chunk, r["items"]) for r in chunks) == [
            (0, 0, [0, 2, 4, 6]), (0, 1, [8, 10]), (1, 0, [1, 3, 5, 7]), (1, 1, [9, 11]),
        ]
