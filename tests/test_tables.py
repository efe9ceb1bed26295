import re

import pytest
from pyspark.sql import functions as F

from alertfold.operators import changelog
from alertfold.sources.tables import bucket_of, clear_versions, current, read_table, update_table, write_table


@pytest.fixture
def actions(spark, tmp_path):
    rows = spark.range(1000).selectExpr("id AS actionid", "concat('a', id) AS name", "0 AS status")
    write_table(rows, str(tmp_path / "t"), "actionid", buckets=8)
    return str(tmp_path / "t")


def log_of(spark, *entries):
    rows = [(n, n, actionid, status) for n, (actionid, status) in enumerate(entries)]
    return spark.createDataFrame(rows, "ts long, seq long, actionid long, status int")


def files(path):
    place = current(path).places
    return {b: place[b] for b in place}


def test_only_touched_buckets_are_rewritten(spark, actions):
    before, first = files(actions), read_table(spark, actions)
    assert len(before) == 8
    assert update_table(spark, actions, log_of(spark, (3, 1), (3, 0), (3, 1), (10**9, 1)), changelog.apply_action_log) <= 2
    after = files(actions)
    changed = [b for b in before if before[b] != after[b]]
    mine = spark.range(1).select(bucket_of(F.lit(3).cast("long"), 8)).first()[0]
    assert str(mine) in changed and len(changed) <= 2
    rows = read_table(spark, actions)
    assert rows.count() == 1000 and [r.actionid for r in rows.filter("status = 1").collect()] == [3]
    assert first.filter("status = 1").count() == 0  # an older version is still there
    assert update_table(spark, actions, log_of(spark), changelog.apply_action_log) == 0
    clear_versions(actions)
    assert read_table(spark, actions).filter("status = 1").count() == 1 and read_table(spark, actions).count() == 1000
    with pytest.raises(Exception):
        first.count()


def test_updates_of_others_are_not_overwritten(spark, actions):
    def meanwhile(base, log):
        update_table(spark, actions, log_of(spark, (5, 1)), changelog.apply_action_log)
        return changelog.apply_action_log(base, log)

    with pytest.raises(RuntimeError, match="somebody else"):
        update_table(spark, actions, log_of(spark, (6, 1)), meanwhile)
    assert [r.actionid for r in read_table(spark, actions).filter("status = 1").collect()] == [5]
    with pytest.raises(ValueError):
        write_table(spark.range(1), actions, "id")
    with pytest.raises(ValueError):
        read_table(spark, actions + "-none")


def test_buckets_may_empty_and_fill(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = (
        "maintenanceid long, name string, active_since timestamp_ntz, active_till timestamp_ntz,"
        " groupids array<long>, timeperiods array<struct<timeperiod_type:int,period:int,start_date:timestamp_ntz>>"
    )
    write_table(spark.createDataFrame([], schema), path, "maintenanceid", buckets=4)
    assert read_table(spark, path).count() == 0

    def change(*ops):
        rows = [(n, op, i) for n, (op, i) in enumerate(ops)]
        log = spark.createDataFrame(rows, "seq long, op string, maintenanceid long").selectExpr(
            "timestamp_ntz'2024-01-01 00:00:00' AS ts", "seq", "op", "maintenanceid", "concat('m', maintenanceid) AS name", "7L AS groupid"
        )
        update_table(spark, path, log, changelog.apply_maintenance_log)
        return sorted(r.maintenanceid for r in read_table(spark, path).collect())

    assert change(*[("create", i) for i in range(20)], ("renew", 99)) == list(range(20))
    assert change(*[("delete", i) for i in range(20)]) == []
    assert change(("create", 5), ("renew", 5), ("delete", 6)) == [5]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_small_log_does_not_move_its_table(spark, actions):
    base, log = read_table(spark, actions), log_of(spark, (3, 1))
    changed = changelog.apply_action_log(base, log)
    text = plan(changed)
    # below the join, the side of the table is its scan
    side = text[text.index("BroadcastHashJoin") :]
    assert re.search(r"BroadcastHashJoin.*LeftOuter, BuildRight.*\n(?:.*(?:Project|Filter|ColumnarToRow).*\n)*.*FileScan parquet", side)
    assert "SortMergeJoin" not in text and text.count("Exchange hashpartitioning(actionid") == 1  # the log's own
    shuffled = changelog.apply_action_log(base, log, max_rows=0)
    assert sorted(map(str, changed.collect())) == sorted(map(str, shuffled.collect()))


def test_both_ways_of_a_maintenance_log(spark):
    base = spark.range(50).selectExpr(
        "id AS maintenanceid", "concat('m', id) AS name", "timestamp_ntz'2024-01-01' AS active_since",
        "timestamp_ntz'2024-01-02' AS active_till", "array(id) AS groupids",
        "cast(array() AS array<struct<timeperiod_type:int,period:int,start_date:timestamp_ntz>>) AS timeperiods",
    )
    log = spark.range(300).selectExpr(
        "timestampadd(HOUR, cast(id AS int), timestamp_ntz'2024-02-01') AS ts", "id AS seq",
        "element_at(array('create', 'renew', 'delete'), cast(id * 7 % 3 AS int) + 1) AS op", "id * 31 % 90 AS maintenanceid",
        "concat('n', id) AS name", "id AS groupid",
    )
    ways = [changelog.apply_maintenance_log(base, log, rows) for rows in (0, 200_000)]
    first, second = (sorted(map(str, w.collect())) for w in ways)
    assert first == second and len(first) > 10
    assert ways[0].columns == ways[1].columns
