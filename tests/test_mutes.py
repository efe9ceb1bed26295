import random

import pytest

from alertfold.operators.mutes import apply_mutes, drop_muted, mute_intervals
from alertfold.sources.outbox import write_outbox
from alertfold.streaming.online import compact_stream
from alertfold.streaming.run import use_rocksdb


@pytest.fixture(scope="module")
def tables(spark, messages_of):
    rng = random.Random(11)
    messages = messages_of([(rng.randrange(5), rng.randrange(90_000), f"m{i}") for i in range(600)])
    log = [(rng.randrange(90_000), i, rng.choice(["*", "0", "1", "2"]), rng.random() < 0.5) for i in range(80)]
    log += [(100, 900, "3", True), (100, 901, "3", False), (200, 902, "4", False), (200, 903, "4", True)]
    raw = spark.createDataFrame(log, "second long, seq long, scope string, muted boolean")
    mute_log = raw.selectExpr(
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, second) AS ts", "seq", "scope", "muted"
    )
    return messages.cache(), mute_log.cache()


def heard(messages, log):
    def state(ts, scope):
        seen = [r for r in log if r.scope == scope and r.ts <= ts]
        return max(seen, key=lambda r: (r.ts, r.seq)).muted if seen else False

    return {m.seq for m in messages if not state(m.ts, str(m.chat_id)) and not state(m.ts, "*")}


@pytest.mark.parametrize("limit", [500_000, 0])
@pytest.mark.parametrize("hot_rows", [None, 30])
def test_both_ways_drop_what_was_muted(tables, limit, hot_rows):
    messages, log = tables
    want = heard(messages.collect(), log.collect())
    got = apply_mutes(messages, log, hot_rows, max_hours=limit)
    assert {r.seq for r in got.collect()} == want
    assert got.columns == messages.columns


def test_empty_log_mutes_nothing(tables):
    messages, log = tables
    assert apply_mutes(messages, log.limit(0)).count() == messages.count()
    assert apply_mutes(messages.limit(0), log).count() == 0


def test_intervals(tables):
    _, log = tables
    spans = mute_intervals(log.filter("scope = '4'")).collect()
    assert len(spans) == 1 and spans[0].till is None


def test_streams_drop_what_was_muted(spark, tables, tmp_path):
    messages, log = tables
    use_rocksdb(spark)
    messages.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(messages.schema).parquet(str(tmp_path / "in"))
    rows = compact_stream(stream, mute_log=log)
    write_outbox(rows, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    sent = spark.read.parquet(str(tmp_path / "out")).filter("action = 'SEND'")
    assert {r.seq for r in sent.collect()} == heard(messages.collect(), log.collect())


@pytest.mark.parametrize("limit", [500_000, 0])
def test_streams_take_logs_of_any_length(spark, tables, tmp_path, limit):
    messages, log = tables
    messages.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(messages.schema).parquet(str(tmp_path / "in"))
    rows = drop_muted(stream, log, max_hours=limit)
    write_outbox(rows, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    left = spark.read.parquet(str(tmp_path / "out"))
    assert {r.seq for r in left.collect()} == heard(messages.collect(), log.collect())
