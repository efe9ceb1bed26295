import random
import time

import pytest
from pyspark.sql import functions as F

from alertfold.operators.mutes import apply_mutes
from alertfold.options import Options
from alertfold.sources.outbox import write_outbox
from alertfold.sources.spool import stream_spool
from alertfold.streaming.history import BEGIN, History
from alertfold.streaming.mutes import forget, hear, muted_at
from alertfold.streaming.online import OUTBOX, compact_backlog, compact_stream
from alertfold.streaming.replies import pair_replies_stream
from alertfold.streaming.rules import Entry, decide, recent
from alertfold.streaming.run import use_rocksdb
from alertfold.streaming.sender import send_batches, with_arrival_order

OPTS = Options()


def single(i, text, minute=0):
    return Entry(i, text, minute * 60_000_000)


def group(i, pattern, cnt, minute=0):
    return Entry(i, f"{pattern}\n\nSimilar messages received: {cnt}", minute * 60_000_000, pattern, cnt)


def test_a_known_template_takes_the_message_and_its_equals():
    seen = [group(3, "disk ?? full", 4), group(2, "disk ?? full", 2), group(1, "load ?", 9), single(0, "disk 1 full")]
    chosen = decide("disk 95 full", seen, OPTS)
    assert (chosen.pattern, chosen.cnt, chosen.replaces) == ("disk ?? full", 7, [3, 2])


def test_a_near_template_is_widened():
    chosen = decide("disk 95 fuzz", [group(1, "load ?", 2), group(0, "disk ?? full", 2)], OPTS)
    assert (chosen.pattern, chosen.cnt, chosen.replaces) == ("disk ?? fu??", 3, [0])


def test_widening_includes_the_threshold():
    assert decide("abcxy", [group(0, "abcde", 2)], OPTS).pattern == "abc??"
    assert decide("abxyz", [group(0, "abcde", 2)], OPTS).pattern is None


def test_recent_singles_form_a_group():
    chosen = decide("disk 7 full", [single(2, "disk 95 full"), single(1, "other"), single(0, "disk 91 full")], OPTS)
    assert (chosen.pattern, chosen.cnt, sorted(chosen.replaces)) == ("disk ?? full", 3, [0, 2])


def test_anything_else_goes_alone():
    chosen = decide("hello", [single(0, "disk 95 full")], OPTS)
    assert (chosen.pattern, chosen.replaces, chosen.text) == (None, [], "hello")
    assert decide("", [single(0, "")], OPTS).pattern is None


def test_history_is_limited_by_count_and_age():
    history = [single(i, "x", minute) for i, minute in enumerate([0, 1, 2, 3])]
    micros = 61 * 60_000_000 + 59_000_000  # the oldest is 61 whole minutes old, the next 60
    assert [e.message_id for e in recent(history, micros, OPTS)] == [3, 2, 1]
    assert [e.message_id for e in recent(history, micros, Options(history_check_count=2))] == [3, 2]


def by_hand(rows):
    """The same decisions, one after the other."""
    out, histories, last = [], {}, {}
    for chat, micros, seq, text in sorted(rows, key=lambda r: (r[1], r[2])):
        history = histories.setdefault(chat, [])
        chosen = decide(text, recent(history, micros, OPTS), OPTS)
        last[chat] = last.get(chat, 0) + 1
        shown = text if chosen.pattern is None else f"{chosen.pattern}\n\nSimilar messages received: {chosen.cnt}"
        out += [(chat, seq, "DELETE", i, None, None) for i in chosen.replaces]
        out.append((chat, seq, "SEND", last[chat], shown, chosen.cnt))
        histories[chat] = [e for e in history if e.message_id not in chosen.replaces] + [
            Entry(last[chat], shown, micros, chosen.pattern, chosen.cnt)
        ]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory, messages_of):
    """Messages in three files, each later than the one before."""
    rng = random.Random(5)
    texts = ["disk {} full", "load {} on host", "user {} left", "été {}"]
    rows = [(rng.randrange(4), rng.randrange(9000), rng.choice(texts).format(rng.randrange(200))) for _ in range(150)]
    rows.sort(key=lambda r: r[1])
    messages = messages_of(rows)
    folder = tmp_path_factory.mktemp("stream")
    cuts = [messages.filter(F.col("seq").between(lo, lo + 49)).coalesce(1) for lo in (0, 50, 100)]
    micros = messages.select("chat_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("m"), "seq", "text")
    return folder, cuts, by_hand([tuple(r) for r in micros.collect()])


def test_online_compaction_over_batches_and_restarts(spark, parts, tmp_path):
    folder, cuts, want = parts
    use_rocksdb(spark)
    schema = cuts[0].schema
    outbox, checkpoint = str(tmp_path / "outbox"), str(tmp_path / "checkpoint")
    for cut in cuts:  # each start continues from the checkpoint
        cut.write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
        write_outbox(compact_stream(stream), outbox, checkpoint).awaitTermination()
    write_outbox(compact_stream(stream), outbox, checkpoint).awaitTermination()
    rows = spark.read.parquet(outbox).select("chat_id", "seq", "action", "message_id", "text", "cnt").collect()
    assert sorted((tuple(r) for r in rows), key=repr) == want


def test_tables_are_refused(parts):
    with pytest.raises(ValueError):
        compact_stream(parts[1][0])


def test_replies_over_batches(spark, tmp_path):
    use_rocksdb(spark)
    schema = "chat_id long, username string, seq long, is_prompt boolean, text string"
    source, outbox, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    batches = [
        [(1, "a", 1, True, "p1"), (1, "a", 2, True, "p2"), (1, "b", 2, True, "p3")],
        [(1, "a", 3, False, "r1"), (1, "a", 4, False, "r2"), (2, "b", 3, False, "r3")],
        [(1, "a", 5, True, "p4"), (1, "a", 6, False, "r4")],
    ]
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        stream = pair_replies_stream(spark.readStream.schema(schema).parquet(source))
        write_outbox(stream, outbox, checkpoint).awaitTermination()
    found = {(r.text, r.reply_text, r.reply_seq) for r in spark.read.parquet(outbox).collect()}
    assert found == {("p1", "r1", 3), ("p2", "r1", 3), ("p4", "r4", 6)}


def test_sender_from_spool_to_outbox(spark, tmp_path):
    spool, outbox, checkpoint = (str(tmp_path / n) for n in ("pending", "out", "checkpoint"))

    def drop(chat, name, text):
        folder = tmp_path / "pending" / chat
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(text)

    def tick(mute_log=None):
        stream = with_arrival_order(stream_spool(spark, spool))
        send_batches(stream, outbox, checkpoint, Options(min_approx=2), mute_log).awaitTermination()

    for i, load in enumerate((91, 95, 7)):
        drop("5", f"{i:016X}", f"disk {load} full")
    drop("-6", "A" * 16, "alone")
    tick()
    drop("5", "B" * 16, "disk 1 full")
    drop("-6", "C" * 16, "muted")
    log = "SELECT timestamp_ntz'2000-01-01 00:00:00' AS ts, 1L AS seq, '-6' AS scope, true AS muted"
    tick(lambda: spark.sql(log))
    sent = {(r.tick, r.chat_id, r.cnt) for r in spark.read.parquet(outbox).collect()}
    assert sent == {(0, 5, 3), (0, -6, 1), (1, 5, 1)}
    (group,) = [r for r in spark.read.parquet(outbox).collect() if r.is_group]
    assert group.text == "3 similar messages were received:\ndisk ?? full" and group.action == "SEND"


def test_late_messages_are_sent_and_hide_no_history(spark, messages_of, tmp_path):
    """The second file is five hours and 59 minutes late; the third finds the group of the first again."""
    day = 10 * 3600
    for number, rows in enumerate((
        [(1, day, "disk 1 full"), (1, day + 1, "disk 2 full")],
        [(1, day - 5 * 3600, "very late"), (1, day - 59 * 60, "rather late")],
        [(1, day + 120, "disk 3 full")],
    )):
        messages_of(rows).withColumn("seq", F.col("seq") + 10 * number).coalesce(1).write.parquet(f"{tmp_path}/in/{number}")
    schema = spark.read.parquet(f"{tmp_path}/in/0").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    use_rocksdb(spark)
    write_outbox(compact_stream(stream, OPTS), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    sent = spark.read.parquet(f"{tmp_path}/out").filter("action = 'SEND'").orderBy("seq").collect()
    assert [r.seq for r in sent] == [0, 1, 10, 11, 20]
    assert sent[-1].cnt == 3 and {r.text for r in sent} >= {"very late", "rather late"}


def test_prompts_wait_for_their_time_only(spark, tmp_path):
    use_rocksdb(spark)
    schema = "chat_id long, username string, seq long, is_prompt boolean, text string"
    source, outbox, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))

    def run(*rows):
        spark.createDataFrame([(1, "u", *row) for row in rows], schema).coalesce(1).write.mode("append").parquet(source)
        stream = pair_replies_stream(spark.readStream.schema(schema).parquet(source), wait_seconds=5)
        write_outbox(stream, outbox, checkpoint, idle_runs=False).awaitTermination()
        return sorted((r.seq, r.reply_seq) for r in spark.read.parquet(outbox).collect())

    assert run((1, True, "a?"), (2, False, "yes")) == [(1, 2)]
    run((3, True, "b?"))
    time.sleep(5.5)
    assert run((4, True, "c?"), (5, False, "yes")) == [(1, 2), (4, 5)]


# live mutes


class MutedRuns:
    """Messages and mute commands in files, one run at a time."""

    def __init__(self, spark, messages_of, folder, **options):
        self.spark, self.messages_of, self.folder, self.options, self.seq = spark, messages_of, folder, options, 0
        use_rocksdb(spark)
        self.log_schema = "second long, seq long, scope string, muted boolean"
        self.empty = messages_of([(0, 0, "")]).schema

    def _add(self, name, frame):
        frame.coalesce(1).write.mode("append").parquet(f"{self.folder}/{name}")

    def run(self, messages=(), log=()):
        (self.folder / "messages").mkdir(exist_ok=True)
        (self.folder / "log").mkdir(exist_ok=True)
        if messages:
            self._add("messages", self.messages_of(messages).withColumn("seq", F.col("seq") + self.seq))
            self.seq += len(messages)
        if log:
            rows = [(second, 1000 * self.seq + n, scope, muted) for n, (second, scope, muted) in enumerate(log)]
            self._add("log", self.spark.createDataFrame(rows, self.log_schema))
        at = "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, second) AS ts"
        stream = self.spark.readStream.schema(self.empty).parquet(f"{self.folder}/messages")
        changes = self.spark.readStream.schema(self.log_schema).parquet(f"{self.folder}/log")
        heard = hear(stream, changes.selectExpr(at, "seq", "scope", "muted"), **self.options)
        write_outbox(heard, f"{self.folder}/out", f"{self.folder}/cp").awaitTermination()
        out = self.spark.read.schema(self.empty).parquet(f"{self.folder}/out")
        return sorted(r.text for r in out.collect())


def test_a_mute_acts_from_the_run_that_brings_it(spark, messages_of, tmp_path):
    runs = MutedRuns(spark, messages_of, tmp_path)
    assert runs.run([(1, 0, "a"), (2, 0, "b")]) == ["a", "b"]
    # the first is earlier than the mute, the second behind it; chat 2 is not meant
    assert runs.run([(1, 9, "c"), (1, 10, "gone"), (2, 11, "d")], [(10, "1", True)]) == ["a", "b", "c", "d"]
    assert runs.run([(1, 20, "gone"), (1, 5, "late but before")]) == ["a", "b", "c", "d", "late but before"]
    assert "e" in runs.run([(1, 30, "e")], [(30, "1", False)])
    got = runs.run([(n, 41, f"x{n}") for n in range(40)], [(40, "*", True)])
    assert not [t for t in got if t.startswith("x")]
    # chats nobody has heard of before, and a chat's own unmute does not lift the mute of all
    assert not [t for t in runs.run([(n, 50, f"y{n}") for n in range(100, 160)] + [(7, 51, "y7")], [(49, "7", False)]) if t[0] == "y"]
    got = runs.run([(n, 61, f"z{n}") for n in range(200, 230)], [(60, "*", False), (60, "203", True), (60, "none", True)])
    assert [t for t in got if t[0] == "z"] == sorted(f"z{n}" for n in range(200, 230) if n != 203)


@pytest.mark.parametrize("slots, spread", [(1, 1), (16, 4)])
def test_live_mutes_equal_mutes_of_tables(spark, messages_of, tmp_path, slots, spread):
    """Each run brings the commands up to the time of its last message."""
    rng = random.Random(slots)
    rows = sorted(((rng.randrange(6), rng.randrange(3000), f"t{k}") for k in range(400)), key=lambda r: r[1])
    log = sorted((rng.randrange(3000), rng.choice(["*", "0", "1", "2", "3"]), rng.random() < 0.5) for _ in range(60))
    runs = MutedRuns(spark, messages_of, tmp_path, slots=slots, spread=spread)
    for part in range(4):
        got = runs.run(
            [r for r in rows if 750 * part <= r[1] < 750 * (part + 1)], [e for e in log if 750 * part <= e[0] < 750 * (part + 1)]
        )
    table = spark.read.parquet(f"{tmp_path}/log").selectExpr(
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, second) AS ts", "seq", "scope", "muted"
    )
    want = apply_mutes(spark.read.parquet(f"{tmp_path}/messages"), table)
    assert got == sorted(r.text for r in want.collect()) and 0 < len(got) < 400


def test_old_commands_are_forgotten_but_the_last(spark, messages_of, tmp_path):
    runs = MutedRuns(spark, messages_of, tmp_path, keep_seconds=100)
    runs.run(log=[(0, "1", True), (10, "1", False), (20, "1", True), (500, "1", False)])
    assert runs.run([(1, 15, "too late to be judged"), (1, 450, "gone"), (1, 501, "heard")]) == ["heard", "too late to be judged"]
    assert forget([(1, 1, True), (5, 1, False), (9, 1, True)], 6) == [(5, 1, False), (9, 1, True)]
    assert muted_at([(1, 1, True), (1, 2, False)], 1) is False and muted_at([(1, 1, True)], 0) is False


def test_online_compaction_under_live_mutes(spark, messages_of, tmp_path):
    use_rocksdb(spark)
    messages = messages_of([(1, s, f"disk {s} full") for s in range(0, 60, 10)])
    messages.coalesce(1).write.parquet(f"{tmp_path}/in")
    log = [(0, "*", False), (25, "1", True), (45, "1", False)]
    rows = [(second, n, scope, muted) for n, (second, scope, muted) in enumerate(log)]
    schema = "second long, seq long, scope string, muted boolean"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/log")
    stream = spark.readStream.schema(messages.schema).parquet(f"{tmp_path}/in")
    changes = spark.readStream.schema(schema).parquet(f"{tmp_path}/log").selectExpr(
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, second) AS ts", "seq", "scope", "muted"
    )
    write_outbox(compact_stream(stream, OPTS, changes), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    sent = spark.read.parquet(f"{tmp_path}/out").filter("action = 'SEND'").orderBy("seq").collect()
    assert [r.seq for r in sent] == [0, 1, 2, 5] and sent[-1].cnt == 4


# history by change, and the handover from a backlog


class CountingStore(dict):
    def __init__(self):
        super().__init__()
        self.read, self.written = 0, 0

    def load(self, bucket):
        self.read += len(self[bucket])
        return self[bucket]

    def save(self, bucket, entries):
        self.written += len(entries)
        self[bucket] = entries

    def drop(self, bucket):
        del self[bucket]


def test_history_in_buckets_equals_history_in_a_list():
    rng = random.Random(4)
    opts = Options(history_check_count=5, history_max_age_minutes=10)
    for _ in range(20):
        store, buckets, cut, last = CountingStore(), [], BEGIN, 0
        whole, now = [], 0
        for _ in range(12):  # runs
            history = History(store, buckets, cut, last, opts)
            for _ in range(rng.randrange(1, 8)):
                now += rng.randrange(0, 4 * 60_000_000)
                micros = max(0, now - rng.choice([0, 0, rng.randrange(15 * 60_000_000)]))
                seen = history.recent(micros)
                assert seen == recent(whole, micros, opts)
                gone = [e.message_id for e in seen if rng.random() < 0.2]
                last += 1
                entry = Entry(last, f"t{last}", micros)
                history.remove(gone)
                history.add(entry)
                whole = sorted((e for e in [*whole, entry] if e.message_id not in gone), key=lambda e: (e.micros, e.message_id))
            history.settle()
            newest = max(e.micros for e in whole)
            whole = [e for e in whole if e.age_minutes(newest) <= opts.history_max_age_minutes]
            buckets, cut = history.buckets, history.cut
            assert sorted(store) == buckets and len(buckets) <= 13


def test_a_run_reads_and_writes_what_it_touches_however_long_the_history():
    costs = []
    for per_minute in (20, 200):
        store = CountingStore()
        history = History(store, [], BEGIN, 0, OPTS)
        for n in range(59 * per_minute):
            history.add(Entry(n, f"text {n}", n * 60_000_000 // per_minute))
        history.settle()
        store.read = store.written = 0
        now = 60 * 60_000_000
        later = History(store, history.buckets, history.cut, 59 * per_minute, OPTS)
        later.remove([e.message_id for e in later.recent(now)[:1]])
        later.add(Entry(10**6, "new", now))
        later.settle()
        costs.append((store.read / per_minute, store.written / per_minute))
    assert all(read <= 2 and written <= 1.1 for read, written in costs)


def rows_sent(spark, path):
    rows = spark.read.parquet(path).select("chat_id", "seq", "action", "message_id", "text", "cnt").collect()
    return sorted((tuple(r) for r in rows), key=repr)


def test_a_stream_goes_on_from_a_backlog(spark, parts, tmp_path):
    """Two thirds as a table, the rest as a stream in two starts: the rows that replaying all would give."""
    _, cuts, want = parts
    use_rocksdb(spark)
    sent, state = compact_backlog(cuts[0].unionAll(cuts[1]).repartition(3))
    assert state.groupBy("chat_id").count().count() == 4 and sent.columns == state.sparkSession.createDataFrame([], OUTBOX).columns
    halves = [cuts[2].filter("seq < 130"), cuts[2].filter("seq >= 130")]
    for half in halves:
        half.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(half.schema).parquet(f"{tmp_path}/in")
        write_outbox(compact_stream(stream, state=state), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    rows = sent.select("chat_id", "seq", "action", "message_id", "text", "cnt").collect()
    assert sorted([*(tuple(r) for r in rows), *rows_sent(spark, f"{tmp_path}/out")], key=repr) == want


def test_a_backlog_of_one_chat_keeps_little_in_memory(spark, messages_of):
    """A chat of many hours: the state is its last hour, and ids go on."""
    messages = messages_of([(1, 600 * n, f"message number {n} of {n % 7}") for n in range(200)])
    sent, state = compact_backlog(messages.repartition(4))
    kept = state.collect()
    assert {r.last_id for r in kept} == {sent.filter("action = 'SEND'").count()} == {200}
    assert 1 <= len(kept) <= 8 and sum(len(r.entries) for r in kept) <= 8
    nothing, none = compact_backlog(messages.limit(0))
    assert nothing.count() == none.count() == 0


def test_muted_backlogs(spark, messages_of):
    messages = messages_of([(1, 0, "a"), (1, 10, "b"), (2, 10, "c")])
    log = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:05' AS ts, 1L AS seq, '1' AS scope, true AS muted")
    sent, _ = compact_backlog(messages, OPTS, log)
    assert sorted(r.text for r in sent.collect()) == ["a", "c"]


def test_quiet_chats_forget_their_history_but_not_their_ids(spark, messages_of, tmp_path):
    use_rocksdb(spark)

    def run(second, text):
        rows = messages_of([(1, second, text)]).withColumn("seq", F.lit(second).cast("long"))
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
        stream = compact_stream(stream, quiet_seconds=4)
        write_outbox(stream, f"{tmp_path}/out", f"{tmp_path}/cp", idle_runs=False).awaitTermination()
        sent = spark.read.parquet(f"{tmp_path}/out").filter("action = 'SEND'").orderBy("seq").collect()
        return sent[-1].message_id, sent[-1].cnt

    assert run(0, "disk 1 full") == (1, 1)
    assert run(1, "disk 2 full") == (2, 2)
    time.sleep(5)
    assert run(2, "disk 3 full") == (3, 1)
    assert run(3, "disk 4 full") == (4, 2)
