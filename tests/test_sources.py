import json
import os
import time
from pathlib import Path

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from alertfold.sources.api_dump import parse_api_dump
from alertfold.sources.outbox import start_runs, write_outbox, write_run
from alertfold.sources.queue import enqueue, read_queue, stream_queue, with_message_id
from alertfold.sources.spool import read_spool, stream_spool, write_spool
from alertfold.sources.spool_files import SpoolStream
from alertfold.streaming.run import run_to_outbox, use_rocksdb


def test_spool(spark, tmp_path):
    files = {
        "42/0123456789ABCDEF": "two\nlines\n".encode(),
        "-100500/AAAAAAAAAAAAAAAA": "été".encode(),
        "-100500/BBBBBBBBBBBBBBBB": b"",
        "42/CCCCCCCCCCCCCCCC": b"\xff\xfe no text \x00",
        "42/sending_off": b"",
        "42/.hidden": b"x",
        "notachat/CCCCCCCCCCCCCCCC": b"x",
    }
    for name, content in files.items():
        path = tmp_path / "pending" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    want = {(int(n.split("/")[0]), n.split("/")[1], c) for n, c in list(files.items())[:4]}
    with_bytes = lambda df: df.select("chat_id", "msg_id", F.col("text").cast("binary").alias("b"))
    spool = read_spool(spark, str(tmp_path / "pending"), slices=3)
    assert {(r.chat_id, r.msg_id, bytes(r.b)) for r in with_bytes(spool).collect()} == want
    assert spool.schema["ts"].dataType.simpleString() == "timestamp_ntz" and spool.filter("ts IS NULL").count() == 0

    stream = with_bytes(stream_spool(spark, str(tmp_path / "pending"), after="keep"))
    write_outbox(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert {(r.chat_id, r.msg_id, bytes(r.b)) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want
    assert (tmp_path / "pending/42/sending_off").exists() and (tmp_path / "pending/42/0123456789ABCDEF").exists()


def test_spool_round_trip(spark, tmp_path):
    rows = [(7, "a"), (7, "a"), (7, "b\n"), (-8, ""), (-8, None), (9, "é\r\n")]
    messages = spark.createDataFrame(rows, "chat_id long, text string").repartition(3)
    write_spool(messages, str(tmp_path / "out"))
    write_spool(messages, str(tmp_path / "out"))  # adds
    back = sorted((r.chat_id, r.text) for r in read_spool(spark, str(tmp_path / "out")).collect())
    assert back == sorted(2 * [(c, t or "") for c, t in rows])
    names = [p.name for p in (tmp_path / "out").rglob("*") if p.is_file()]
    assert len(set(names)) == 12 and all(len(n) == 16 for n in names)
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith(".staged")]


def test_a_failed_job_shows_no_messages(spark, tmp_path):
    bad = spark.range(100).selectExpr("id AS chat_id", "if(id = 90, raise_error('no'), 'x') AS text")
    with pytest.raises(Exception, match="no"):
        write_spool(bad, str(tmp_path / "out"))
    assert read_spool(spark, str(tmp_path / "out")).count() == 0
    with pytest.raises(Exception, match="only added"):
        spark.range(1).selectExpr("id AS chat_id", "binary('') AS content").write.format("spool").mode("overwrite").save(
            str(tmp_path / "out")
        )


def test_an_empty_spool(spark, tmp_path):
    assert read_spool(spark, str(tmp_path / "none")).count() == 0
    write_outbox(stream_spool(spark, str(tmp_path / "none")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()


class Spool:
    """A spool on disk with a query that can be made to fail."""

    def __init__(self, spark, folder, **options):
        self.spark, self.folder, self.options = spark, folder, options

    def drop(self, *names):
        for name in names:
            path = self.folder / "pending" / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(name if "empty" not in name else "")

    def run(self, fail=None):
        """``fail`` is None, or when the run dies: before its rows are written, or after."""

        def handle(rows, batch_id):
            if fail == "before":
                raise RuntimeError("died")
            write_run(rows, str(self.folder / "out"), batch_id)
            if fail == "after":
                raise RuntimeError("died")

        stream = stream_spool(self.spark, str(self.folder / "pending"), **self.options)
        query = start_runs(stream, handle, str(self.folder / "cp"))
        if fail:
            with pytest.raises(StreamingQueryException):
                query.awaitTermination()
        else:
            query.awaitTermination()

    def sent(self):
        return sorted(f"{r.chat_id}/{r.msg_id}" for r in self.spark.read.parquet(str(self.folder / "out")).collect())

    def left(self):
        pending = self.folder / "pending"
        return sorted(str(p.relative_to(pending)) for p in pending.rglob("*") if p.is_file() and ".claims" not in p.parts)


def test_the_spool_empties_behind_its_query(spark, tmp_path):
    spool = Spool(spark, tmp_path)
    spool.drop("1/a", "1/empty", "-2/b", "1/sending_off")
    spool.run()
    assert spool.sent() == ["-2/b", "1/a", "1/empty"] and len(spool.left()) == 4  # until the next run begins
    spool.drop("1/c")
    spool.run()
    assert spool.sent() == ["-2/b", "1/a", "1/c", "1/empty"] and spool.left() == ["1/c", "1/sending_off"]
    spool.run()
    assert spool.sent() == ["-2/b", "1/a", "1/c", "1/empty"] and spool.left() == ["1/sending_off"]
    assert len(list((tmp_path / "pending/.claims").iterdir())) == 1


@pytest.mark.parametrize("fail", ["before", "after"])
def test_a_run_that_dies_is_repeated_with_the_same_files(spark, tmp_path, fail):
    spool = Spool(spark, tmp_path)
    spool.drop("1/a", "2/b")
    spool.run(fail)
    spool.drop("1/later", "3/c")  # not part of the repeated run, but not lost either
    spool.run()
    spool.run()
    assert spool.sent() == ["1/a", "1/later", "2/b", "3/c"]
    spool.run()
    assert spool.left() == []


def test_claims_without_an_offset_are_taken_up(spark, tmp_path):
    """The reader died after it wrote its claim and before Spark knew of it."""
    spool = Spool(spark, tmp_path)
    spool.drop("1/a", "2/b")
    SpoolStream(str(tmp_path / "pending"), 100, "delete", None, 0).latestOffset()
    spool.drop("1/c")
    for _ in range(3):
        spool.run()
    assert spool.sent() == ["1/a", "1/c", "2/b"] and spool.left() == []


def test_clearing_may_be_repeated_and_spares_new_files(spark, tmp_path):
    spool = Spool(spark, tmp_path)
    spool.drop("1/a", "1/b")
    spool.run()
    (tmp_path / "pending/1/a").unlink()  # the clearing that follows was cut off here before
    (tmp_path / "pending/1/b").write_text("another message of this name")
    spool.run()
    assert spool.left() == ["1/b"] and spool.sent() == ["1/a", "1/b", "1/b"]


def test_handled_files_go_to_the_archive(spark, tmp_path):
    spool = Spool(spark, tmp_path, after="archive", archive=str(tmp_path / "old"))
    spool.drop("1/a", "-2/b")
    for _ in range(2):
        spool.run()
    assert spool.left() == [] and sorted(p.name for p in (tmp_path / "old").rglob("[ab]")) == ["a", "b"]
    assert (tmp_path / "old/1/a").read_text() == "1/a"
    with pytest.raises(Exception, match="archive"):
        Spool(spark, tmp_path / "x", after="archive").run()


def test_runs_take_the_oldest_files_first_and_spare_young_ones(spark, tmp_path):
    spool = Spool(spark, tmp_path, max_files_per_trigger=2, quiet_seconds=3600)
    for age, name in enumerate(("1/new", "2/b", "1/a", "3/oldest")):
        spool.drop(name)
        at = time.time() - 5000 * age
        os.utime(tmp_path / "pending" / name, (at, at))
    spool.run()
    assert spool.sent() == ["1/a", "3/oldest"]
    spool.run()
    spool.run()
    assert spool.sent() == ["1/a", "2/b", "3/oldest"] and spool.left() == ["1/new"]


def test_queue_and_identity(spark, tmp_path, messages_of):
    messages = messages_of([(1, 0, "a"), (2, 1, "a")])
    enqueue(messages, str(tmp_path / "q"))
    enqueue(messages_of([(1, 5, "later")]), str(tmp_path / "q"))
    back = read_queue(spark, str(tmp_path / "q"))
    assert back.count() == 3
    use_rocksdb(spark)
    stream = stream_queue(spark, str(tmp_path / "q"), 1000)
    write_outbox(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"), "msg_id").awaitTermination()
    streamed = spark.read.parquet(str(tmp_path / "out"))
    assert {r.msg_id for r in streamed.collect()} == {r.msg_id for r in back.collect()} and streamed.count() == 3
    ids = {r.msg_id for r in with_message_id(messages).collect()}
    assert len(ids) == 2 and ids < {r.msg_id for r in back.collect()}


def test_api_dump(spark):
    bodies = [
        json.dumps({"jsonrpc": "2.0", "id": 1, "result": [{"triggerid": "1", "description": "d"}, {"triggerid": "2"}]}),
        json.dumps({"jsonrpc": "2.0", "id": 2, "error": {"code": -32602, "data": "No permissions"}}),
        json.dumps({"jsonrpc": "2.0", "id": 3, "result": []}),
        "<html>",
    ]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "file long, body string")
    items, errors = parse_api_dump(df, "triggerid STRING, description STRING")
    assert [tuple(r) for r in items.collect()] == [(0, "1", "d"), (0, "2", None)]
    assert [tuple(r) for r in errors.orderBy("file").collect()] == [(1, "No permissions"), (3, None)]


def test_outbox_keeps_each_message_once(spark, tmp_path):
    use_rocksdb(spark)
    source, path, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    for ids in (["a", "b", "a"], ["b", "c"]):  # a new start for each, from the checkpoint
        spark.createDataFrame([(i,) for i in ids], "msg_id string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("msg_id string").parquet(source)
        write_outbox(stream, path, checkpoint, "msg_id").awaitTermination()
    assert sorted(r.msg_id for r in spark.read.parquet(path).collect()) == ["a", "b", "c"]


def test_a_repeated_run_replaces_its_rows(spark, tmp_path):
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "msg_id string")
    for batch_id, ids in ((0, ["a"]), (1, ["b", "c"]), (1, ["b", "c"])):
        write_run(rows(*ids), str(tmp_path / "out"), batch_id)
    assert sorted(r.msg_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


def test_a_new_checkpoint_leaves_earlier_runs(spark, tmp_path):
    use_rocksdb(spark)
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("a",), ("b",)], "msg_id string").write.parquet(source)
    for checkpoint in ("one", "two"):
        stream = spark.readStream.schema("msg_id string").parquet(source)
        write_outbox(stream, path, str(tmp_path / checkpoint)).awaitTermination()
    assert sorted(r.msg_id for r in spark.read.parquet(path).collect()) == ["a", "a", "b", "b"]


def test_keys_are_kept_for_their_time_only(spark, tmp_path):
    use_rocksdb(spark)
    source, path, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))

    def run(ids, keep_seconds):
        rows = spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "msg_id string, n long")
        rows.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("msg_id string, n long").parquet(source)
        write_outbox(stream, path, checkpoint, "msg_id", keep_seconds=keep_seconds).awaitTermination()
        return sorted(r.msg_id for r in spark.read.parquet(path).collect())

    assert run(["a", "b", "a"], 3600) == ["a", "b"]
    assert run(["b", "c"], 3600) == ["a", "b", "c"]
    checkpoint, path, source = (str(tmp_path / n) for n in ("checkpoint2", "out2", "in2"))
    assert run(["a"], 1) == ["a"]
    time.sleep(1.5)
    assert run(["a"], 1) == ["a", "a"]


def test_enqueue_writes_about_a_file_per_chat(spark, tmp_path):
    rows = spark.range(0, 2000, numPartitions=16).select(
        F.pmod("id", F.lit(10)).alias("chat_id"),
        F.timestamp_seconds(F.col("id")).cast("timestamp_ntz").alias("ts"),
        F.col("id").alias("seq"),
        F.lit("x").alias("text"),
    )
    enqueue(rows, str(tmp_path / "q"))
    assert read_queue(spark, str(tmp_path / "q")).count() == 2000
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(list(Path(tmp_path / "q").rglob("*.parquet"))) <= 10 + tasks


def test_an_empty_stream_gives_no_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("msg_id string").parquet(str(tmp_path / "in"))
    assert run_to_outbox(stream).count() == 0
