"""Streams in packs: order through files, and no more than the recent history held within a run."""

import random
import resource

import pyarrow as pa
from pyspark.sql import functions as F

from alertfold.options import Options
from alertfold.streaming import online
from alertfold.streaming.history import BEGIN, History
from alertfold.streaming.packs import in_order, packed, rows_of, to_pack, unpacked


def batches_of(rows, size):
    names = ["micros", "seq", "text"]
    for at in range(0, len(rows), size):
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[at : at + size])], names)


def test_rows_are_in_order_whatever_goes_through_files():
    rng = random.Random(2)
    rows = [(rng.randrange(50), rng.randrange(4), f"text {n}") for n in range(3000)]
    want = sorted(rows, key=lambda r: r[:2])  # equal ones as they came
    for run_bytes in (1, 5_000, 1 << 30):
        assert list(in_order(batches_of(rows, 70), ["micros", "seq"], run_bytes)) == want
    assert list(in_order(iter(()), ["micros", "seq"])) == []


def test_packs_keep_types_and_nulls(spark):
    rows = spark.range(500).selectExpr(
        "cast(id % 7 AS string) AS chat",
        "CASE WHEN id % 3 > 0 THEN id + 9007199254740993 END AS big",
        "CASE WHEN id % 2 > 0 THEN named_struct('a', cast(id AS int), 't', timestamp_ntz'2024-01-01 00:00:00') END AS s",
    )
    packs = packed(rows, "chat")
    assert packs.columns == ["chat", "pack"] and packs.groupBy("chat").count().count() == 7
    again = unpacked(packs, rows.drop("chat").schema)
    key = F.to_json(F.struct("big", "s"))
    assert sorted(r[0] for r in again.select(key).collect()) == sorted(r[0] for r in rows.select(key).collect())


class Store(dict):
    load, save = dict.__getitem__, dict.__setitem__

    def drop(self, bucket):
        del self[bucket]


def test_a_run_may_forget_on_the_way():
    """Runs with late messages decide the same with and without it."""
    opts, rng = Options(history_max_age_minutes=5, history_check_count=4), random.Random(8)
    done = []
    for step in (10**9, 3):
        rng.seed(8)
        state, sent = (Store(), [], BEGIN, 0), []
        for start in (0, 20, 25, 12, 60):
            late = [(start + rng.randrange(30)) * 60_000_000 + rng.randrange(10**7) for _ in range(40)]
            messages = [(m, n, f"disk {n % 3} is full on host {n % 5}") for n, m in enumerate(sorted(late))]
            history = History(*state, opts)
            for at in range(0, len(messages), step):
                sent += online.decisions(1, messages[at : at + step], history, opts)
                history.forget(messages[at : at + step][-1][0])
            history.settle()
            state = (state[0], history.buckets, history.cut, history.last_id)
            sent.append(sorted(state[0].items()))
        done.append(sent)
    assert done[0] == done[1]


def test_a_long_run_holds_its_last_hour():
    class Handle:
        def getValueState(self, *named):
            return self

        getMapState = getValueState

        def exists(self):
            return False

        def update(self, value):
            self.kept = value

        def updateValue(self, *entry):
            pass

        removeKey = updateValue

    gate = online.OnlineCompaction(Options(history_check_count=1))
    gate.init(Handle())
    long = "x" * 4_000

    def packs():
        import pandas as pd

        for n in range(0, 60_000, 500):
            rows = [(m * 60_000_000, m, f"{m * 7919:x}{long}") for m in range(n, n + 500)]
            yield pd.DataFrame({"pack": [to_pack(b) for b in batches_of(rows, 500)]})

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    rows = 0
    for part in gate.handleInputRows(("1",), packs(), None):
        rows += sum(b.num_rows for pack in part["pack"] for b in rows_of(pack))
    grown = (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) >> 10
    # 240 MB in, and as much out: 16 MB are sorted at once, and what is given is given on
    assert rows >= 60_000 and grown < 160 and gate.index.kept[0] == 60_000 and len(gate.index.kept[3]) <= 62
