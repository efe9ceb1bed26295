"""Many commands of a run in one slot: judged as columns, not held as objects."""

import random
import tracemalloc

import pandas as pd
import pyarrow as pa

from alertfold.operators import commands
from alertfold.streaming.mutes import MuteGate, forget, muted_at
from alertfold.streaming.packs import rows_of, to_pack


class Handle:
    def __init__(self):
        self.log = {}

    def getMapState(self, *named):
        return self

    def containsKey(self, key):
        return key in self.log

    def getValue(self, key):
        return self.log[key]

    def updateValue(self, key, value):
        self.log[key] = value


def commands_of(scope, entries):
    packs = [to_pack(pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*entries)], ["micros", "seq", "muted"]))]
    return pd.DataFrame({"scope": scope, "pack": packs})


def messages_of_chats(rows):
    scopes, micros = ([r[n] for r in rows] for n in (0, 1))
    found = [{"chat_id": int(s) if s else None, "at": m} for s, m in zip(scopes, micros)]
    kind = pa.struct([("chat_id", pa.int64()), ("at", pa.int64())])
    arrays = [pa.array(scopes), pa.array(micros, pa.int64()), pa.array(found, kind)]
    return pd.DataFrame({"scope": [""], "pack": [to_pack(pa.RecordBatch.from_arrays(arrays, ["scope", "micros", "row"]))]})


def run(gate, *parts):
    heard = gate.handleInputRows((1,), iter(parts), None)
    return [r["row"] for part in heard for pack in part["pack"] for b in rows_of(pack) for r in b.to_pylist()]


def test_the_gate_judges_as_the_plain_rule_over_runs():
    rng, handle = random.Random(4), Handle()
    gate = MuteGate(1)
    gate.init(handle)
    lines = {s: [] for s in ("*", "1", "2", "3", "")}
    for _ in range(6):
        new = {s: [(rng.randrange(3_000_000), rng.randrange(5), rng.random() < 0.5) for _ in range(30)] for s in ("*", "1", "2")}
        new["1"] += new["1"][:3]  # delivered twice
        rows = [(rng.choice(["1", "2", "3", ""]), rng.choice([None, rng.randrange(3_000_000)])) for _ in range(200)]
        got = run(gate, messages_of_chats(rows), *(commands_of(s, e) for s, e in new.items()))
        for s, entries in new.items():
            lines[s] = sorted({*lines[s], *entries})
        want = [(s, m) for s, m in rows if not (muted_at(lines["*"], m) or muted_at(lines[s], m))]
        assert [(str(r["chat_id"] or ""), r["at"]) for r in got] == want and 0 < len(got) < 200
        for s in new:
            lines[s] = forget(lines[s], lines[s][-1][0] - 1_000_000)
            assert handle.log[(s,)] == (lines[s],)


def test_many_commands_of_a_run_take_little_memory():
    gate = MuteGate(1)
    gate.init(Handle())

    def parts():
        for low in range(0, 300_000, 500):
            yield commands_of("*", [(n * 1_000_000, n, n % 2 > 0) for n in range(low, low + 500)])
        yield messages_of_chats([("1", 299_998_000_001), ("1", 299_999_000_001)])

    tracemalloc.start()
    try:
        assert [r["at"] for r in run(gate, *parts())] == [299_998_000_001]
        peak = tracemalloc.get_traced_memory()[1] >> 20
    finally:
        tracemalloc.stop()
    # 5 MB of columns, and as much while they are sorted
    assert peak < 60


def test_mutes_are_found_without_splitting_every_command(spark):
    texts = ["action.stopall", "action.startchat", "action.stopall now", "action.stopchat ", "main", "", None]
    rows = [(n, n, 7, "u", text) for n, text in enumerate(texts)]
    log = commands.mute_log_from_commands(
        commands.parse_commands(spark.createDataFrame(rows, "ts long, seq long, chat_id long, username string, data string"))
    )
    assert sorted(tuple(r) for r in log.collect()) == [(0, 0, "*", True), (1, 1, "7", False)]
    assert "split(" not in log._jdf.queryExecution().optimizedPlan().toString()
