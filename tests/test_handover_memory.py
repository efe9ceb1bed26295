"""A first run that begins with a history holds no more than later ones."""

import resource

import pandas as pd
import pyarrow as pa

from alertfold.options import Options
from alertfold.streaming import online
from alertfold.streaming.packs import rows_of, to_pack


class Handle:
    kept = None

    def __init__(self):
        self.minutes = {}

    def getValueState(self, *named):
        return self

    getMapState = getValueState

    def exists(self):
        return self.kept is not None

    def get(self):
        return self.kept

    def update(self, value):
        self.kept = value

    def updateValue(self, key, value):
        self.minutes[key] = value

    def getValue(self, key):
        return self.minutes[key]

    def removeKey(self, key):
        del self.minutes[key]


def messages(low, high, text):
    columns = [[n * 60_000_000 for n in range(low, high)], list(range(low, high)), [f"{n * 7919:x}{text}" for n in range(low, high)]]
    return to_pack(pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["micros", "seq", "text"]))


def begins_with(last_id):
    entry = {"message_id": last_id, "text": "before", "micros": 0, "pattern": None, "cnt": 1}
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(online._ENTRY)]
    arrays = [pa.array([v], k) for v, k in zip((last_id, online.BEGIN, 0, [entry]), kinds)]
    return to_pack(pa.RecordBatch.from_arrays(arrays, ["last_id", "cut", "bucket", "entries"]))


def first_and_last_id(gate, parts):
    first = last = None
    for part in gate.handleInputRows(("1",), parts, None):
        for ids in (b.column("message_id") for pack in part["pack"] for b in rows_of(pack)):
            first, last = first if first is not None or not len(ids) else ids[0].as_py(), ids[-1].as_py() if len(ids) else last
    return first, last


def test_a_first_run_beside_a_history_holds_its_last_hour():
    gate = online.OnlineCompaction(Options(history_check_count=1))
    gate.init(Handle())

    def parts():
        for n in range(0, 60_000, 500):
            yield pd.DataFrame({"pack": [messages(n, n + 500, "x" * 4_000)], "held": [False]})
        yield pd.DataFrame({"pack": [begins_with(41)], "held": [True]})  # in any order

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert first_and_last_id(gate, parts()) == (42, 60_041)
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) >> 10 < 160  # of 240 MB
    # a chat that is known goes on from its own history
    later = pd.DataFrame({"pack": [begins_with(7), messages(60_000, 60_002, "y")], "held": [True, False]})
    assert first_and_last_id(gate, iter([later])) == (60_042, 60_043)


def test_a_chat_may_begin_without_messages():
    gate = online.OnlineCompaction(Options())
    gate.init(Handle())
    assert first_and_last_id(gate, iter([pd.DataFrame({"pack": [begins_with(41)], "held": [True]})])) == (None, None)
    assert first_and_last_id(gate, iter([pd.DataFrame({"pack": [messages(0, 1, "z")]})])) == (42, 42)
