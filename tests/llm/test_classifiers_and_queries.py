"""Classifiers against plain loops, queries without SQL against plain rules, and pipeline stages on odd rows."""

import hashlib
import math
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from alertfold.deploy import ship
from alertfold.llm import labelled, quality, toxicity

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def network(seed=3):
    draw = np.random.default_rng(seed)
    net = quality.Network.fresh(seed)
    for part in net.parts():  # no zero biases, so that nothing is left out by chance
        part += draw.normal(0, 0.05, part.shape).astype(np.float32)
    return net


def chunk_logit(net, text, at):
    """One chunk: every position that starts in it and in the text, filter by filter."""
    span, width = 2 * quality.BLOCK, quality.STRIDE * quality.TAPS
    length = min(span, len(text) - at)
    largest = np.full(quality.FILTERS, -np.inf)
    for spot in range(0, max(length, 1), quality.STRIDE):
        seen = text[at + spot : at + spot + width].ljust(width, b"\0")
        values = net.embed[np.frombuffer(seen, np.uint8)].astype(np.float64).reshape(quality.TAPS, -1)
        largest = np.maximum(largest, sum(values[t] @ net.filters[t].astype(np.float64) for t in range(quality.TAPS)))
    active = np.append(np.maximum(largest + net.bias, 0), max(length, 0) / span)
    hidden = np.maximum(active @ net.dense + net.dense_bias, 0)
    return float(hidden @ net.out + net.out_bias[0])


def score_by_loop(net, text):
    count = max(1, (len(text) + quality._TAIL) // quality.BLOCK)
    logits = [chunk_logit(net, text, at * quality.BLOCK) for at in range(count)]
    return 1 / (1 + math.exp(-sum(logits) / len(logits)))


def test_scores_equal_a_loop_over_chunks():
    draw = random.Random(1)
    sizes = [0, 1, 3, 23, 24, 255, 256, 257, 511, 512, 513, 1000, 1300, 5000]
    texts = [bytes(draw.randrange(1, 256) for _ in range(n)) for n in sizes]
    net = network()
    got = net.score(pa.array([*texts, None], pa.large_binary()))
    want = [score_by_loop(net, t) for t in [*texts, b""]]
    assert np.allclose(got, want, rtol=0, atol=2e-5)


def test_gradients_equal_differences():
    draw = np.random.default_rng(5)
    net = network(5)
    for name, part in list(net.__dict__.items()):
        setattr(net, name, part.astype(np.float64))
    count = 6
    data = draw.integers(0, 256, (count, 2 * quality.BLOCK + quality._TAIL)).astype(np.uint8)
    length = np.array([512, 300, 40, 1, 0, 512])
    label, weight = np.array([0.0, 1, 1, 0, 1, 0]), draw.random(count)

    def loss():
        logits = np.array([chunk_logit_of(net, data[c], length[c]) for c in range(count)])
        return float((weight * (np.log1p(np.exp(logits)) - label * logits)).sum())

    def chunk_logit_of(net, row, n):
        steps = net.embed[row].reshape(-1, quality.STRIDE * quality.DEPTH)
        spots = len(steps) - quality.TAPS + 1
        values = sum(steps[t : t + spots] @ net.filters[t] for t in range(quality.TAPS))
        inside = np.arange(spots) * quality.STRIDE < max(n, 1)
        active = np.append(np.maximum(values[inside].max(axis=0) + net.bias, 0), n / (2 * quality.BLOCK))
        return np.maximum(active @ net.dense + net.dense_bias, 0) @ net.out + net.out_bias[0]

    grads = quality._gradients(net, data, length, label, weight)
    for part, grad in zip(net.parts(), grads):
        for _ in range(12):
            at = tuple(draw.integers(0, n) for n in part.shape)
            kept, step = part[at], 1e-5
            part[at] = kept + step
            above = loss()
            part[at] = kept - step
            below = loss()
            part[at] = kept
            assert grad[at] == pytest.approx((above - below) / (2 * step), rel=2e-3, abs=2e-5)


def slots_by_set(text):
    """Slots of the different n-grams of a text's words, each word with a blank on both sides."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode()
    kept = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in low)
    line = b" " + b"".join(w + b" " for w in kept.split()) if kept.split() else b""
    out = set()
    for n in toxicity.SIZES:
        for gram in {line[i : i + n] for i in range(len(line) - n + 1)}:
            rolling = 0
            for b in gram:
                rolling = (rolling * 0x100000001B3 + b) % (1 << 64)
            x = (rolling + 0x9E3779B97F4A7C15 * (n + 1)) % (1 << 64)
            x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) % (1 << 64)
            x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) % (1 << 64)
            out.add((x ^ (x >> 31)) >> (64 - toxicity.SLOT_BITS))
    return out


TEXTS = ["You ARE bad", "", None, "bad, bad; BAD!", "é où 한국", "a", "x" * 3000, " \t\n", "one\ntwo three 4 5 6" * 40, "a b c d e f"]


def test_grams_are_sets_of_substrings():
    text, slot = toxicity.grams(pa.array(TEXTS).cast(pa.large_binary()))
    for k, t in enumerate(TEXTS):
        assert sorted(slot[text == k].tolist()) == sorted(slots_by_set(t)), k
    wanted = np.zeros(1 << toxicity.SLOT_BITS, bool)
    some = sorted(slots_by_set(TEXTS[0]))[::2]
    wanted[some] = True
    text, slot = toxicity.grams(pa.array(TEXTS).cast(pa.large_binary()), wanted)
    assert slot[text == 0].tolist() == some


def test_slot_counts_and_scores_by_rule(spark):
    rows = [(t, k % 2) for k, t in enumerate(TEXTS)]
    counted = toxicity.slot_counts(spark.createDataFrame(rows, "text string, label int").repartition(3)).collect()
    want = {}
    for t, label in rows:
        for s in slots_by_set(t):
            want.setdefault(s, [0, 0])[label] += 1
    assert {r.slot: [r.clean, r.toxic] for r in counted} == want
    weight = np.zeros(1 << toxicity.SLOT_BITS)
    some = sorted(want)[::3]
    weight[some] = np.random.default_rng(1).normal(0, 1, len(some))
    got = toxicity.Model(weight, -0.25).score(pa.array(TEXTS).cast(pa.large_binary()))
    for t, value in zip(TEXTS, got):
        z = -0.25 + sum(weight[s] for s in slots_by_set(t))
        assert value == pytest.approx(1 / (1 + math.exp(-z)))


@pytest.mark.parametrize("kind", [quality, toxicity])
def test_repeated_and_odd_rows_are_scored_alike(spark, kind):
    draw = random.Random(2)
    word = {0: ["calm", "green", "river"], 1: ["vile", "hate", "stupid"]}
    texts = [" ".join(draw.choice(word[k % 2]) for _ in range(60)) for k in range(200)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(7, texts[7])] * 300 + [(7, "zz"), (None, "x"), (500, None), (501, "")]
    docs = spark.createDataFrame([(i, t, "s", "r") for i, t in rows], "doc_id long, text string, score string, row string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, label int")
    model = kind.fit(docs, labels)
    found = kind.score(docs, model).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.row.score == "s" and r.row.row == "r" for r in found)
    assert len({round(r.score, 6) for r in found if r.row.text == texts[7]}) == 1
    assert len({round(r.score, 6) for r in found if r.row.doc_id in (500, 501)}) == 1
    right = [(r.score >= 0.5) == r.row.doc_id % 2 for r in found if r.row.doc_id is not None and r.row.doc_id < 200 and r.row.text != "zz"]
    assert sum(right) > 0.95 * len(right)
    assert kind.score(docs.limit(0), model).count() == 0
    assert kind.fit(docs.limit(0), labels) is not None


def test_a_repeated_doc_id_is_learned_from_once(spark):
    rows = spark.createDataFrame([(1, "b", 0)] * 50 + [(1, "a", 0), (2, None, 1), (2, "c", 1)], "doc_id long, text string, label int")
    assert sorted(tuple(r) for r in labelled.texts_of(rows).collect()) == [("a", 0), ("c", 1)]


# queries without SQL


needs_data = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


def rows_of(spark, table, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/{table}.parquet").select(*columns).collect()]


@needs_data
def test_nearest_query_by_rule(spark):
    rows = {i: np.array(v, np.float64) for i, v in rows_of(spark, "embeddings", "vec_id", "embedding")}
    ids = np.array(sorted(rows))
    unit = np.array([rows[i] / np.linalg.norm(rows[i]) for i in ids])
    got = {}
    for r in contract.queries()["op6_nearest"](spark, SF_DIR).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(got) == {i for i in rows if i % 50 == 0}
    hits = 0
    for q, found in got.items():
        score = unit @ (rows[q] / np.linalg.norm(rows[q]))
        order = [k for k in np.lexsort((ids, -score)) if ids[k] != q][:5]
        assert sorted(found) == [1, 2, 3, 4, 5]
        assert [found[k][1] for k in range(1, 6)] == sorted((s for _, s in found.values()), reverse=True)
        for vec, value in found.values():
            assert vec != q and value == pytest.approx(score[np.searchsorted(ids, vec)], abs=1e-12)
        hits += len({v for v, _ in found.values()} & {int(ids[k]) for k in order})
    assert hits >= 0.95 * 5 * len(got)


@needs_data
def test_shard_query_by_rule(spark):
    docs = rows_of(spark, "documents", "doc_id", "text")
    rows = {r.doc_id: r for r in contract.queries()["op8_shard"](spark, SF_DIR).collect()}
    assert len(rows) == len(docs)

    def place(doc, shards):
        key = int(hashlib.md5(str(doc).encode()).hexdigest()[:15], 16)
        at, after = -1, 0
        while after < shards:
            at = after
            key = (key * 2862933555777941757 + 1) % (1 << 64)
            after = int((at + 1) * (float(1 << 31) / float((key >> 33) + 1)))
        return at

    for doc, text in docs:
        r, data = rows[doc], (text or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 8, zlib.crc32(data), "key")
        assert (r.shard, r.grown_shard) == (place(doc, 24), place(doc, 25))
    for shard in range(24):
        slots = sorted(r.slot for r in rows.values() if r.shard == shard)
        assert slots == list(range(len(slots)))


@needs_data
@pytest.mark.parametrize("name, column, modulus, kept_back", [("op7_quality", "quality", 3, 1), ("op10_toxicity", "toxic", 5, 0)])
def test_classifier_queries_by_rule(spark, name, column, modulus, kept_back):
    known = dict(rows_of(spark, "labels", "doc_id", column))
    rows = contract.queries()[name](spark, SF_DIR).collect()
    assert sorted(r.doc_id for r in rows) == sorted(d for (d,) in rows_of(spark, "documents", "doc_id"))
    right = []
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == kept_back)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        if r.held_out and known.get(r.doc_id) is not None:
            right.append(r.predicted == known[r.doc_id])
    assert len(right) > 5 and sum(right) >= 0.8 * len(right)


# pipeline stages


@needs_data
def test_every_stage_takes_odd_rows_and_empty_tables(spark):
    """Nulls in any column, empty and repeated rows, columns with names that stages use themselves."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, score string, key string"
    schema += ", shard string, _digest string, times string, node string"
    long = " ".join(f"word{k % 977} is {k}" for k in range(3000))
    texts = [None, "", " ", "one", long, long, "A plain note about rivers and green hills near the sea. " * 5] * 3
    more = ["r", "s", "k", "h", "d", "t", "n"]
    rows = [(k // 2 if k % 5 else None, t, None, [None, "a", "b"][k % 3], None, *more) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_DIR)
        own = [c for c in docs.columns if name != "shards" or c != "shard"]
        assert out.columns[: len(own)] == own, name
        assert len(out.columns) == len(own) + (3 if name == "shards" else 0), name
        found = out.collect()
        for r in found:
            assert (r.row, r.score, r.key, r._digest, r.times, r.node) == ("r", "s", "k", "d", "t", "n"), name
        assert stage(spark, docs.limit(0), SF_DIR).count() == 0, name
        if name in ("near_copies", "decontamination", "shards"):
            assert len(found) >= (9 if name == "near_copies" else len(rows) - 3), name
