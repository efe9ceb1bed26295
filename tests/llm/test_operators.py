"""Each operator against plain rules on small tables, with nulls, empty and long texts, repeats and other columns."""

import gzip
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from alertfold.deploy import ship
from alertfold.llm import components, decontaminate, jaccard, labelled, license_scan, mixing, neighbours
from alertfold.llm import quality, queries, sharding, substring_dedup, toxicity, warc
from alertfold.llm.signature_tree import SignatureTree


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def table(spark, texts, ids=None, **more):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, *(m[k] for m in more.values())) for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, "doc_id long, text string" + "".join(f", {name} string" for name in more))


def random_words(draw, count, vocabulary=30):
    return [f"w{draw.randrange(vocabulary)}" for _ in range(count)]


def corpus(seed=3):
    """Texts that share passages and runs, near and exact copies, short, empty and missing ones."""
    draw = random.Random(seed)
    passage, run = random_words(draw, 60, 500), ["again"] * 45
    texts = []
    for _ in range(12):
        words = random_words(draw, draw.randrange(1, 90), 400)
        at = draw.randrange(len(words))
        texts.append(" ".join(words[:at] + draw.choice([passage, run, [], passage[10:40]]) + words[at:]))
    near = random_words(draw, 80, 900)
    texts += [" ".join(near[:k] + ["other"] + near[k + 1 :]) for k in (0, 40, 79)] + [" ".join(near)] * 2
    return texts + ["", None, "  \t", "one two", "ONE  two", "x" * 3000, " ".join(random_words(draw, 3000, 60))]


# license scan


def test_templates_skip_optional_and_replaceable_regions(spark):
    texts = ["Released under the terms of the MIT License", "released UNDER the mit-license!", "Released under MIT license"]
    texts += ["Copyright (c) 2020 Some Body. All rights reserved", "copyright all rights reserved", "", None]
    rows = license_scan.scan(table(spark, texts, places=["x"] * 7)).orderBy("row.doc_id").collect()
    labels = [sorted({p.label for p in r.places if not p.base}) for r in rows]
    assert labels == [["mit-notice"], ["mit-notice"], [], ["copyright", "proprietary"], ["copyright", "proprietary"], [], []]
    assert rows[0].score == 5 / 6 and rows[5].score == 0 and rows[6].n_words == 0 and rows[0].row.places == "x"


def test_base_phrases_overlap_and_count_every_place(spark):
    row = license_scan.scan(table(spark, ["cc by nc cc BY-NC, the mit license"])).first()
    assert [(p.label, p.first) for p in row.places if p.base] == [("mit", 6), ("cc-by-nc", 0), ("cc-by-nc", 3)]


def test_the_query_takes_the_phrases_of_its_contract(spark, tmp_path):
    """Against a plain rule, on texts with odd characters around and within the words of the phrases."""
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    draw = random.Random(5)
    parts = [*" ".join(phrases).split(), *(phrases | {"the mit license": ""}), "x", "MIT\u212a", "\u0130", "\U0001f600"]
    joints = [" ", ", ", "\n", "\x00", "\x7f", "-", "_", "\u00a0", ""]
    texts = ["see the mit license", "under the MIT License", "UNDER the\tmit license under the mit license", "", None]
    texts += ["".join(draw.choice(parts) + draw.choice(joints) for _ in range(draw.randrange(40))) for _ in range(300)]
    table(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for row in queries.QUERIES["op1_license_scan"](spark, str(tmp_path)).collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (texts[row.doc_id] or "").translate(lower))
        spots = [
            (at, label)
            for phrase, label in phrases.items()
            for at in range(len(words))
            if words[at : at + phrase.count(" ") + 1] == phrase.split()
        ]
        starts = [at for at, _ in spots] or [None]
        assert (row.n_words, row.n_base) == (len(words), len(spots))
        assert (row.first_word, row.last_word) == (min(starts), max(starts))
        assert row.base_labels == ",".join(sorted({label for _, label in spots}))


def test_the_query_gives_places_of_names_outside_the_phrases_of_its_contract(spark, tmp_path):
    texts = ["see the MIT license", "The mit-license, under the mit license; cc by nc", "mit license", "", None]
    table(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.QUERIES["op1_license_scan"](spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [(r.n_base, r.base_labels) for r in rows] == [(0, ""), (2, "cc-by-nc,mit"), (0, ""), (0, ""), (0, "")]
    assert [r.labels for r in rows] == ["mit", "cc-by-nc,mit", "", "", ""]
    assert [r.score for r in rows] == [3 / 4, 4 / 5, 0, 0, 0]
    names = [(r.n_names, r.first_name, r.last_name, r.name_labels) for r in rows]
    assert names == [(1, 1, 1, "mit"), (3, 0, 7, "cc-by-nc,mit")] + [(0, None, None, "")] * 3


def test_the_columns_of_names_are_those_of_phrases_by_the_operators_default(spark, tmp_path):
    """On texts with and without 'under', and with names that overlap or repeat."""
    draw = random.Random(8)
    parts = [*"under the mit license apache version 2 cc by nc".split(), *license_scan.NAMES, "under the mit license"]
    texts = [" ".join(draw.choice(parts) for _ in range(draw.randrange(25))) for _ in range(300)]
    table(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.QUERIES["op1_license_scan"](spark, str(tmp_path)).collect()}
    for r in license_scan.scan(table(spark, texts)).collect():
        row, base = got[r.row.doc_id], [p for p in r.places if p.base]
        starts = [p.first for p in base] or [None]
        assert (row.n_names, row.first_name, row.last_name) == (len(base), min(starts), max(starts))
        assert row.name_labels == ",".join(sorted({p.label for p in base}))
        assert {p.label for p in r.places} == set(filter(None, row.labels.split(","))) and row.score >= r.score


def test_a_template_must_be_well_formed():
    for bad in ("<<optional>> a <<end>> b", "a <<optional>> b", "<<any 3>>"):
        with pytest.raises(ValueError):
            license_scan.compiled(bad)


# substring dedup


def kept_by_rule(rows, window):
    first, out = {}, {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        words = (text or "").split()
        gone = set()
        for at in range(len(words) - window + 1):
            key = tuple(words[at : at + window])
            if first.setdefault(key, (doc, at)) != (doc, at):
                gone.update(range(at, at + window))
        out[doc] = (len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone))
    return out


@pytest.mark.parametrize("window", [5, 20])
def test_repeated_windows_go_as_by_rule(spark, window):
    texts = corpus()
    got = substring_dedup.without_repeats(table(spark, texts, kept=["k"] * len(texts)).repartition(3), window).collect()
    want = kept_by_rule(list(enumerate(texts)), window)
    assert {r.row.doc_id: (r.n_words, r.n_removed, r.kept) for r in got} == want
    assert any(n for _, n, _ in want.values())


def test_a_window_symbol_depends_on_its_words_alone():
    draw = np.random.default_rng(0)
    words = draw.integers(0, 4, 400).astype(np.uint64)
    inner = words[100:120]
    found = set()
    for _ in range(200):
        around = [draw.integers(0, 4, 30).astype(np.uint64) for _ in range(2)]
        line = np.concatenate([around[0], inner, around[1]])
        symbol, place = substring_dedup.window_symbols(line, np.zeros(len(line), np.int64), np.array([30]), 20)
        found.add((int(symbol[0]), int(place[0])))
    assert len(found) == 1


def test_rows_of_one_doc_id_do_not_remove_each_other(spark):
    text = " ".join(f"a{i}" for i in range(25))
    rows = substring_dedup.without_repeats(table(spark, [text, text, text], [1, 1, None])).collect()
    assert sorted((r.row.doc_id or 0, r.n_removed) for r in rows) == [(0, 25), (1, 0), (1, 0)]


def test_rows_of_one_doc_id_are_judged_by_start_in_any_order(spark):
    passage = " ".join(f"p{i}" for i in range(25))
    late = " ".join(f"l{i}" for i in range(10)) + " " + passage
    early = " ".join(f"e{i}" for i in range(5)) + " " + passage
    for texts in ([late, early], [early, late]):
        rows = substring_dedup.without_repeats(table(spark, texts, [1, 1]).coalesce(1)).collect()
        assert {r.row.text: r.n_removed for r in rows} == {late: 25, early: 0}


# mixing


def water_by_rule(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        share = {s: weight[s] * left / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in capped else share[s] for s in names}
        capped |= over


def test_targets_and_taken_words(spark):
    draw = random.Random(1)
    sources = [draw.choice(["a", "a", "a", "b", "c", None]) for _ in range(600)]
    texts = [" ".join(["w"] * draw.randrange(0, 30)) for _ in sources]
    docs = table(spark, texts, source=sources)
    sized, plan = mixing.mixture(docs)
    sizes = {s: sum(len(t.split()) for t, x in zip(texts, sources) if x == s) for s in set(sources)}
    targets = {r.source: r.target for r in plan.collect()}
    assert targets == pytest.approx(water_by_rule(sizes))
    taken = mixing.joined(sized, plan, ["source"], "inner").select("source", (F.col("size") * mixing.copies()).alias("t"))
    for row in taken.groupBy("source").agg(F.sum("t").alias("t")).collect():
        assert abs(row.t - targets[row.source]) <= 30
    again = sorted(map(str, mixing.mix(docs).collect()))
    assert again == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    assert max(len(list(g)) for _, g in itertools.groupby(again)) <= 3


def test_mixing_nothing_and_no_words(spark):
    empty = table(spark, [], source=[])
    assert mixing.mix(empty).count() == 0
    assert mixing.mix(table(spark, ["", None], source=["a", "b"])).count() == 2


def test_mixing_keeps_columns_of_any_name(spark):
    names = ["_s", "_k", "_times", "_time", "key", "whole", "last_key", "target", "row", "_k_source"]
    docs = table(spark, ["a b", "c", None], source=["x", "y", None], **{n: [f"{n}{i}" for i in range(3)] for n in names})
    rows = mixing.mix(docs).collect()
    assert rows and rows[0].__fields__ == docs.columns
    for r in rows:
        assert all(r[n] == f"{n}{r.doc_id}" for n in names) and r.source == ["x", "y", None][r.doc_id]


def test_texts_without_words_respect_the_cap(spark):
    texts = ["w " * 50] * 3 + [""] * 40 + ["v " * 2000]
    docs = table(spark, texts, list(range(44)), source=["a"] * 43 + ["b"])
    times = {r.doc_id: r["count"] for r in mixing.mix(docs).groupBy("doc_id").count().collect()}
    assert max(times.values()) <= 3 and {times[i] for i in range(43)} == {3}


def test_repeated_and_missing_doc_ids_are_mixed_row_by_row(spark):
    docs = table(spark, ["a b c"] * 4 + ["d e"] * 2, [1, 1, None, None, 2, 3], source=["x"] * 4 + ["y"] * 2)
    rows = mixing.mix(docs).groupBy("doc_id").count().collect()
    assert {r.doc_id for r in rows} <= {1, None, 2, 3} and sum(r["count"] for r in rows) >= 4


# WARC


@pytest.mark.parametrize("split", [64, 700, 1 << 20])
def test_archives_come_back_whole_from_any_split(spark, tmp_path, split):
    draw = random.Random(5)
    same = "<p>" + "same " * 50
    html = ["".join(chr(draw.randrange(32, 900)) for _ in range(draw.randrange(0, 3000))) for _ in range(20)]
    html += [same, same, "short", "short", "", None, same]
    rows = [(i, f"http://a.b/{i} x\n", h) for i, h in enumerate(html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    folder = f"file:{tmp_path}/{split}"
    assert warc.write_warc(pages, folder) == len(rows)
    got = {r.page_id: r for r in warc.read_warc(spark, folder, split).collect()}
    assert len(got) == len(rows)
    for i, h in enumerate(html):
        data = (h or "").encode()
        revisit = i in (21, 26)
        assert (got[i].record_type, got[i].refers_to) == (("revisit", 20) if revisit else ("response", None))
        assert got[i].payload_bytes == len(data) and got[i].payload_digest == hashlib.sha256(data).hexdigest()
        assert got[i].payload == (None if revisit else data)


def test_magic_that_is_no_member_is_passed_over(tmp_path):
    record = b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    noise = b"\x1f\x8b\x08 not a member" + gzip.compress(b"no record")
    path = tmp_path / "x.warc.gz"
    path.write_bytes(noise + gzip.compress(record) + gzip.compress(record))
    with pa.OSFile(str(path)) as file:
        found = list(warc.records_in(file, 0, path.stat().st_size))
    assert [block for _, _, block in found] == [b"abc", b"abc"]


def test_no_pages(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.write_warc(none, str(tmp_path / "w")) == 0 and warc.read_warc(spark, str(tmp_path / "w")).count() == 0


# decontamination


def hits_by_rule(text, items, window=10):
    def words(t):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        return "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in low).split(" ")

    line = [w for w in words(text) if w]
    hit, named = set(), set()
    for item, t in items:
        own = [w for w in words(t) if w]
        size = min(window, len(own))
        grams = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own and item is not None else set()
        for i in range(len(line) - size + 1):
            if size and tuple(line[i : i + size]) in grams:
                hit.update(range(i, i + size))
                named.add(item)
    return len(line), hit, sorted(named)


@pytest.mark.parametrize("block", [60, 4 << 20])
def test_hits_as_by_rule(spark, block):
    draw = random.Random(7)
    items = [(i, " ".join(random_words(draw, draw.randrange(0, 25), 12))) for i in range(8)] + [(8, None), (None, "w1"), (9, "É où")]
    texts = [" ".join(random_words(draw, 80, 12)) for _ in range(6)] + [items[1][1].upper() + "!", "x É, où y", "é où", "", None, "w1"]
    docs = table(spark, texts, hits=["h"] * len(texts))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for row in decontaminate.scan(docs, bench, 3, block).collect():
        count, hit, named = hits_by_rule(row.row.text, items, 3)
        assert (row.n_words, row.item_ids) == (count, named)
        assert {w for h in row.hits for w in range(h.first, h.last + 1)} == hit
    found = {r.row.doc_id: r for r in decontaminate.scan(docs, bench, 3).collect()}
    cut = found[7].hits[0]
    assert texts[7][cut.begin : cut.end] == "É, où"


def test_no_items_hit_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.without_hits(table(spark, ["a b", None]), none).count() == 2


# neighbours


def test_neighbours_and_ties(spark):
    draw = np.random.default_rng(2)
    points = draw.normal(size=(900, 12)).astype(np.float32)
    points[100:160] = points[50]
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    rows += [(2000, None), (2001, [0.0] * 12), (2002, [float("nan")] * 12), (2003, [1.0, None]), (None, [1.0] * 12), (2004, [1.0, 2.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    index = neighbours.build_index(neighbours.usable(vectors), 5, shard_rows=300)
    got = {}
    for r in neighbours.search(index, neighbours.usable(vectors.filter("vec_id % 50 = 0")), 5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    unit = points.astype(np.float64) / np.linalg.norm(points.astype(np.float64), axis=1, keepdims=True)
    right = 0
    for q, found in got.items():
        score = unit @ unit[q]
        score[q] = -2
        best = np.lexsort((np.arange(900), -score.round(9)))[:5].tolist()
        found.sort()
        right += len(set(best) & {f[1] for f in found})
        assert [f[2] for f in found] == pytest.approx([score[f[1]] for f in found])
    assert right >= 0.9 * 5 * len(got) and len(got) == 18
    assert [f[1] for f in got[50]] == [100, 101, 102, 103, 104] and [f[1] for f in got[100]] == [50, 101, 102, 103, 104]
    assert neighbours.nearest(vectors.filter("false"), vectors, 5).count() == 0


# classifiers


def test_quality_learns_and_scores_whole_texts(spark):
    draw = random.Random(4)
    good = [" ".join(random_words(draw, draw.randrange(5, 300), 400)) for _ in range(120)]
    bad = [" | ".join(w.upper() + "!!" for w in random_words(draw, draw.randrange(5, 200), 400)) for _ in range(120)]
    docs = table(spark, good + bad + ["", None], score=["s"] * 242)
    rows = spark.createDataFrame([(i, int(i < 120)) for i in range(0, 240, 2)], "doc_id long, label int")
    found = {r.row.doc_id: r.score for r in quality.score(docs, quality.fit(docs, rows)).collect()}
    right = sum((found[i] >= 0.5) == (i < 120) for i in range(1, 240, 2))
    assert right >= 114 and found[240] == pytest.approx(found[241], abs=1e-6) and 0 <= found[240] <= 1
    assert quality.fit(docs, rows.filter("label = 1")) == 1.0 and quality.fit(docs, rows.filter("false")) == 0.5


def test_every_byte_of_a_long_text_counts():
    net = quality.Network.fresh(3)
    base = b"plain words " * 400
    scores = net.score(pa.array([base, base[:-12] + b"#!~%&*=#!~%&", base], pa.large_binary()))
    assert scores[0] == pytest.approx(scores[2], abs=1e-6) and abs(scores[0] - scores[1]) > 1e-5
    alone = [net.score(pa.array([t], pa.large_binary()))[0] for t in (base, b"", b"x" * 256, b"x" * 257)]
    assert net.score(pa.array([base, b"", b"x" * 256, b"x" * 257], pa.large_binary())) == pytest.approx(alone, rel=1e-5)


def test_toxicity_learns_character_grams(spark):
    draw = random.Random(6)
    clean = [" ".join(random_words(draw, draw.randrange(5, 60), 300)) for _ in range(150)]
    toxic = [" ".join([*random_words(draw, 30, 300), draw.choice(["Vilemonger", "vilemong"])]) for _ in range(50)]
    docs = table(spark, clean + toxic + ["", None], score=["s"] * 202)
    rows = spark.createDataFrame([(i, int(i >= 150)) for i in range(0, 200, 2)], "doc_id long, label int")
    model = toxicity.fit(docs, rows)
    found = {r.row.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all((found[i] >= 0.5) == (i >= 150) for i in range(1, 200, 2)) and found[200] == found[201] < 0.5
    assert toxicity.fit(docs, rows.filter("false")).score(pa.array([b"a"]))[0] == 0.5


def test_held_out_rows_and_disagreeing_labels(spark):
    labels = spark.createDataFrame([(i % 40, i // 40 if i % 40 == 7 else 1) for i in range(80)] + [(None, 1)], "doc_id long, quality int")
    rows = {r.doc_id for r in labelled.training(labels, "quality", 3, 1).collect()}
    assert rows == {i for i in range(40) if zlib.crc32(str(i).encode()) % 3 != 1} - {7}


# sharding


def jump_by_rule(key, shards):
    place, after = -1, 0
    while after < shards:
        place = after
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        after = int((place + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return place


def test_shards_move_only_into_the_new_one(spark):
    docs = table(spark, ["t"] * 3000 + [None], [*range(2999), 5, None], slot=["s"] * 3001)
    rows = sharding.into_shards(docs, 24).collect()
    keys = {r.doc_id: int(hashlib.md5(str("" if r.doc_id is None else r.doc_id).encode()).hexdigest()[:15], 16) for r in rows}
    assert all(r.shard == jump_by_rule(keys[r.doc_id], 24) and r.grown_shard in (r.shard, 24) for r in rows)
    assert 60 < sum(r.grown_shard == 24 for r in rows) < 200
    for shard in range(24):
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    assert sharding.into_shards(docs.filter("false"), 24).count() == 0


def test_shards_keep_columns_of_any_name(spark):
    names = ["_digest", "_place", "_cell", "_before", "_text", "digest", "place", "cell", "before", "row", "key"]
    docs = table(spark, ["a", None, "a"], [1, None, 1], slot=["s"] * 3, **{n: [n] * 3 for n in names})
    out = sharding.into_shards(docs, 4)
    own = [c for c in docs.columns if c != "slot"]
    assert out.columns == [*own, "shard", "slot", "grown_shard"]
    assert all(r[n] == n for r in out.collect() for n in names)


def test_rows_of_one_doc_id_are_spread_over_cells(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_CELL", 20)
    docs = table(spark, [f"t{i}" for i in range(300)], [None] * 200 + [7] * 100).repartition(5)
    rows = sharding.into_shards(docs, 3).collect()
    for shard in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    assert len({r.shard for r in rows if r.doc_id == 7}) == len({r.shard for r in rows if r.doc_id is None}) == 1


# Jaccard join


def components_by_rule(texts, size=5, percent=75):
    sets = {}
    for i, t in enumerate(texts):
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
        grams = {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} or ({tuple(words)} if words else set())
        sets[i] = grams
    name = {i: i for i in sets}
    for a, b in itertools.combinations(sets, 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= percent * len(sets[a] | sets[b]):
            low, high = sorted((name[a], name[b]))
            name = {k: low if v == high else v for k, v in name.items()}
    return {i: (len(sets[i]), name[i]) for i in sets}


def near_corpus():
    draw = random.Random(8)
    texts = corpus(9)
    for _ in range(6):
        base = random_words(draw, 70, 2000)
        for _ in range(8):
            copy = list(base)
            for at in draw.sample(range(70), draw.randrange(0, 4)):
                copy[at] = f"z{draw.randrange(10**6)}"
            texts.append(" ".join(copy))
    return texts


def test_components_as_by_rule(spark, monkeypatch):
    texts = near_corpus()
    want = components_by_rule(texts)
    docs = table(spark, texts, size=["s"] * len(texts)).repartition(4)
    for blocks in ((1 << 21, 4096), (300, 3)):
        monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", blocks[0])
        monkeypatch.setattr(jaccard, "BLOCK_SETS", blocks[1])
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.linked_documents(docs).collect()}
        assert got == want
    kept = {r.doc_id for r in jaccard.one_per_component(docs).collect()}
    assert kept == {i for i, (_, name) in want.items() if i == name}


def test_rows_without_id_or_rows_take_no_part(spark):
    same = "a b c d e f g"
    rows = jaccard.linked_documents(table(spark, [same, same, same], [None, 4, 4])).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in rows) == [(0, 3, 0), (4, 3, 4), (4, 3, 4)]
    assert jaccard.linked_documents(table(spark, [])).count() == 0


def test_one_per_component_keeps_columns_of_any_name(spark):
    docs = table(spark, ["a b c d e f g"] * 2 + ["x"], _k_doc_id=["k"] * 3, node=["n"] * 3, size=["s"] * 3)
    rows = jaccard.one_per_component(docs)
    assert rows.columns == docs.columns
    assert sorted((r.doc_id, r._k_doc_id, r.node) for r in rows.collect()) == [(0, "k", "n"), (2, "k", "n")]


def test_tree_connects_what_all_pairs_connect():
    draw = np.random.default_rng(11)
    sets = []
    for _ in range(12):
        base = np.unique(draw.integers(0, 1 << 53, 120).astype(np.uint64))
        for _ in range(7):
            part = base[draw.random(len(base)) > draw.choice([0.02, 0.1, 0.2])]
            sets.append(np.unique(np.append(part, draw.integers(0, 1 << 53, 5).astype(np.uint64))))
    tree = SignatureTree.over(sets, np.arange(len(sets)))
    name = list(range(len(sets)))

    def join(pairs):
        own = list(name)
        for a, b in pairs:
            low, high = sorted((own[a], own[b]))
            own = [low if x == high else x for x in own]
        return own

    linked = [p for p in itertools.combinations(range(len(sets)), 2) if len(np.intersect1d(sets[p[0]], sets[p[1]])) * 100 >= 75 * len(np.union1d(sets[p[0]], sets[p[1]]))]
    assert join(tree.links()) == join(linked)


@pytest.mark.parametrize("edges", [0, 10**6])
def test_graph_components_both_ways(spark, edges):
    draw = random.Random(12)
    pairs = [(draw.randrange(60), draw.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(20)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long"), edges).collect()}
    name = {n: n for p in pairs for n in p}
    for a, b in pairs:
        low, high = sorted((name[a], name[b]))
        name = {k: low if v == high else v for k, v in name.items()}
    assert got == {n: name[n] for p in pairs if p[0] != p[1] for n in p}
