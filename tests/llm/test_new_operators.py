"""Vector codes, packing and periodic runs against plain rules, with nulls, empty and long texts, repeats and clashes."""

import math
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from alertfold.deploy import ship
from alertfold.llm import packing, periodic_runs, vector_codes
from alertfold.llm.common_extension import CommonExtension
from alertfold.llm.cover_tree import grow, labels, sums

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def table(spark, texts, ids=None, **more):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, *(m[k] for m in more.values())) for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, "doc_id long, text string" + "".join(f", {name} string" for name in more))


# cover trees


def by_distance(points, centres):
    return ((points[:, :, None, :] - centres[:, None, :, :]) ** 2).sum(-1).argmin(-1)


@pytest.mark.parametrize("seed", range(12))
def test_subtrees_go_where_their_points_go(seed):
    draw = np.random.default_rng(seed)
    sets, size, width = draw.integers(1, 5), draw.integers(1, 300), draw.integers(1, 5)
    far = int(draw.choice([2, 20, 400]))
    points = draw.integers(-far, far + 1, (sets, size, width))
    centres = draw.integers(-far, far + 1, (sets, draw.integers(1, 20), width))
    forest = grow(points, leaf=int(draw.integers(1, 10)))
    want = by_distance(points, centres)
    assert (labels(forest, centres) == want.ravel()).all()
    total, count = sums(forest, centres)
    for s in range(sets):
        for c in range(centres.shape[1]):
            mine = want[s] == c
            assert count[s, c] == mine.sum() and (total[s, c] == points[s][mine].sum(0)).all()


def test_nodes_cover_their_points_and_split_them():
    points = np.random.default_rng(1).integers(-500, 500, (3, 700, 3))
    forest = grow(points, leaf=1)
    for v, (low, high) in enumerate(zip(forest.low, forest.high)):
        away = ((forest.points[low:high] - forest.points[low]) ** 2).sum(1)
        assert away.max() == forest.reach[v]
        below = range(forest.child[v], forest.child[v] + forest.children[v])
        assert not len(below) or [low, high] == [forest.low[below[0]], forest.high[below[-1]]]


def test_subtrees_are_assigned_without_their_points():
    draw = np.random.default_rng(2)
    middles = draw.integers(-(10**6), 10**6, (1, 8, 4))
    points = (middles[0][draw.integers(0, 8, 4000)] + draw.integers(-50, 50, (4000, 4)))[None]
    from alertfold.llm.cover_tree import assign

    whole, (places, _) = assign(grow(points), middles)
    assert len(places) == 0 and sum(len(nodes) for nodes, _ in whole) < 400


# vector codes


def codes_by_rule(rows, parts, entries, rounds):
    """rows of (key, vector): (key, code, error), and the codebooks."""
    kept = [(k, v) for k, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    whole = [[math.floor(256 * x) for x in v] for _, v in kept]
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in whole]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def nearest(piece, book):
        return min((sum((a - b) ** 2 for a, b in zip(piece, entry)), i) for i, entry in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            owners = [nearest(c[p], books[p])[1] for c in cut]
            for i in range(len(books[p])):
                mine = [c[p] for c, o in zip(cut, owners) if o == i]
                if mine:
                    books[p][i] = [sum(x) // len(mine) for x in zip(*mine)]
    out = []
    for (key, _), c in zip(kept, cut):
        found = [nearest(c[p], books[p]) for p in range(parts)]
        out.append((key, bytes(i for _, i in found), sum(d for d, _ in found)))
    return out, books


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, row string, code string")


@pytest.mark.parametrize("count", [3, 40, 200])
def test_codes_by_rule(spark, count):
    draw = random.Random(count)
    f32 = lambda: float(np.float32(draw.gauss(0, 1)))
    rows = [(draw.randrange(10**6), [f32() for _ in range(8)], "r", "c") for _ in range(count)]
    rows += [rows[0], (None, rows[1][1], None, None), (rows[0][0], rows[2][1], "r", "c")]
    rows += [(1, None, "r", "c"), (2, [], "r", "c"), (3, [None] * 8, "r", "c"), (4, [float("nan")] * 8, "r", "c")]
    rows += [(5, [float("-inf")] + [0.0] * 7, "r", "c"), (6, [0.0] * 8, "zero", "c")]
    coded, books = vector_codes.compress(vectors(spark, rows).repartition(3), parts=4, entries=16, chunk=32)
    want, want_books = codes_by_rule([r[:2] for r in rows], 4, 16, 2)
    got = [(r.row.vec_id, bytes(r.code), r.error) for r in coded.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert books.entries.tolist() == want_books
    assert {r.row.row for r in coded.collect()} >= {"r", "zero", None}


def test_no_vectors_give_no_codes(spark):
    coded, books = vector_codes.compress(vectors(spark, [(1, None, "a", "b")]))
    assert coded.count() == 0 and books.text() == "" and coded.columns == ["row", "code", "error"]


def test_vectors_that_do_not_fit_are_refused(spark):
    with pytest.raises(ValueError):
        vector_codes.compress(vectors(spark, [(1, [0.0] * 7, "a", "b")]), parts=4)
    with pytest.raises(Exception, match="below 65536"):
        vector_codes.compress(vectors(spark, [(1, [1e30] * 8, "a", "b")]), parts=4)


# packing


def packed(spark, docs, **options):
    rows = packing.pack(docs, VOCABULARY, **options).collect()
    return [(r.doc_id, r.start, r.length, bytes(r.ids), r.doc_tokens, r.sequence_id, r.offset) for r in rows]


def check_packing(rows, docs, capacity=1024, slack=16):
    """Every id once, sequences gapless, within capacity, and hardly padded."""
    tokenizer = Tokenizer.from_file(VOCABULARY)
    want = [(d, np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes()) for d, t in docs]
    ends, joined = {}, {}
    for doc, start, length, ids, total, _, _ in rows:
        assert len(ids) == 4 * length and length > 0
        joined.setdefault((doc, total), []).append((start, ids))
    for (doc, total), parts in joined.items():
        mine = [w for d, w in want if d == doc and len(w) == 4 * total]
        assert sorted(i for _, i in parts for i in np.frombuffer(i, "<u4").tolist()) == sorted(
            i for w in mine for i in np.frombuffer(w, "<u4").tolist()
        )
        if len(mine) == 1:
            assert b"".join(ids for _, ids in sorted(parts)) == mine[0]
    for _, _, length, _, _, sequence, offset in sorted(rows, key=lambda r: r[5:]):
        assert offset == ends.get(sequence, 0)
        ends[sequence] = offset + length
    for n in ends.values():
        assert n <= capacity and (n >= capacity - slack or n & (n - 1) == 0)
    assert sum(ends.values()) == sum(len(w) // 4 for _, w in want)
    return sum(capacity - n for n in ends.values() if n & (n - 1)) / sum(ends.values())


@pytest.mark.parametrize("tasks", [1, 3])
def test_every_id_lies_in_one_piece(spark, tasks):
    draw = random.Random(7)
    word = lambda: "".join(draw.choice("abcdeéß字  \n'") for _ in range(draw.randrange(1, 9)))
    texts = [" ".join(word() for _ in range(draw.randrange(0, 900))) for _ in range(150)]
    texts += [None, "", " ", "\n", "x" * 9000, " ".join(word() for _ in range(40_000)), "a <|endoftext|> b", "same", "same"]
    ids = [*range(len(texts) - 4), None, None, 3, 3]
    docs = table(spark, texts, ids, length=["l"] * len(texts), offset=["o"] * len(texts)).repartition(tasks)
    padding = check_packing(packed(spark, docs), list(zip(ids, texts)))
    assert padding < 0.01


def test_small_capacities_and_empty_tables(spark):
    docs = table(spark, ["one two three four five", "", None, "six"])
    check_packing(packed(spark, docs, capacity=8, slack=0), list(enumerate(["one two three four five", "", None, "six"])), 8, 0)
    assert packed(spark, docs.limit(0)) == []
    with pytest.raises(ValueError):
        packing.pack(docs, VOCABULARY, capacity=1000)


def test_classes_hold_a_fixed_number_of_pieces():
    for length in range(1, 3000):
        cut = packing.piece_lengths(length)
        assert sum(cut) == length and len(cut) <= length // 1024 + 4
        assert all(1024 - (1024 // n) * n <= 16 for n in cut)


@pytest.mark.parametrize("seed", range(4))
def test_segments_and_both_encoders_keep_the_ids(seed, monkeypatch):
    monkeypatch.setattr(packing, "SEGMENT", 10)
    draw = random.Random(seed)
    marks = list(" \t\nab12!'éß") + ["  ", "'s", "'LL", "\x00", "\x1c", "\x7f", "\x0b", "À", "÷", "ÿ", "a" * 300, " " * 300, " ", " ", " "]
    if seed % 2:
        marks += ["字", "한", "\u00a0", "\u2003", "\u3000", "\u0085", "\u2028", "\u200b", "\ufeff", "<|endoftext|>", "Ѐ", "ʰ", "😀", "²"]
    texts = ["".join(draw.choice(marks) for _ in range(draw.randrange(0, 30))) for _ in range(1500)]
    with open(VOCABULARY, encoding="utf-8") as file:
        tokens = packing.Tokens(file.read())
    assert sum(map(tokens._fast, texts)) > 20
    for text, found in zip(texts, tokens.tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert tokens.ids(text).tolist() == [*found.ids, 0]


def test_another_tokenizer_has_no_second_encoder():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        tokens = packing.Tokens(file.read())
    assert tokens.ranked is None
    assert tokens.ids("Two words").tolist() == [*tokens.tokenizer.encode("Two words", add_special_tokens=False).ids, 0]


# periodic runs


def runs_by_rule(words, least):
    best = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                best.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(5))
def test_common_extensions(seed):
    draw = np.random.default_rng(seed)
    symbols = np.append(draw.integers(0, draw.integers(1, 4), draw.integers(1, 200)) + 1, 0)
    i = draw.integers(0, len(symbols), 500)
    j = draw.integers(0, len(symbols), 500)
    i, j = np.minimum(i, j)[i != j], np.maximum(i, j)[i != j]
    if not len(i):
        return
    for a, b, n in zip(i, j, CommonExtension(symbols).lengths(i, j)):
        assert (symbols[a : a + n] == symbols[b : b + n]).all() and (symbols[a + n] != symbols[b + n])


def collapsed_by_rule(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_by_rule(spark):
    draw = random.Random(11)
    texts = []
    for _ in range(120):
        words = [f"w{draw.randrange(draw.choice([1, 2, 3, 50]))}" for _ in range(draw.randrange(0, 90))]
        if len(words) > 12 and draw.random() < 0.6:
            at = draw.randrange(len(words))
            period = 1 + (len(words) - at) // draw.randrange(2, 7)
            words = [w if i < at else words[at + (i - at) % period] for i, w in enumerate(words)]
        texts.append("\t".join(words))
    texts += [None, "", "  \n ", "a" * 5000, " ".join(["x", "y"] * 8000), " ".join(f"v{i}" for i in range(20_000))]
    texts += [texts[0], texts[0]]
    ids = [*range(len(texts) - 2), None, 3]
    docs = table(spark, texts, ids, runs=["r"] * len(texts), row=["x"] * len(texts)).repartition(3)
    got = {}
    for r in periodic_runs.find_runs(docs).collect():
        key = (r.row.doc_id, r.row.text)
        got.setdefault(key, []).append((r.n_words, [tuple(x) for x in r.runs], r.collapsed))
        assert r.row.runs == "r"
    found = 0
    for doc, text in zip(ids, texts):
        words = (text or "").split()
        runs = runs_by_rule(words, 12) if len(words) < 17_000 else []
        want = (len(words), runs, collapsed_by_rule(words, runs))
        assert got[doc, text].count(want) == len(got[doc, text])
        found += len(runs)
    assert found > 40 and sum(map(len, got.values())) == len(texts)


def test_no_documents_give_no_runs(spark):
    assert periodic_runs.find_runs(table(spark, ["a"]).limit(0)).count() == 0


def test_words_are_compared_themselves(spark):
    """Equal hashes would not do: every word is looked at whole."""
    long = "z" * 300
    text = " ".join([long + "a", long + "b"] * 8 + [long + "c"])
    (row,) = periodic_runs.find_runs(table(spark, [text])).collect()
    assert [tuple(r) for r in row.runs] == [(0, 16, 2)] and row.collapsed == f"{long}a {long}b {long}c"


def test_planted_repetition_of_the_query(spark):
    from alertfold.llm.queries import _planted

    texts = {i: " ".join(f"t{i}w{k}" for k in range(i % 40)) for i in range(300)}
    texts |= {1000: None, 1001: ""}
    rows = {r.doc_id: r.text for r in _planted(table(spark, list(texts.values()), list(texts))).collect()}
    for doc, text in texts.items():
        words = (text or "").split()
        h, n = zlib.crc32(str(doc).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        assert (rows[doc] or "").split() == words
