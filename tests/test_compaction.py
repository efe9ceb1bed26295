import random

import pytest
from pyspark.sql import functions as F

from alertfold.functions.script import fold_texts, touches_multibyte
from alertfold.functions.templates import text_matches
from alertfold.operators.boxes import assign_boxes, batch_gate
from alertfold.operators.folding import compact, fold_groups, to_outbox
from alertfold.operators.grouping import assign_heads, group_sizes, resolve_roots, singles
from alertfold.operators.similarity import multibyte_guard, similarity_pairs
from alertfold.options import Options
from alertfold.streaming.rules import byte_ratio, group_roots

OPTS = Options(wait=3600, min_approx=2)


def texts(df):
    return [r.text for r in df.orderBy("chat_id", "tick", "box", "out_pos").collect()]


def test_three_numbers(messages_of):
    rows = messages_of([(1, 0, "disk 91 full"), (1, 1, "disk 95 full"), (1, 2, "disk 7 full")])
    (sent,) = compact(rows, OPTS).collect()
    assert (sent.cnt, sent.pattern, sent.is_group, sent.seq) == (3, "disk ?? full", True, 0)
    assert sent.text == "3 similar messages were received:\ndisk ?? full"


def test_singles_come_first_then_groups(messages_of):
    rows = messages_of([(1, 0, "disk 1"), (1, 1, "nothing alike at all"), (1, 2, "disk 2"), (1, 3, "")])
    sent = compact(rows, OPTS)
    assert texts(sent) == ["nothing alike at all", "", "2 similar messages were received:\ndisk ?"]
    outbox = to_outbox(sent).collect()
    assert {r.action for r in outbox} == {"SEND"} and len(outbox) == 3


def test_small_boxes_pass_unchanged(messages_of):
    rows = messages_of([(1, 0, "disk 1"), (1, 1, "disk 2"), (2, 0, "disk 1")])
    assert texts(compact(rows, OPTS)) == ["disk 1", "disk 2", "disk 1"]
    gates = batch_gate(assign_boxes(rows, 3600), 1).select("chat_id", "compacted").distinct().collect()
    assert {tuple(r) for r in gates} == {(1, True), (2, False)}


def test_equal_and_empty_texts(messages_of):
    rows = messages_of([(1, 0, "a b c d"), (1, 1, "a b c d"), (1, 2, ""), (1, 3, "x"), (1, 4, "")])
    sent = compact(rows, OPTS)
    assert texts(sent) == ["", "x", "", "2 similar messages were received:\na b c d"]


def test_threshold_is_strict_unless_inclusive(messages_of):
    boxed = assign_boxes(messages_of([(1, 0, "abcde"), (1, 1, "abcxy")]), 3600)
    assert similarity_pairs(boxed, 0.4).count() == 0
    (pair,) = similarity_pairs(boxed, 0.4, inclusive=True).collect()
    assert (pair.lev, pair.dist) == (2, 0.4)


def test_left_norm_is_directed(messages_of):
    boxed = assign_boxes(messages_of([(1, 0, "abcd"), (1, 1, "abcdefg")]), 3600)
    pairs = similarity_pairs(boxed, 0.5, norm="left").collect()
    assert [(p.head_seq, p.member_seq) for p in pairs] == [(1, 0)]


def test_guard_keeps_pairs_that_leave_multibyte_alone(messages_of):
    rows = [(1, 0, "été: 1 degré"), (1, 1, "été: 2 degré"), (1, 2, "eté: 2 degré")]
    boxed = assign_boxes(messages_of(rows), 3600)
    pairs = {(p.head_seq, p.member_seq) for p in multibyte_guard(boxed, 0.4).collect()}
    assert pairs == {(0, 1)}
    guarded = Options(wait=3600, min_approx=2, dont_approximate_multibyte=True)
    assert texts(compact(messages_of(rows), guarded)) == [
        "eté: 2 degré",
        "2 similar messages were received:\nété: ? degré",
    ]


def test_ascii_boxes_are_untouched_by_the_guard(messages_of):
    rows = messages_of([(1, 0, "disk 1 full"), (1, 1, "disk 2 full"), (1, 2, "disk 3 full")])
    guarded = Options(wait=3600, min_approx=2, dont_approximate_multibyte=True)
    assert texts(compact(rows, guarded)) == texts(compact(rows, OPTS))


def test_boxes_cut_in_arrival_order_and_lose_nothing(messages_of):
    rows = messages_of([(1, i % 7, f"m{i}") for i in range(120)])
    boxed = assign_boxes(rows, wait=3600, max_messages=50).collect()
    ordered = sorted(boxed, key=lambda r: (r.ts, r.seq))
    assert [(r.box, r.pos) for r in ordered] == [(i // 50, i % 50) for i in range(120)]


def test_instants_and_plain_timestamps_fall_into_the_same_boxes(messages_of):
    rows = messages_of([(1, 100 * i, f"m{i}") for i in range(90)])
    plain = {(r.seq, r.tick, r.box, r.pos) for r in assign_boxes(rows, 3600).collect()}
    instants = rows.withColumn("ts", F.col("ts").cast("timestamp"))  # the session is in UTC
    assert {(r.seq, r.tick, r.box, r.pos) for r in assign_boxes(instants, 3600).collect()} == plain


@pytest.fixture(scope="module")
def crowd(messages_of):
    rng = random.Random(3)
    words = ["disk", "full", "été", "load", "host"]

    def text():
        return " ".join(rng.choice(words) for _ in range(rng.randrange(1, 4))) + f" {rng.randrange(30)}"

    rows = [(0 if rng.random() < 0.4 else rng.randrange(1, 9), rng.randrange(7200), text()) for _ in range(900)]
    return messages_of(rows)


@pytest.mark.parametrize("accuracy, guard", [(0.1, False), (0.4, False), (0.4, True)])
def test_groups_follow_the_rule_of_one_box(crowd, accuracy, guard):
    opts = Options(wait=3600, accuracy=accuracy, max_messages=20, dont_approximate_multibyte=guard)
    boxed = assign_boxes(crowd, opts.wait, opts.max_messages)
    boxes = {}
    for r in boxed.collect():
        boxes.setdefault((r.chat_id, r.tick, r.box), []).append(r)
    want = set()
    for members in boxes.values():
        members.sort(key=lambda r: r.pos)
        for r, root in zip(members, group_roots([m.text for m in members], opts)):
            want.add((r.seq, members[root].seq))
    roots = resolve_roots(boxed, opts)
    assert {(r.seq, r.root_seq) for r in roots.collect()} == want
    counted = group_sizes(boxed, opts).agg(F.sum("cnt")).first()[0]
    assert counted + singles(boxed, opts).count() == 900


@pytest.mark.parametrize("spread", [0.0, 0.1, 0.3])
@pytest.mark.parametrize("guard", [False, True])
def test_copies_follow_the_rule_of_one_box(messages_of, spread, guard):
    rng = random.Random(int(spread * 10) + guard)
    texts = ["aaaaaaaaaa", "aaaaaaaaab", "aaaaaaaabb", "aaaaaaabbb", "aaaaaabbbb", "éaaaaaaaaa", "eaaaaaaaaa", ""]
    rows = messages_of([(box, i, rng.choice(texts)) for box in range(60) for i in range(12)])
    opts = Options(wait=3600, accuracy=0.45, spread=spread, dont_approximate_multibyte=guard)
    boxed = assign_boxes(rows, opts.wait)
    boxes = {}
    for r in boxed.collect():
        boxes.setdefault(r.chat_id, []).append(r)
    want = set()
    for members in boxes.values():
        members.sort(key=lambda r: r.pos)
        for r, root in zip(members, group_roots([m.text for m in members], opts)):
            want.add((r.seq, members[root].seq))
    assert {(r.seq, r.root_seq) for r in resolve_roots(boxed, opts).collect()} == want


def test_pairs_equal_all_pairs_tried(crowd):
    boxed = assign_boxes(crowd, 3600, 20)
    rows = boxed.collect()
    want = {
        (a.seq, b.seq)
        for a in rows
        for b in rows
        if (a.chat_id, a.tick, a.box) == (b.chat_id, b.tick, b.box)
        and a.pos < b.pos
        and byte_ratio(a.text, b.text) < 0.3
    }
    assert {(p.head_seq, p.member_seq) for p in similarity_pairs(boxed, 0.3).collect()} == want


def test_guarded_pairs_equal_all_pairs_tried(crowd):
    boxed = assign_boxes(crowd, 3600, 20)
    rows = boxed.collect()
    want = {
        (a.seq, b.seq)
        for a in rows
        for b in rows
        if (a.chat_id, a.tick, a.box) == (b.chat_id, b.tick, b.box)
        and a.pos < b.pos
        and byte_ratio(a.text, b.text) < 0.4
        and not touches_multibyte(a.text, b.text)
    }
    assert {(p.head_seq, p.member_seq) for p in multibyte_guard(boxed, 0.4).collect()} == want


@pytest.mark.parametrize("guard", [False, True])
def test_whole_compaction_by_hand(crowd, guard):
    opts = Options(wait=3600, max_messages=20, min_approx=8, dont_approximate_multibyte=guard)
    boxes = {}
    for r in assign_boxes(crowd, opts.wait, opts.max_messages).collect():
        boxes.setdefault((r.chat_id, r.tick, r.box), []).append(r)
    want = []
    for key, members in boxes.items():
        texts = [r.text for r in sorted(members, key=lambda r: r.pos)]
        sent = list(texts)
        if len(texts) > opts.min_approx:
            groups = {}
            for text, root in zip(texts, group_roots(texts, opts)):
                groups.setdefault(root, []).append(text)
            sent = [g[0] for g in groups.values() if len(g) == 1]
            sent += [
                f"{len(g)} similar messages were received:\n{fold_texts(g)}" for g in groups.values() if len(g) > 1
            ]
        want += [(*key, place, text) for place, text in enumerate(sent)]
    got = compact(crowd, opts).select("chat_id", "tick", "box", "out_pos", "text").collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_templates_cover_their_groups(crowd):
    for row in fold_groups(assign_boxes(crowd, 3600), Options(wait=3600)).collect():
        assert len(row.texts) == row.cnt
        assert all(text_matches(row.template, t) for t in row.texts)


def test_result_does_not_depend_on_partitions_or_hot_keys(crowd):
    opts = Options(wait=3600, accuracy=0.3)
    key = lambda df: sorted(tuple(r) for r in df.collect())
    plain = key(compact(crowd, opts).drop("pattern"))
    assert key(compact(crowd.repartition(7, "seq"), opts).drop("pattern")) == plain
    assert key(compact(crowd, opts, hot_rows=40).drop("pattern")) == plain


def test_heads_move_only_for_clearly_nearer_ones(messages_of):
    alike = assign_boxes(messages_of([(1, 0, "abcdefghij"), (1, 1, "abcdefghxy"), (1, 2, "abcdefghxj")]), 3600)
    heads = {(r.member_seq, r.head_seq) for r in assign_heads(alike, Options(wait=3600)).collect()}
    assert heads == {(1, 0), (2, 0)}
    nearer = assign_boxes(messages_of([(1, 0, "abcdefghij"), (1, 1, "abcdefgxyz"), (1, 2, "abcdefgxyz")]), 3600)
    heads = {(r.member_seq, r.head_seq) for r in assign_heads(nearer, Options(wait=3600)).collect()}
    assert heads == {(1, 0), (2, 1)}


def test_chains_are_cut_where_a_head_is_nearer_to_its_members(messages_of):
    rows = messages_of([(1, 0, "abcdefghij"), (1, 1, "abcdefgxyz"), (1, 2, "abcdefgxyz")])
    cut = {(r.seq, r.root_seq) for r in resolve_roots(assign_boxes(rows, 3600), Options(wait=3600)).collect()}
    assert cut == {(0, 0), (1, 1), (2, 1)}
    wide = Options(wait=3600, spread=0.35)
    kept = {(r.seq, r.root_seq) for r in resolve_roots(assign_boxes(rows, 3600), wide).collect()}
    assert kept == {(0, 0), (1, 0), (2, 0)}


def test_options_are_checked():
    with pytest.raises(ValueError):
        Options(accuracy=1.5)
    with pytest.raises(ValueError):
        Options(max_messages=0)
