"""Queries that SQL cannot say, over the whole smallest tables, against a plain version written from the rules.

Nothing here uses the library's own distances, scripts, folds, templates or decisions.
"""

import os
import re
from collections import defaultdict
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from alertfold.functions.script import edit_script, fold_template
from alertfold.operators.folding import fold_groups
from alertfold.operators.similarity import similarity_pairs
from alertfold_checks import queries as registry
from alertfold_checks.inputs import Inputs

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")
DAY = 86_400
EPOCH = datetime(1970, 1, 1)


# distances and scripts, row by row


def last_row(a, b):
    """Edit distance between every prefix of ``a`` and the whole of ``b``."""
    left = np.frombuffer(a.encode("utf-32-le"), np.uint32)
    steps = np.arange(len(a) + 1)
    row = steps.copy()
    for char in np.frombuffer(b.encode("utf-32-le"), np.uint32):
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (left != char))
        row = np.minimum.accumulate(new - steps) + steps
    return row


def byte_distance(a, b):
    x, y = (t.encode().decode("latin-1") for t in (a, b))
    return int(last_row(x, y)[-1])


def ratio(a, b, bound):
    """By the longer text in bytes; None if it cannot lie within the bound."""
    small, large = sorted((len(a.encode()), len(b.encode())))
    if large == 0 or (large - small) / large > bound:
        return None
    return 0.0 if a == b else byte_distance(a, b) / large


def script(a, b):
    """The shorter text is turned into the longer one, which is halved down to single characters."""
    if len(a) > len(b):
        return aligned(b, a).replace("+", "x").replace("-", "+").replace("x", "-")
    return aligned(a, b)


def aligned(a, b):
    if a == b:
        return "=" * len(a)
    if not a:
        return "+" * len(b)
    if len(b) == 1:
        at = a.rfind(b)
        return "-" * (len(a) - 1) + "!" if at < 0 else "-" * at + "=" + "-" * (len(a) - 1 - at)
    half = len(b) // 2
    total = last_row(a, b[:half]) + last_row(a[::-1], b[half:][::-1])[::-1]
    cut = int(np.argmin(total))
    return aligned(a[:cut], b[:half]) + aligned(a[cut:], b[half:])


def fold(template, text):
    kept = iter(template)
    out = ""
    for op in script(template, text):
        char = "" if op == "+" else next(kept)
        out += char if op == "=" else "?"
    return out


def fold_all(texts):
    out = texts[0]
    for text in texts[1:]:
        out = fold(out, text)
    return out


def fits(template, text):
    parts = re.findall(r"\?+|[^?]+", template)
    body = "".join(r"(?:[0-9]+|[\s\S]{0,%d})" % len(p) if p[0] == "?" else re.escape(p) for p in parts)
    return re.fullmatch(body, text) is not None


def touches(head, text):
    kept = iter(head)
    return any(op != "+" and not next(kept).isascii() and op in "-!" for op in script(head, text))


# boxes and groups


def boxes(messages):
    """Lists of (seq, text) by (chat, tick, box)."""
    ticks = defaultdict(list)
    for chat, ts, seq, text in messages:
        second = int(ts.timestamp() if ts.tzinfo else (ts - EPOCH).total_seconds())
        ticks[chat, second // DAY * DAY].append((ts, seq, text))
    out = {}
    for (chat, tick), rows in ticks.items():
        for n, (_, seq, text) in enumerate(sorted(rows, key=lambda r: r[:2])):
            out.setdefault((chat, tick, n // 50), []).append((seq, text))
    return out


def roots(texts, accuracy, spread):
    heads = []
    for j, text in enumerate(texts):
        held = None
        for i in range(j):
            d = ratio(texts[i], text, accuracy)
            if d is not None and d < accuracy and (held is None or held[1] - d > spread):
                held = (i, d)
        heads.append(held)
    out = []
    for j, held in enumerate(heads):
        members = [d for h in heads if h and h[0] == j for d in [h[1]]]
        alone = held is None or (members and held[1] - min(members) >= spread)
        out.append(j if alone else out[held[0]])
    return out


def sent_by_rule(box, accuracy, spread=0.1, min_approx=5):
    """(text, is_group, pattern, cnt) in the order of sending."""
    if len(box) <= min_approx:
        return [(text, False, None, 1) for _, text in box]
    texts = [t for _, t in box]
    groups = defaultdict(list)
    for j, root in enumerate(roots(texts, accuracy, spread)):
        groups[root].append(texts[j])
    out = [(g[0], False, None, 1) for g in groups.values() if len(g) == 1]
    for root in sorted(groups):
        if len(groups[root]) > 1:
            template, n = fold_all(groups[root]), len(groups[root])
            out.append((f"{n} similar messages were received:\n{template}", True, template, n))
    return out


@pytest.fixture(scope="module")
def inputs(spark):
    return Inputs(spark, SF_DIR)


def messages_of(frame):
    return [tuple(r) for r in frame.select("chat_id", "ts", "seq", "text").collect()]


def muted(log, chat, ts):
    for scope in (str(chat), "*"):
        known = [(at, seq, m) for at, seq, s, m in log if s == scope and at <= ts]
        if known and max(known)[2]:
            return True
    return False


def test_compact(inputs):
    log = [tuple(r) for r in inputs.mute_log.select("ts", "seq", "scope", "muted").collect()]
    messages = messages_of(inputs.alerts)
    silent = {seq for chat, ts, seq, _ in messages if muted(log, chat, ts)}
    want = set()
    for key, box in boxes(messages).items():
        heard = [m for m in box if m[0] not in silent]
        want |= {(*key, n, *row) for n, row in enumerate(sent_by_rule(heard, 0.4))}
    rows = registry.compact(inputs).select("chat_id", "tick", "box", "seq", "text", "is_group", "pattern", "cnt").collect()
    assert len(rows) == len(want) > 300 and {tuple(r) for r in rows} == want
    assert any(r.cnt > 2 for r in rows) and silent


def test_fold_groups(inputs):
    want = set()
    for key, box in boxes(messages_of(inputs.alerts)).items():
        texts = [t for _, t in box]
        groups = defaultdict(list)
        for j, root in enumerate(roots(texts, 0.1, 0.1)):
            groups[root].append(texts[j])
        want |= {(*key, box[r][0], len(g), fold_all(g)) for r, g in groups.items() if len(g) > 1}
    folded = fold_groups(registry.boxed_alerts(inputs), registry.NEAR)
    rows = folded.select("chat_id", "tick", "box", "root_seq", "cnt", "template").collect()
    assert {tuple(r) for r in rows} == want and len(rows) == len(want) > 20


def test_compact_notes_and_multibyte_guard(inputs):
    """Whole documents: long texts, near copies, characters of several bytes."""
    want, guarded = set(), set()
    for key, box in boxes(messages_of(inputs.notes)).items():
        want |= {(*key, n, *row) for n, row in enumerate(sent_by_rule(box, 0.1))}
        for j, (member, text) in enumerate(box):
            for head, other in box[:j]:
                d = ratio(other, text, 0.1)
                if d is not None and d < 0.1 and not touches(other, text):
                    guarded.add((*key, head, member, d))
    rows = registry.compact_notes(inputs).select("chat_id", "tick", "box", "out_pos", "text", "is_group", "pattern", "cnt")
    assert {tuple(r) for r in rows.collect()} == want
    pairs = registry.multibyte_guard(inputs).select("chat_id", "tick", "box", "head_seq", "member_seq", "dist").collect()
    assert {tuple(r) for r in pairs} == guarded and guarded


def test_edit_scripts(inputs):
    """Every script between near alerts, not just its cost."""
    near = similarity_pairs(registry.boxed_alerts(inputs), 0.1)
    texts = inputs.alerts.select("seq", "text")
    both = near.join(texts.select(F.col("seq").alias("head_seq"), F.col("text").alias("a")), "head_seq").join(
        texts.select(F.col("seq").alias("member_seq"), F.col("text").alias("b")), "member_seq"
    )
    rows = both.select("a", "b", edit_script("a", "b").alias("ops")).collect()
    assert rows and all(r.ops == script(r.a, r.b) for r in rows)


def test_merged_templates(inputs):
    rows = inputs.template_pairs.select("a", "b", fold_template(F.array("a", "b")).alias("merged")).collect()
    assert rows and all(r.merged == fold(r.a, r.b) for r in rows)


def online_by_rule(messages, accuracy=0.4, spread=0.1, count=20, minutes=60):
    """Outbox rows of all messages, one after the other."""
    out, histories, last = [], defaultdict(list), defaultdict(int)
    for chat, ts, seq, text in sorted(messages, key=lambda m: (m[1], m[2])):
        history = histories[chat]  # (id, text, ts, pattern, cnt), oldest first
        seen = [e for e in reversed(history) if (ts - e[2]).total_seconds() < 60 * (minutes + 1)][:count]
        groups, singles = [e for e in seen if e[3]], [e for e in seen if not e[3]]
        pattern, cnt, gone = None, 1, []
        hits = [g for g in groups if fits(g[3], text)]
        wide = [g for g in groups if (r := ratio(g[3], text, accuracy)) is not None and r <= accuracy]
        if hits:
            pattern = hits[0][3]
            gone = [g for g in hits if fits(pattern, g[3]) and fits(g[3], pattern)]
            cnt = 1 + sum(g[4] for g in gone)
        elif wide:
            pattern, cnt, gone = fold(wide[0][3], text), wide[0][4] + 1, wide[:1]
        else:
            texts = [text, *(e[1] for e in singles)]
            members = defaultdict(list)
            for j, root in enumerate(roots(texts, accuracy, spread)):
                members[root].append(j)
            for places in members.values():
                template = fold_all([texts[j] for j in places])
                others = [singles[j - 1] for j in places if j]
                if len(places) > 1 and fits(template, text) and len(others) + 1 > cnt:
                    pattern, cnt, gone = template, len(others) + 1, others
        last[chat] += 1
        shown = text if pattern is None else f"{pattern}\n\nSimilar messages received: {cnt}"
        out += [(chat, seq, "DELETE", e[0], None, None, None, None) for e in gone]
        out.append((chat, seq, "SEND", last[chat], shown, pattern is not None, pattern, cnt))
        histories[chat] = [e for e in history if e not in gone] + [(last[chat], shown, ts, pattern, cnt)]
    return out


def test_compact_stream(inputs):
    """Every decision of the online rule, deletions included."""
    want = online_by_rule(messages_of(inputs.alerts))
    rows = [tuple(r) for r in registry.compact_stream(inputs).collect()]
    assert sorted(rows, key=repr) == sorted(want, key=repr)
    assert sum(r[2] == "DELETE" for r in rows) > 50
