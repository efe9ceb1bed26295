"""The rule online compaction applies to one message. At most one message and its recent history at a time.

Grouping follows the same rules as ``operators.grouping``; tests hold both against each other.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from alertfold.functions.script import edit_distance, fold_pair, fold_texts, touches_multibyte
from alertfold.functions.templates import text_matches
from alertfold.options import Options


@dataclass(frozen=True)
class Entry:
    """One message of the history, as it was sent."""

    message_id: int
    text: str
    micros: int
    pattern: str | None = None  # set for groups
    cnt: int = 1

    def age_minutes(self, micros: int) -> int:
        return (micros - self.micros) // 60_000_000


@dataclass
class Decision:
    """What to send, and which sent messages it replaces."""

    text: str
    pattern: str | None = None
    cnt: int = 1
    replaces: list[int] = field(default_factory=list)


def byte_ratio(a: str, b: str, bound: float = 1.0) -> float:
    """Edit distance in bytes by the longer length; 1 for two empty texts, or once above the bound."""
    x, y = a.encode().decode("latin-1"), b.encode().decode("latin-1")
    longer = max(len(x), len(y))
    if longer == 0 or abs(len(x) - len(y)) / longer > bound:
        return 1.0
    return edit_distance(x, y) / longer


def group_roots(texts: Sequence[str], opts: Options) -> list[int]:
    """Root of each text, for texts in order of arrival."""
    links: list[tuple[int, float] | None] = []
    for j, text in enumerate(texts):
        held: tuple[int, float] | None = None
        for i in range(j):
            dist = byte_ratio(texts[i], text, opts.accuracy)
            if dist >= opts.accuracy or (opts.dont_approximate_multibyte and touches_multibyte(texts[i], text)):
                continue
            if held is None or held[1] - dist > opts.spread:
                held = (i, dist)
        links.append(held)
    nearest: dict[int, float] = {}
    for link in links:
        if link:
            nearest[link[0]] = min(link[1], nearest.get(link[0], 2.0))
    roots: list[int] = []
    for j, link in enumerate(links):
        stays = link is not None and (j not in nearest or link[1] - nearest[j] < opts.spread)
        roots.append(roots[link[0]] if stays else j)
    return roots


def recent(history: Sequence[Entry], micros: int, opts: Options) -> list[Entry]:
    """Newest entries first, up to the count, without those too far away in time.

    ``history`` is in time order. For a message that comes late, entries may be younger than itself; they count
    by the same distance.
    """
    return nearby(reversed(history), micros, opts)


def nearby(newest_first: Iterable[Entry], micros: int, opts: Options) -> list[Entry]:
    """The same of entries that come newest first; no more are taken than needed."""
    found: list[Entry] = []
    for entry in newest_first:
        if len(found) == opts.history_check_count:
            break
        if max(entry.age_minutes(micros), (entry.micros - micros) // 60_000_000) <= opts.history_max_age_minutes:
            found.append(entry)
    return found


def _join_known(text: str, groups: Sequence[Entry]) -> Decision | None:
    hits = [g for g in groups if text_matches(g.pattern, text)]
    if not hits:
        return None
    base = hits[0].pattern
    same = [g for g in hits if text_matches(base, g.pattern) and text_matches(g.pattern, base)]
    return Decision(text, base, 1 + sum(g.cnt for g in same), [g.message_id for g in same])


def _widen_known(text: str, groups: Sequence[Entry], opts: Options) -> Decision | None:
    for g in groups:
        if byte_ratio(g.pattern, text, opts.accuracy) <= opts.accuracy:
            return Decision(text, fold_pair(g.pattern, text), g.cnt + 1, [g.message_id])
    return None


def _new_group(text: str, alone: Sequence[Entry], opts: Options) -> Decision | None:
    texts = [text, *[e.text for e in alone]]
    members: dict[int, list[int]] = {}
    for i, root in enumerate(group_roots(texts, opts)):
        members.setdefault(root, []).append(i)
    best: Decision | None = None
    for group in members.values():
        if len(group) < 2:
            continue
        pattern = fold_texts(texts[i] for i in group)
        if text_matches(pattern, text):
            replaced = [alone[i - 1].message_id for i in group if i > 0]
            if best is None or len(replaced) + 1 > best.cnt:
                best = Decision(text, pattern, len(replaced) + 1, replaced)
    return best


def decide(text: str, seen: Sequence[Entry], opts: Options) -> Decision:
    """Join a known group, else widen one, else form one with recent single messages, else go alone."""
    groups = [e for e in seen if e.pattern]
    alone = [e for e in seen if e.pattern is None]
    return (
        _join_known(text, groups)
        or _widen_known(text, groups, opts)
        or _new_group(text, alone, opts)
        or Decision(text)
    )
