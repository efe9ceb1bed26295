"""Edit scripts and template folding: the part built-in expressions cannot say.

Scripts are strings over ``+ - = !`` (insert, delete, keep, substitute) that turn one text into another at
minimal cost. Which minimal script is taken is fixed: cut the longer text in half, cut the shorter one at
the first cheapest place, and go on until a single character is left; that one is matched with its last
occurrence, else it replaces the last character.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SWAPPED = str.maketrans("+-", "-+")
_SHORT = 256  # characters, of texts whose scripts are kept


def prefix_costs(a: str, b: str) -> list[int]:
    """Edit distance between each prefix of ``a`` and the whole of ``b``, in bit-parallel steps.

    One big integer holds where the cost rises by one along ``a``, another where it falls.
    """
    full = (1 << len(a)) - 1
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | (1 << i)
    rise, fall = full, 0
    for c in b:
        equal = places.get(c, 0)
        diagonal = (((equal & rise) + rise) ^ rise) | equal | fall
        up = fall | ~(diagonal | rise)
        down = rise & diagonal
        up = (up << 1) | 1
        down <<= 1
        rise = (down | ~(diagonal | up)) & full
        fall = up & diagonal & full
    cost = len(b)
    costs = [cost]
    for _ in a:
        cost += (rise & 1) - (fall & 1)
        costs.append(cost)
        rise >>= 1
        fall >>= 1
    return costs


def edit_distance(a: str, b: str) -> int:
    """Plain edit distance in characters."""
    return 0 if a == b else prefix_costs(a, b)[-1]


def _first_cheapest_cut(a: str, left: str, right: str) -> int:
    before = prefix_costs(a, left)
    behind = prefix_costs(a[::-1], right[::-1])[::-1]
    total = [x + y for x, y in zip(before, behind)]
    return total.index(min(total))


def _single(piece: str, char: str) -> str:
    """Script from ``piece`` (not empty) to one character."""
    at = piece.rfind(char)
    if at < 0:
        return "-" * (len(piece) - 1) + "!"
    return "-" * at + "=" + "-" * (len(piece) - at - 1)


def script(a: str, b: str) -> str:
    """The edit script from ``a`` to ``b``.

    It depends only on which characters of one text equal which of the other, so short texts share the script of their
    pattern: messages of a kind differ in numbers and names, of which most have the same few patterns.
    """
    if len(a) > len(b):
        return script(b, a).translate(_SWAPPED)
    return _script_of_pattern(*_pattern(a, b)) if len(b) <= _SHORT else _script(a, b)


def _pattern(a: str, b: str) -> tuple[str, str]:
    """Both texts with the characters they share by number, and one character each for all the others."""
    shared = set(b).intersection(a)
    codes = {c: chr(n) for n, c in enumerate((c for c in dict.fromkeys(a) if c in shared), 2)}
    return "".join([codes.get(c, "\0") for c in a]), "".join([codes.get(c, "\1") for c in b])


def _script(a: str, b: str) -> str:
    out = []
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        if x == y:  # the only script without cost
            out.append("=" * len(x))
        elif not x:
            out.append("+" * len(y))
        elif len(y) == 1:
            out.append(_single(x, y))
        else:
            mid = len(y) // 2
            at = _first_cheapest_cut(x, y[:mid], y[mid:])
            todo += [(x[at:], y[mid:]), (x[:at], y[:mid])]
    return "".join(out)


# some 20 MB at most
_script_of_pattern = lru_cache(1 << 14)(_script)


def fold_pair(template: str, text: str) -> str:
    """Keep what both share, put one ``?`` for everything else."""
    if template == text:
        return template
    out, at = [], 0
    for op in script(template, text):
        out.append(template[at] if op == "=" else "?")
        at += op != "+"
    return "".join(out)


def fold_texts(texts: Iterable[str]) -> str:
    """Fold texts in order into one template."""
    texts = iter(texts)
    template = next(texts)
    fitting: set[str] = set()  # texts that left this template as it is
    for text in texts:
        if text in fitting:
            continue
        folded = fold_pair(template, text)
        if folded == template:
            fitting.add(text)
        else:
            template, fitting = folded, set()
    return template


def touches_multibyte(head: str, text: str) -> bool:
    """Whether the script from ``head`` to ``text`` deletes or replaces a non-ASCII character of ``head``."""
    if head.isascii():
        return False
    at = 0
    for op in script(head, text):
        if op in "-!" and not head[at].isascii():
            return True
        at += op != "+"
    return False


@F.arrow_udf(T.StringType())
def edit_script(a: pa.Array, b: pa.Array) -> pa.Array:
    """Column form of :func:`script`."""
    pairs = zip(a.to_pylist(), b.to_pylist())
    return pa.array([None if x is None or y is None else script(x, y) for x, y in pairs], pa.string())


@F.arrow_udf(T.StringType())
def fold_template(texts: pa.Array) -> pa.Array:
    """Column form of :func:`fold_texts`; null gives null."""
    return pa.array([None if t is None else fold_texts(t) for t in texts.to_pylist()], pa.string())


@F.arrow_udf(T.BooleanType())
def keeps_multibyte(heads: pa.Array, texts: pa.Array) -> pa.Array:
    """Whether the non-ASCII characters of the head stay untouched; null texts have none."""
    pairs = zip(heads.to_pylist(), texts.to_pylist())
    return pa.array([h is None or not touches_multibyte(h, t) for h, t in pairs], pa.bool_())


@F.arrow_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
def guarded_heads(texts: pa.Array, distances: pa.Array) -> pa.Array:
    """Per text of a box, the earlier texts at a known distance whose non-ASCII characters stay untouched.

    ``distances`` holds for each text an entry per earlier text, null where that is too far.
    """

    def allowed(box: Sequence[str], rows: Sequence[Sequence[object]]) -> list[list[int]]:
        return [
            [x for x, d in enumerate(row[:y]) if d is not None and not touches_multibyte(box[x], box[y])]
            for y, row in enumerate(rows)
        ]

    boxes = zip(texts.to_pylist(), distances.to_pylist())
    return pa.array([None if t is None else allowed(t, d) for t, d in boxes], pa.list_(pa.list_(pa.int32())))


# its result is used inside lambdas, where a Python call cannot be merged into
guarded_heads = guarded_heads.asNondeterministic()
