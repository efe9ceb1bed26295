"""Similar pairs within a box."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertfold.functions.distance import SHORT, byte_text, short_distances
from alertfold.functions.script import guarded_heads, keeps_multibyte
from alertfold.operators.boxes import BOX, pack_boxes

FEW = 100  # texts of a box whose distances go to and come from Python together


def _under(ratio: Column, accuracy: float, inclusive: bool) -> Column:
    return ratio <= accuracy if inclusive else ratio < accuracy


def _kind(text: Column) -> Column:
    """A distinct text of a box, with its bytes as characters and its length in bytes."""
    return F.struct(text.alias("text"), byte_text(text).alias("flat"), F.octet_length(text).alias("bytes"))


def _distances(accuracy: float, inclusive: bool) -> Column:
    """For each kind of a box (lev, dist) to every kind up to itself; null where that is too far.

    The difference in length is a lower bound of the distance, so it decides first; the distance itself
    stops at the largest value that can still pass. Empty texts are near to nothing.
    """
    kinds = F.col("kinds")

    def measured(a: Column, b: Column) -> Column:
        longer = F.greatest(a["bytes"], b["bytes"])
        gap = F.abs(a["bytes"] - b["bytes"])
        limit = F.least(longer, F.ceil(longer * accuracy).cast("int") + 1)
        lev = F.when(a["text"] == b["text"], F.lit(0)).otherwise(
            F.call_function("levenshtein", a["flat"], b["flat"], limit)
        )
        possible = (longer > 0) & _under(gap / longer, accuracy, inclusive)
        return F.struct(F.when(possible, lev).alias("lev"), longer.alias("longer"))

    def passed(m: Column) -> Column:
        dist = m["lev"] / m["longer"]
        near = (m["lev"] >= 0) & _under(dist, accuracy, inclusive)
        return F.when(near, F.struct(m["lev"].alias("lev"), dist.alias("dist")))

    def against_earlier(b: Column, y: Column) -> Column:
        return F.transform(F.transform(F.slice(kinds, F.lit(1), y + 1), lambda a: measured(a, b)), passed)

    return F.transform(kinds, against_earlier)


def with_kinds(boxes: DataFrame) -> DataFrame:
    """Add to packed boxes ``texts`` (the distinct ones, by first arrival), ``kinds`` (what distances need of
    them) and ``kind_of`` (the place of each message's text among them)."""
    texts = F.col("texts")
    place = F.transform("msgs", lambda m: (F.array_position(texts, m["text"]) - 1).cast("int"))
    distinct = boxes.withColumn("texts", F.array_distinct(F.transform("msgs", lambda m: m["text"])))
    return distinct.withColumns({"kind_of": place, "kinds": F.transform(texts, _kind)})


def with_distances(boxes: DataFrame, accuracy: float, inclusive: bool = False) -> DataFrame:
    """Add the kinds of packed boxes and ``levs``: per kind, (lev, dist) to every kind up to itself; null if
    far. Distances are taken once per pair of distinct texts, so copies cost nothing.
    """
    return with_kinds(boxes).withColumn("levs", _distances(accuracy, inclusive)).drop("kinds")


def guard_multibyte(distances: DataFrame) -> DataFrame:
    """Forget distances between kinds whose script changes non-ASCII characters of the earlier one.

    Only boxes with such characters send their texts to Python. (The arguments must not hold lambdas, or
    the optimizer does not find the Python call.)
    """
    joined = F.array_join("texts", "")
    several = F.octet_length(joined) != F.char_length(joined)
    allowed = guarded_heads(F.when(several, F.col("texts")), F.when(several, F.col("levs")))
    kept = F.transform(
        "levs",
        lambda row, y: F.transform(
            row, lambda d, x: F.when((x == y) | F.array_contains(F.get(F.col("_allowed"), y), x.cast("int")), d)
        ),
    )
    guarded = F.when(F.col("_allowed").isNull(), F.col("levs")).otherwise(kept)
    return distances.withColumn("_allowed", allowed).withColumn("levs", guarded).drop("_allowed")


def _own_kind(text: Column, extra: dict[str, Callable]) -> Column:
    """A distinct text of a box as pairs need it, with the place and number of each of its messages."""
    same = F.filter("msgs", lambda m: m["text"] == text)
    kind = _kind(text)
    return F.struct(
        kind["flat"].alias("flat"),
        kind["bytes"].alias("bytes"),
        F.transform(same, lambda m: F.struct(m["pos"].alias("pos"), m["seq"].alias("seq"))).alias("at"),
        *[take(text).alias(f"_{name}") for name, take in extra.items()],
    )


def _pairs_of_kinds(kinds: DataFrame, accuracy: float, inclusive: bool, known: Column | None) -> DataFrame:
    """One row per similar pair of ``kinds`` of a box, or of a kind and itself: x, y, a, b, lev, longer, dist.

    Pairs are rows, not arrays: whole rows are compiled, while functions over arrays are interpreted. A box has a
    bounded number of them. ``known`` gives distances that need no measuring, or null, and may use ``levs``.

    Outer explodes, here and elsewhere: an inner one makes the optimizer add a filter on the array, which
    would compute the whole array a second time. What is measured goes through one, too: a filter is not moved below it,
    so a distance is taken once.
    """
    carried = [c for c in kinds.columns if c != "kinds"]
    firsts = kinds.select("*", F.posexplode_outer("kinds").alias("y", "b"))
    up_to = F.slice("kinds", F.lit(1), F.col("y") + 1)
    pairs = firsts.select(*carried, "y", "b", F.posexplode_outer(up_to).alias("x", "a"))
    longer = F.greatest("a.bytes", "b.bytes")
    gap = F.abs(F.col("a.bytes") - F.col("b.bytes"))
    limit = F.least(longer, F.ceil(longer * accuracy).cast("int") + 1)
    measured = F.call_function("levenshtein", F.col("a.flat"), F.col("b.flat"), limit)
    if known is not None:
        measured = F.coalesce(known, measured)
    lev = F.when(F.col("x") == F.col("y"), F.lit(0)).otherwise(measured)
    # the difference in length is a lower bound of the distance; empty texts are near to nothing
    possible = pairs.filter(_under(F.when(longer > 0, gap / longer), accuracy, inclusive))
    once = F.explode_outer(F.array(F.struct(lev.alias("lev"), longer.alias("longer")))).alias("m")
    found = possible.select(*BOX, "x", "y", "a", "b", once).select(*BOX, "x", "y", "a", "b", "m.*")
    dist = F.when(F.col("lev") >= 0, F.col("lev") / F.col("longer"))
    return found.filter(_under(dist, accuracy, inclusive)).withColumn("dist", dist)


def _edges(
    boxed: DataFrame,
    accuracy: float,
    inclusive: bool = False,
    also: dict[str, Callable] | None = None,
    short_in_python: bool = False,
) -> DataFrame:
    """One row per similar pair of messages, the earlier one as head: head_seq, member_seq, lev, dist, and
    what ``also`` takes from each of the two texts. Nothing else of the box is carried along.

    Distances are taken once per pair of distinct texts, so copies cost a row each and no distance. With
    ``short_in_python``, those of short texts are taken together in Python, a box at a time.
    """
    extra = also or {}
    own = extra | ({"short": lambda text: F.when(F.octet_length(text) <= SHORT, text)} if short_in_python else {})
    distinct = F.array_distinct(F.transform("msgs", lambda m: m["text"]))
    kinds = pack_boxes(boxed).select(*BOX, F.transform(distinct, lambda text: _own_kind(text, own)).alias("kinds"))
    known = None
    if short_in_python:
        few = F.when(F.size("kinds") <= FEW, F.col("kinds")["_short"])
        kinds = kinds.withColumn("levs", short_distances(few))
        x, y = F.col("x"), F.col("y")
        known = F.get("levs", F.shiftright(y * (y - 1), 1) + x).cast("int")
    near = _pairs_of_kinds(kinds, accuracy, inclusive, known)
    sides = near.withColumn("m", F.explode_outer("a.at")).withColumn("n", F.explode_outer("b.at"))
    # the two of one kind meet twice, those of two kinds once
    once = sides.filter((F.col("x") < F.col("y")) | (F.col("m.pos") < F.col("n.pos")))
    turned = F.col("n.pos") < F.col("m.pos")

    def of(role: str, name: str, first: str, second: str) -> Column:
        left, right = (second, first) if role == "head" else (first, second)
        return F.when(turned, F.col(left)).otherwise(F.col(right)).alias(f"{role}_{name}")

    more = [of(role, name, f"a._{name}", f"b._{name}") for name in extra for role in ("head", "member")]
    seqs = [of(role, "seq", "m.seq", "n.seq") for role in ("head", "member")]
    return once.select(*BOX, *seqs, "lev", "dist", *more)


_PAIR = [*BOX, "head_seq", "member_seq", "lev", "dist"]


def similarity_pairs(
    boxed: DataFrame, accuracy: float = 0.4, norm: str = "max", inclusive: bool = False
) -> DataFrame:
    """Pairs of similar messages of a box: head_seq, member_seq, lev (bytes), dist.

    ``norm='max'`` divides by the longer text and gives each pair once, the earlier message as head.
    ``norm='left'`` divides by the head and gives every ordered pair that passes; it takes the distances of short
    texts together in Python, the other stays in the JVM.
    """
    if norm not in ("max", "left"):
        raise ValueError("norm must be 'max' or 'left'")
    if norm == "max":
        return _edges(boxed, accuracy, inclusive).select(*_PAIR)
    edges = _edges(boxed, accuracy, inclusive, {"bytes": F.octet_length}, short_in_python=True)

    # distance / head length under the bound implies distance / longer length under it
    def directed(head: str, member: str) -> Column:
        size = F.col(f"{head}_bytes")
        return F.struct(
            F.col(f"{head}_seq").alias("head_seq"),
            F.col(f"{member}_seq").alias("member_seq"),
            F.when(size > 0, F.col("lev") / size).alias("dist"),
        )

    both = F.array(directed("head", "member"), directed("member", "head"))
    ordered = edges.select(*BOX, "lev", F.explode(both).alias("p")).select(*BOX, "lev", "p.*")
    return ordered.filter(_under(F.col("dist"), accuracy, inclusive)).select(*_PAIR)


def multibyte_guard(boxed: DataFrame, accuracy: float = 0.4) -> DataFrame:
    """Similar pairs whose edit script leaves the non-ASCII characters of the head alone."""
    edges = _edges(boxed, accuracy, also={"text": lambda text: text})
    plain = F.octet_length("head_text") == F.char_length("head_text")
    # texts without such characters are not compared, only passed by
    text = F.when(~plain, F.col("head_text"))
    return edges.filter(keeps_multibyte(text, F.when(~plain, F.col("member_text")))).select(*_PAIR)
