"""Groups of similar messages: heads, chains, roots, singles.

A message takes the first similar message before it as its head, and changes to a later one only if that is
nearer by more than ``spread``. A message that heads others keeps its own head only while that one is not
farther than its nearest member by ``spread`` or more. The root of a message is where its heads lead.

Everything happens inside the row of one box, whose size is bounded, and on distinct texts: a copy has the
same distances as the first of its kind, so it never becomes a head, and as a member it takes the head of
its kind, or the first of its kind where that is nearer by more than ``spread`` (or there is no head).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertfold.operators.boxes import BOX, pack_boxes
from alertfold.operators.similarity import guard_multibyte, with_distances, with_kinds
from alertfold.options import Options

_LINK = "struct<head:int,dist:double>"


def _link(head: Column, dist: Column) -> Column:
    return F.struct(head.cast("int").alias("head"), dist.cast("double").alias("dist"))


def _first_links(spread: float) -> Column:
    """Per kind the head of its first message."""

    def choose(row: Column, y: Column) -> Column:
        earlier = F.transform(F.slice(row, F.lit(1), y), lambda d, x: _link(x, d["dist"]))
        return F.aggregate(
            earlier,
            F.lit(None).cast(_LINK),
            lambda held, c: F.when(
                c["dist"].isNotNull() & (held.isNull() | (held["dist"] - c["dist"] > spread)), c
            ).otherwise(held),
        )

    return F.transform("levs", choose)


def _first_links_directly(accuracy: float, spread: float) -> Column:
    """The same without the distances of all pairs.

    Once there is a head, another one counts only where it is nearer by more than the spread, so distances
    stop at that; and where the head is as near as the spread, none can, so nothing is measured any more.
    """
    kinds = F.col("kinds")

    def measured(held: Column, a: Column, b: Column) -> Column:
        longer = F.greatest(a["bytes"], b["bytes"])
        gap = F.abs(a["bytes"] - b["bytes"]) / longer
        reach = F.when(held.isNull(), F.lit(accuracy)).otherwise(F.least(F.lit(accuracy), held["dist"] - spread))
        limit = F.least(longer, F.ceil(longer * reach).cast("int") + 1)
        possible = (longer > 0) & (gap < accuracy) & (held.isNull() | (held["dist"] - gap > spread))
        lev = F.when(possible, F.call_function("levenshtein", a["flat"], b["flat"], limit))
        return F.struct(lev.alias("lev"), longer.alias("longer"))

    def better(held: Column, x: Column, m: Column) -> Column:
        dist = m["lev"] / m["longer"]
        nearer = (dist < accuracy) & (held.isNull() | (held["dist"] - dist > spread))
        return F.when((m["lev"] >= 0) & nearer, _link(x, dist)).otherwise(held)

    def choose(b: Column, y: Column) -> Column:
        earlier = F.transform(F.slice(kinds, F.lit(1), y), lambda a, x: F.struct(x.alias("x"), a.alias("a")))

        def step(held: Column, c: Column) -> Column:
            # an array of one, so that what is measured has a name and is measured once
            once = F.transform(F.array(measured(held, c["a"], b)), lambda m: better(held, c["x"], m))
            return F.when(held["dist"] <= spread, held).otherwise(F.get(once, F.lit(0)))

        return F.aggregate(earlier, F.lit(None).cast(_LINK), step)

    return F.transform(kinds, choose)


def _copy_links(spread: float) -> Column:
    """Per kind the head of its further messages; empty texts have none."""

    def choose(first: Column, y: Column) -> Column:
        own = first.isNull() | (first["dist"] > spread)
        return F.when(F.get(F.col("texts"), y) != "", F.when(own, _link(y, F.lit(0.0))).otherwise(first))

    return F.transform("first_link", choose)


def _parents(spread: float) -> Column:
    """Per kind the head its first message keeps, or itself."""
    first, copied, at, last = (F.col(c) for c in ("first_link", "copy_link", "first_at", "last_at"))

    def keep(link: Column, y: Column) -> Column:
        members = F.filter(first, lambda other: other["head"] == y)
        copies = F.when((F.get(copied, y)["head"] == y) & (F.get(last, y) > F.get(at, y)), F.lit(0.0))
        nearest = F.least(F.array_min(F.transform(members, lambda other: other["dist"])), copies)
        cut = link.isNull() | F.coalesce(link["dist"] - nearest >= spread, F.lit(False))
        return F.when(cut, y.cast("int")).otherwise(link["head"])

    return F.transform(first, keep)


def _tops(parents: Column) -> Column:
    """Follow parents to the top. Parents come earlier, so one pass from the left is enough."""
    return F.aggregate(
        parents,
        F.array().cast("array<int>"),
        lambda done, p: F.concat(done, F.array(F.coalesce(F.get(done, p), p))),
    )


def with_links(boxes: DataFrame, opts: Options) -> DataFrame:
    """Add to packed boxes the links of kinds: ``first_link``, ``copy_link``, ``first_at``, ``last_at``."""
    if opts.dont_approximate_multibyte:
        found = guard_multibyte(with_distances(boxes, opts.accuracy))
        found = found.withColumn("first_link", _first_links(opts.spread)).drop("levs")
    else:
        found = with_kinds(boxes).withColumn("first_link", _first_links_directly(opts.accuracy, opts.spread))
        found = found.drop("kinds")
    kind_of = F.col("kind_of")
    first_at = F.transform("texts", lambda t, y: (F.array_position(kind_of, y.cast("int")) - 1).cast("int"))
    last_at = F.transform(
        "texts", lambda t, y: (F.size(kind_of) - F.array_position(F.reverse(kind_of), y.cast("int"))).cast("int")
    )
    places = {"first_at": first_at, "last_at": last_at}
    return found.withColumns({"copy_link": _copy_links(opts.spread), **places})


def with_roots(boxes: DataFrame, opts: Options) -> DataFrame:
    """Add ``roots`` to packed boxes: per message the place of the root of its group."""
    tops, first_at, copied = F.col("tops"), F.col("first_at"), F.col("copy_link")

    def root(y: Column, j: Column) -> Column:
        of_copy = F.get(first_at, F.get(tops, F.get(copied, y)["head"]))
        return F.when(F.get(first_at, y) == j, F.get(first_at, F.get(tops, y))).otherwise(
            F.coalesce(of_copy, j.cast("int"))
        )

    return (
        with_links(boxes, opts)
        .withColumn("tops", _tops(_parents(opts.spread)))
        .withColumn("roots", F.transform("kind_of", root))
        .drop("texts", "kind_of", "first_link", "copy_link", "first_at", "last_at", "tops")
    )


def _rows(boxes: DataFrame, entries: Column) -> DataFrame:
    """The entries of an array per box as rows; nothing else of the box is carried along."""
    return boxes.select(*BOX, F.explode_outer(entries).alias("e")).filter(F.col("e").isNotNull()).select(*BOX, "e.*")


def _size_of(root: Column) -> Column:
    return F.size(F.filter(F.col("roots"), lambda r: r == root))


def _seq_at(place: Column) -> Column:
    return F.get(F.col("msgs"), place)["seq"]


def assign_heads(boxed: DataFrame, opts: Options = Options()) -> DataFrame:
    """Greedy head of each message that has one: member_seq, head_seq, dist."""
    first_at, first, copied = F.col("first_at"), F.col("first_link"), F.col("copy_link")

    def head(y: Column, j: Column) -> Column:
        link = F.when(F.get(first_at, y) == j, F.get(first, y)).otherwise(F.get(copied, y))
        return F.struct(_seq_at(j).alias("member_seq"), link.alias("link"))

    linked = _rows(
        with_links(pack_boxes(boxed), opts),
        F.transform(
            F.filter(F.transform("kind_of", head), lambda h: h["link"].isNotNull()),
            lambda h: F.struct(
                h["member_seq"].alias("member_seq"),
                _seq_at(F.get(first_at, h["link"]["head"])).alias("head_seq"),
                h["link"]["dist"].alias("dist"),
            ),
        ),
    )
    return linked


def resolve_roots(boxed: DataFrame, opts: Options = Options()) -> DataFrame:
    """Every message with the root of its group and the group's size: seq, root_seq, group_size, text."""
    members = F.transform(
        "roots",
        lambda root, j: F.struct(
            _seq_at(j).alias("seq"),
            _seq_at(root).alias("root_seq"),
            _size_of(root).alias("group_size"),
            F.get(F.col("msgs"), j)["text"].alias("text"),
        ),
    )
    return _rows(with_roots(pack_boxes(boxed), opts), members)


def group_sizes(boxed: DataFrame, opts: Options = Options()) -> DataFrame:
    """Groups of two or more: root_seq, cnt."""
    groups = F.transform(
        F.array_distinct("roots"), lambda root: F.struct(_seq_at(root).alias("root_seq"), _size_of(root).alias("cnt"))
    )
    return _rows(with_roots(pack_boxes(boxed), opts), groups).filter(F.col("cnt") > 1)


def singles(boxed: DataFrame, opts: Options = Options()) -> DataFrame:
    """Messages in no group, which go out unchanged: seq, text."""
    return resolve_roots(boxed, opts).filter(F.col("group_size") == 1).select(*BOX, "seq", "text")
