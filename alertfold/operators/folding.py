"""Folding of groups into templates, and the whole of batch compaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertfold.functions.script import fold_template
from alertfold.functions.templates import format_batch
from alertfold.operators.boxes import BOX, assign_boxes, pack_boxes
from alertfold.operators.grouping import with_roots
from alertfold.operators.mutes import apply_mutes
from alertfold.options import Options
from alertfold.plans.ordered import HOT_ROWS


def _groups() -> Column:
    """The groups of a box in order of their roots: seq and text of the root, size, texts in arrival order."""
    roots, msgs = F.col("roots"), F.col("msgs")

    def group(root: Column) -> Column:
        texts = F.transform(F.filter(msgs, lambda m, i: F.get(roots, i) == root), lambda m: m["text"])
        return _output(F.get(msgs, root), F.size(F.filter(roots, lambda r: r == root)), texts)

    return F.transform(F.array_distinct(roots), group)


def _output(first: Column, cnt: Column, texts: Column) -> Column:
    return F.struct(
        first["seq"].alias("seq"),
        first["text"].alias("text"),
        cnt.alias("cnt"),
        F.when(cnt > 1, texts).alias("texts"),
    )


def fold_groups(boxed: DataFrame, opts: Options = Options()) -> DataFrame:
    """Groups of two or more: root_seq, cnt, template, and the texts folded."""
    boxes = with_roots(pack_boxes(boxed), opts)
    groups = F.filter(_groups(), lambda g: g["cnt"] > 1)
    rows = boxes.select(*BOX, F.explode_outer(groups).alias("g")).filter(F.col("g").isNotNull())
    return rows.select(
        *BOX, F.col("g.seq").alias("root_seq"), "g.cnt", "g.texts", fold_template("g.texts").alias("template")
    )


def compact_boxes(boxed: DataFrame, opts: Options = Options()) -> DataFrame:
    """What is sent for each box: out_pos, seq (of the head), text, is_group, pattern, cnt.

    Boxes of up to ``min_approx`` messages pass unchanged; in others singles come first in arrival order,
    then groups in order of their heads.
    """
    gate = F.size("_all") > opts.min_approx
    # boxes that pass unchanged show an empty list to the pair search
    gated = pack_boxes(boxed).withColumnRenamed("msgs", "_all").withColumn(
        "msgs", F.when(gate, F.col("_all")).otherwise(F.array())
    )
    grouped = with_roots(gated, opts).withColumn("_groups", _groups())
    unchanged = F.transform("_all", lambda m: _output(m, F.lit(1), F.array(m["text"])))
    outputs = F.when(
        gate,
        F.concat(F.filter("_groups", lambda g: g["cnt"] == 1), F.filter("_groups", lambda g: g["cnt"] > 1)),
    ).otherwise(unchanged)
    rows = grouped.select(*BOX, F.posexplode_outer(outputs).alias("out_pos", "o")).select(*BOX, "out_pos", "o.*")
    folded = rows.withColumn("pattern", fold_template("texts"))
    several = F.col("cnt") > 1
    return folded.select(
        *BOX,
        "out_pos",
        "seq",
        F.when(several, format_batch(F.col("cnt"), F.col("pattern"))).otherwise(F.col("text")).alias("text"),
        several.alias("is_group"),
        "pattern",
        "cnt",
    )


def compact(
    messages: DataFrame,
    opts: Options = Options(),
    mute_log: DataFrame | None = None,
    hot_rows: int | None = HOT_ROWS,
    tick: int | None = None,
) -> DataFrame:
    """Batch compaction of messages(chat_id, seq, ts, text): boxes, mutes, gate, groups, templates."""
    boxed = assign_boxes(messages, opts.wait, opts.max_messages, hot_rows, tick)
    if mute_log is not None:
        boxed = apply_mutes(boxed, mute_log, hot_rows)
    return compact_boxes(boxed, opts)


def send_directly(messages: DataFrame) -> DataFrame:
    """Messages sent at once, past boxes, mutes and grouping, as outbox rows."""
    return messages.select(
        "chat_id",
        "seq",
        F.lit("SEND").alias("action"),
        F.lit(None).cast("int").alias("message_id"),
        "text",
        F.lit(False).alias("is_group"),
        F.lit(None).cast("string").alias("pattern"),
        F.lit(1).alias("cnt"),
    )


def to_outbox(compacted: DataFrame) -> DataFrame:
    """Compacted rows as outbox rows."""
    return compacted.select(
        "chat_id",
        "tick",
        "box",
        F.col("out_pos").cast("long").alias("seq"),
        F.lit("SEND").alias("action"),
        F.lit(None).cast("int").alias("message_id"),
        "text",
        "is_group",
        "pattern",
        "cnt",
    )
