"""Mixing sources to target weights: capped water-filling, then whole and fractional repetitions.

Sources share all words by weight. A source whose share lies above ``max_epochs`` times its own words is
clamped there and the excess goes to the others in proportion to their weights, round by round, until no share
lies above its cap. A source then gives every document ``floor(target / words)`` times, and some of them once
more: documents in the order of a seeded hash, as long as the words fit what is left of the target.

The threshold of that order is found by sums over hash prefixes, one hex digit pair at a time, so a source of
any size is never sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertfold.llm.small_side import joined
from alertfold.plans.ordered import numbered
from alertfold.plans.storage import checkpointed

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix"
_LEVELS = 3


def word_count(text: Column) -> Column:
    """Words of [^\\x20\\x09-\\x0D]+; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def order_key(seed: str = SEED) -> Column:
    """Place of a document in the seeded order: the same for all rows of one doc_id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from rows of (source, size).

    Sources take the weights in the order of their names by code point, null last, over and over. Sources
    without words get the target 0.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_last", F.col("source").isNull())
    place = ((F.col("_rn") - 1) % len(weights) + 1).cast("int")
    weighted = checkpointed(
        numbered(sources, [], ["_last", "source"], "_rn")
        .withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), place))
        .withColumn("cap", F.col("source_size") * max_epochs)
        .drop("_last", "_rn")
    )
    start = weighted.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    total, clamped, free = start.words or 0, 0, start.weight or 0
    while True:
        share = F.col("weight") * F.lit(float(total - clamped) / free if free else 0.0)
        above = F.col("cap") <= share
        now = weighted.agg(
            F.coalesce(F.sum(F.when(above, F.col("cap"))), F.lit(0)).alias("clamped"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)).alias("free"),
        ).first()
        if now.free in (free, 0):
            break
        clamped, free = now.clamped, now.free
    target = F.when(above, F.col("cap").cast("double")).otherwise(share.cast("double"))
    return weighted.select("source", "source_size", target.alias("target"))


def repetitions(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, whole, last_key): documents go in ``whole`` times, and once more where key <= last_key.

    ``sized`` has (source, size, key). A document still goes in if that brings its source closer to the target.
    Documents of sources without words go in once.
    """
    wordless = targets.filter("source_size = 0").select("source", F.lit(1).alias("whole"), F.lit("").alias("last_key"))
    whole = F.floor(F.col("target") / F.col("source_size"))
    state = targets.filter("source_size > 0").select(
        "source",
        whole.cast("int").alias("whole"),
        (F.col("target") - whole * F.col("source_size")).alias("quota"),
        F.lit("").alias("prefix"),
        F.lit(0).cast("long").alias("base"),
    )
    up_to = Window.partitionBy("source").orderBy("part")
    for level in range(1, _LEVELS + 1):
        inside = joined(sized, state, ["source"], "inner").filter(F.col("key").startswith(F.col("prefix")))
        sums = (
            inside.withColumn("part", F.substring("key", 1, 2 * level))
            .groupBy("source", "whole", "quota", "base", "part")
            .agg(F.sum("size").alias("words"))
            .withColumn("until", F.col("base") + F.sum("words").over(up_to))
        )
        crossing = F.struct("part", (F.col("until") - F.col("words")).alias("base"))
        whole_source = state.filter("prefix = 'g'")
        state = checkpointed(
            sums.groupBy("source", "whole", "quota")
            .agg(F.min(F.when(F.col("until") > F.col("quota"), crossing)).alias("c"))
            # no part beyond the quota: all fit, and no key starts with a letter behind f
            .select(
                "source",
                "whole",
                "quota",
                F.coalesce("c.part", F.lit("g")).alias("prefix"),
                F.coalesce("c.base", F.lit(0)).cast("long").alias("base"),
            )
            .unionAll(whole_source)
        )
    last = joined(sized, state, ["source"], "inner").filter(F.col("key").startswith(F.col("prefix")))
    by_key = last.groupBy("source", "base", "quota", "key").agg(F.sum("size").alias("words"))
    middle = F.col("base") + F.sum("words").over(Window.partitionBy("source").orderBy("key")) - F.col("words") / 2
    fits = by_key.withColumn("middle", middle).filter(F.col("middle") <= F.col("quota"))
    found = fits.groupBy("source").agg(F.max("key").alias("found"))
    worded = joined(state, found, ["source"], "left").select(
        # nothing is left for one more time where whole repetitions give the target, not even a text without words
        "source", "whole", F.when(F.col("quota") > 0, F.coalesce("found", "prefix")).otherwise("").alias("last_key")
    )
    return worded.unionAll(wordless)


def mixture(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED):
    """(sized, plan): per document (doc_id, source, size, key), per source (source_size, target, whole, last_key).

    Rows with a null doc_id share one place in the order. An empty table gives two empty ones.
    """
    sized = checkpointed(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), order_key(seed).alias("key"))
    )
    targets = checkpointed(source_targets(sized, weights, max_epochs))
    return sized, checkpointed(joined(targets, repetitions(sized, targets), ["source"], "inner"))


def copies() -> Column:
    """How often a document goes in, on rows that have key, whole and last_key."""
    return (F.col("whole") + F.when(F.col("key") <= F.col("last_key"), 1).otherwise(0)).cast("int")


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mixed corpus: every document as many times as the mix takes it. All columns of ``docs`` stay,
    whatever their names.

    Texts don't move: the plan per source is joined to them, by broadcast up to a counted number of sources.
    """
    _, plan = mixture(docs, weights, max_epochs, seed)
    # the row goes as one struct, so that no column of the table can clash
    keyed = docs.select(F.struct(*docs.columns).alias("row"), "source", order_key(seed).alias("key"))
    counted = joined(keyed, plan, ["source"], "inner").withColumn("times", copies()).filter("times > 0")
    return counted.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
