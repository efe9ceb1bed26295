"""Rows to learn from: labels, what is held out, and bounded samples by class."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(modulus: int) -> Column:
    """crc32 of doc_id as text, modulo; null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def held_out(modulus: int, kept_back: int) -> Column:
    return F.coalesce(remainder(modulus) == kept_back, F.lit(False))


def training(labels: DataFrame, column: str, modulus: int, kept_back: int) -> DataFrame:
    """(doc_id, label) of the rows that may be learned from: label 0 or 1, not held out, with a doc_id.

    A doc_id whose rows disagree is left out.
    """
    rows = labels.select("doc_id", F.col(column).cast("int").alias("label"))
    usable = rows.filter(F.col("label").isin(0, 1) & (remainder(modulus) != kept_back))
    agreed = usable.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("_most"))
    return agreed.filter(F.col("label") == F.col("_most")).drop("_most")


def sample(rows: DataFrame, per_class: int) -> DataFrame:
    """At most ``per_class`` rows of each label, in the order of a hash of doc_id: the same ones in every run."""
    order = F.xxhash64(F.col("doc_id").cast("string"))
    parts = [rows.filter(F.col("label") == label).orderBy(order, "doc_id").limit(per_class) for label in (0, 1)]
    return reduce(DataFrame.unionAll, parts)


def class_sizes(rows: DataFrame) -> tuple[int, int]:
    found = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    return found.get(0, 0), found.get(1, 0)


def texts_of(rows: DataFrame) -> DataFrame:
    """(text, label): one row for each doc_id of rows (doc_id, text, label), with its smallest text."""
    return rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("text", "label")
