"""Connected components of a graph: in one task while its edges are few, else in rounds of joins."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertfold.plans.storage import checkpointed


ONE_TASK_EDGES = 500_000


def _in_one_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    above: dict[int, int] = {}

    def root(node: int) -> int:
        while above.setdefault(node, node) != node:
            above[node] = above[above[node]]
            node = above[node]
        return node

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            low, high = sorted((root(a), root(b)))
            above[high] = low
    nodes = list(above)
    columns = [pa.array(nodes, pa.int64()), pa.array([root(node) for node in nodes], pa.int64())]
    yield pa.RecordBatch.from_arrays(columns, ["node", "component"])


def components(edges: DataFrame, one_task_edges: int = ONE_TASK_EDGES) -> DataFrame:
    """(node, component) of every node in ``edges`` (a, b); the component is its smallest node.

    Up to ``one_task_edges`` edges, which are counted, one task joins them. Beyond that each round ties all larger neighbours of a node to its smallest one, then the smaller ones, until nothing
    changes: a number of rounds that grows with the logarithm of the size. A node's neighbours are only
    aggregated, never listed.
    """

    def stars(pairs: DataFrame, larger: bool) -> DataFrame:
        both = pairs if not larger else pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        tied = both.join(least, "a").filter((F.col("b") > F.col("a")) if larger else F.lit(True))
        own = least.filter("a > least").select("a", F.col("least").alias("b"))
        moved = tied.select(F.col("b").alias("a"), F.col("least").alias("b"))
        return (moved if larger else moved.unionAll(own)).filter("a > b").distinct()

    edges = checkpointed(edges.select("a", "b"))
    if edges.count() <= one_task_edges:
        return edges.filter("a <> b").coalesce(1).mapInArrow(_in_one_task, "node long, component long")
    downward = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    pairs = checkpointed(downward)
    before = None
    while True:
        pairs = checkpointed(stars(stars(pairs, larger=True), larger=False))
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    members = pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.unionAll(pairs.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
