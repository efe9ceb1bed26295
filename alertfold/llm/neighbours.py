"""Approximate nearest neighbours: robust-pruned directed graphs, one per shard, searched with a beam.

Equal vectors are one vertex, which keeps its smallest ids, so copies don't crowd a graph. A shard holds a
bounded number of vertices. Its graph grows in batches: a greedy search over what is there proposes neighbours;
pruning keeps a near one and drops those much nearer to it than to the vertex, with a factor that lets some
longer edges live; edges are added back and lists that grow too long are pruned again. A query walks the graph
of every shard with a beam, and its nearest over all shards are ranked by cosine in double precision.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertfold.plans.storage import checkpointed

DEGREE, BEAM, RELAX = 32, 64, 1.2
QUERY_BEAM = 160
SHARD_ROWS, QUERY_ROWS = 4096, 2048
_BATCH, _SEEDS, _SALTS = 256, 8, 64


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, vector) of the rows that take part: an id, and a vector of finite numbers, not all zero."""
    value = F.col(column)
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & value.isNotNull() & finite & F.exists(value, lambda x: x != 0))
    return rows.select("vec_id", value.cast("array<double>").alias("vector"))


def vertices(rows: DataFrame, keep: int) -> DataFrame:
    """(vector, ids): distinct vectors with the ``keep`` smallest ids of each. A vector of any number of rows is
    cut down in salted parts first."""
    named = rows.select(
        "vec_id", "vector", F.xxhash64("vector").alias("_a"), F.xxhash64("vector", F.lit(1)).alias("_b")
    ).withColumn("_salt", F.pmod(F.xxhash64("vec_id"), F.lit(_SALTS)))
    for keys in (["_a", "_b", "_salt"], ["_a", "_b"]):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("vec_id"))
        named = named.withColumn("_n", place).filter(F.col("_n") <= keep)
    least = F.array_sort(F.collect_set("vec_id")).alias("ids")
    return named.groupBy("_a", "_b").agg(F.first("vector").alias("vector"), least).select("vector", "ids")


def _squared(points: np.ndarray, ids: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Squared distances on the unit sphere from each query to its own candidates."""
    return 2 - 2 * np.einsum("bcd,bd->bc", points[ids], query)


@dataclass
class Graph:
    """``out`` lists the neighbours of each vertex, -1 where there are less; ``seeds`` are where searches start."""

    points: np.ndarray
    out: np.ndarray
    seeds: np.ndarray

    @classmethod
    def build(cls, points: np.ndarray, seed: int = 1) -> Graph:
        """A graph over unit vectors."""
        count = len(points)
        order = np.random.default_rng(seed).permutation(count)
        graph = cls(points, np.full((count, DEGREE), -1, np.int64), order[:_SEEDS])
        done = min(count, DEGREE + 1)
        start = order[:done]
        for row, vertex in enumerate(start):
            others = np.delete(start, row)
            graph.out[vertex, : len(others)] = others
        while done < count:
            batch = order[done : done + min(_BATCH, max(16, done // 4))]
            near, distance = graph.search(points[batch], BEAM)
            graph.out[batch] = graph._pruned(batch, near, distance)
            graph._add_back(batch)
            done += len(batch)
        return graph

    def search(self, query: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query the vertices in its beam, nearest first (-1: none), and their squared distances."""
        rows = np.arange(len(query))
        ids = np.full((len(query), beam), -1, np.int64)
        distance = np.full((len(query), beam), np.inf, np.float32)
        first = np.tile(self.seeds, (len(query), 1))[:, :beam]
        ids[:, : first.shape[1]] = first
        distance[:, : first.shape[1]] = _squared(self.points, first, query)
        order = np.argsort(distance, axis=1, kind="stable")
        ids, distance = np.take_along_axis(ids, order, 1), np.take_along_axis(distance, order, 1)
        seen = np.zeros((len(query), len(self.points)), bool)
        seen[rows[:, None], first] = True
        walked = ids < 0
        while True:
            at = np.argmin(walked, axis=1)
            live = np.flatnonzero(~walked[rows, at])
            if not len(live):
                return ids, distance
            at = at[live]
            walked[live, at] = True
            found = self.out[ids[live, at]]
            fresh = (found >= 0) & ~seen[live[:, None], found]
            seen[live[:, None], np.where(found >= 0, found, found[:, :1])] = True
            far = np.where(fresh, _squared(self.points, found, query[live]), np.inf).astype(np.float32)
            all_ids = np.concatenate([ids[live], np.where(fresh, found, -1)], axis=1)
            all_far = np.concatenate([distance[live], far], axis=1)
            all_walked = np.concatenate([walked[live], ~fresh], axis=1)
            order = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
            ids[live] = np.take_along_axis(all_ids, order, 1)
            distance[live] = np.take_along_axis(all_far, order, 1)
            walked[live] = np.take_along_axis(all_walked, order, 1)

    def _pruned(self, vertex: np.ndarray, near: np.ndarray, distance: np.ndarray) -> np.ndarray:
        """Up to DEGREE diverse neighbours for each vertex, from candidates nearest first."""
        rows = np.arange(len(vertex))
        alive = (near >= 0) & (near != vertex[:, None])
        vectors = self.points[near]
        between = 2 - 2 * (vectors @ vectors.transpose(0, 2, 1))
        out = np.full((len(vertex), DEGREE), -1, np.int64)
        for slot in range(DEGREE):
            pick = np.argmax(alive, axis=1)
            some = alive[rows, pick]
            if not some.any():
                break
            out[:, slot] = np.where(some, near[rows, pick], -1)
            alive &= ~(some[:, None] & (RELAX**2 * between[rows, pick] <= distance))
            alive[rows, pick] = False
        return out

    def _add_back(self, batch: np.ndarray) -> None:
        """Edges back from the new neighbours; lists that become too long are pruned."""
        heads, tails = self.out[batch], np.repeat(batch, DEGREE).reshape(len(batch), DEGREE)
        heads, tails = heads[heads >= 0], tails[heads >= 0]
        order = np.argsort(heads, kind="stable")
        heads, tails = heads[order], tails[order]
        vertex, first, more = np.unique(heads, return_index=True, return_counts=True)
        wide = np.full((len(vertex), DEGREE + int(more.max())), -1, np.int64)
        wide[:, :DEGREE] = self.out[vertex]
        wide[np.repeat(np.arange(len(vertex)), more), DEGREE + np.arange(len(heads)) - np.repeat(first, more)] = tails
        far = np.where(wide >= 0, _squared(self.points, wide, self.points[vertex]), np.inf)
        order = np.argsort(far, axis=1, kind="stable")
        wide, far = np.take_along_axis(wide, order, 1), np.take_along_axis(far, order, 1)
        repeat = np.zeros(wide.shape, bool)
        by_id = np.argsort(wide, axis=1, kind="stable")
        sorted_ids = np.take_along_axis(wide, by_id, 1)
        again = np.zeros(wide.shape, bool)
        again[:, 1:] = (sorted_ids[:, 1:] == sorted_ids[:, :-1]) & (sorted_ids[:, 1:] >= 0)
        np.put_along_axis(repeat, by_id, again, 1)
        wide[repeat], far[repeat] = -1, np.inf
        full = (wide >= 0).sum(axis=1) > DEGREE
        if full.any():
            self.out[vertex[full]] = self._pruned(vertex[full], wide[full], far[full])
        packed = np.argsort(wide < 0, axis=1, kind="stable")[:, :DEGREE]
        self.out[vertex[~full]] = np.take_along_axis(wide, packed, 1)[~full]


def _matrix(lists: pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as a matrix in double precision."""
    values = lists.combine_chunks()
    values = values.chunk(0) if isinstance(values, pa.ChunkedArray) else values
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return (scaled / np.linalg.norm(scaled, axis=1, keepdims=True)).astype(np.float32)


_INDEX = pa.schema(
    [
        ("width", pa.int32()),
        ("shard", pa.int32()),
        ("ids", pa.list_(pa.int64())),
        ("vector", pa.list_(pa.float64())),
        ("out", pa.list_(pa.int64())),
        ("seed", pa.bool_()),
    ]
)


def build_index(rows: DataFrame, neighbours: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The graphs of all shards: width, shard, ids, vector, out, seed (whether searches start there).

    ``rows`` are (vec_id, vector). Vertices go to shards by hash, about ``shard_rows`` each; vectors of another
    width have shards of their own. Written once to the shared folder.
    """
    distinct = checkpointed(vertices(rows, neighbours + 1))
    shards = max(1, -(-distinct.count() // shard_rows))
    placed = distinct.select(
        F.size("vector").alias("width"), F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int").alias("shard"), "ids", "vector"
    )
    schema = "width int, shard int, ids array<bigint>, vector array<double>, out array<bigint>, seed boolean"

    def build(part: pa.Table) -> pa.Table:
        part = part.take(np.argsort([i[0] for i in part.column("ids").to_pylist()], kind="stable"))
        graph = Graph.build(_unit(_matrix(part.column("vector"))))
        seed = np.zeros(part.num_rows, bool)
        seed[graph.seeds] = True
        lists = pa.array(list(graph.out), pa.list_(pa.int64()))
        return part.append_column("out", lists).append_column("seed", pa.array(seed)).cast(_INDEX)

    return checkpointed(placed.groupBy("width", "shard").applyInArrow(build, schema))


def search(index: DataFrame, queries: DataFrame, neighbours: int, beam: int = QUERY_BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found for each of ``queries`` (vec_id, vector), itself left out.

    Blocks of queries meet the graph of every shard of their width. Scores are cosines of the vectors as given,
    in double precision; ties go to the smaller vec_id.
    """
    asked = checkpointed(queries.groupBy("vec_id").agg(F.min("vector").alias("vector")))
    blocks = max(1, -(-asked.count() // QUERY_ROWS))
    shards = index.select("width", "shard").distinct()
    query = (
        asked.select(F.col("vec_id").alias("query_id"), "vector", F.size("vector").alias("width"))
        .withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
        .join(shards, "width")
    )
    graph = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    schema = "query_id bigint, vec_id bigint, score double"

    def walk(block: pa.Table, part: pa.Table) -> pa.Table:
        if not block.num_rows or not part.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        part = part.take(np.argsort([i[0] for i in part.column("ids").to_pylist()], kind="stable"))
        given, ids = _matrix(part.column("vector")), part.column("ids").to_pylist()
        seeds = np.flatnonzero(part.column("seed").to_numpy())
        known = Graph(_unit(given), _matrix(part.column("out")).astype(np.int64), seeds)
        wanted, names = _matrix(block.column("vector")), block.column("query_id").to_pylist()
        norms, out = np.linalg.norm(given, axis=1), []
        for low in range(0, len(names), _BATCH):
            batch = wanted[low : low + _BATCH]
            near, _ = known.search(_unit(batch), beam)
            for name, vector, found in zip(names[low : low + _BATCH], batch, near[:, : 4 * neighbours]):
                found = found[found >= 0]
                cosine = given[found] @ vector / (norms[found] * np.linalg.norm(vector))
                rows = [(-score, vec_id) for score, at in zip(cosine.tolist(), found) for vec_id in ids[at] if vec_id != name]
                out += [(name, vec_id, -score) for score, vec_id in sorted(rows)[:neighbours]]
        columns = list(zip(*out)) or [(), (), ()]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("query_id", "vec_id", "score"), columns, (pa.int64(), pa.int64(), pa.float64()))})

    keys = ["width", "shard", "block"]
    asking = query.toDF(*query.columns)  # new columns: both sides stem from the index
    found = asking.groupBy(*keys).cogroup(graph.groupBy(*keys)).applyInArrow(walk, schema)
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= neighbours).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, wanted: DataFrame, neighbours: int, column: str = "embedding") -> DataFrame:
    """The nearest rows of ``vectors`` for each row of ``wanted``, both (vec_id, ``column``); see ``search``.

    Rows without vec_id, null or zero vectors, and vectors with null or non-finite numbers take no part. Of rows
    that share a vec_id the least vector asks, and none answers it. An empty table gives no rows.
    """
    return search(build_index(usable(vectors, column), neighbours), usable(wanted, column), neighbours)
