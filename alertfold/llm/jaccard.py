"""N-gram Jaccard join: documents whose sets of word shingles are similar, and the components they form.

Equal sets become one class. A class can link with another only if few of its shingles are its own; that is
counted over a fixed part of all shingles, and leaves little besides true near copies. Their sets are written
once. Signature trees link those that share a smallest shingle by one of two hash orders, which connects
groups of copies of any size. What could still be missed must share one of the first quarter of shingles with
a class of another component; exactly these classes meet again in trees, block against block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertfold.llm.components import components
from alertfold.llm.signature_tree import THRESHOLD, SignatureTree, bitmap_of
from alertfold.llm.small_side import joined
from alertfold.llm.wordstream import BLANK_SEPARATED, mixed, pieces, release, sequence_hashes, short_batches, words_of
from alertfold.plans.storage import checkpointed

SHINGLE = 5
SAMPLED = 0.4
"""Share of shingles, by hash, in which own ones are counted."""
ORDERS = 2
BLOCK_SHINGLES, BLOCK_SETS = 1 << 21, 4096
"""A block of sets that one tree takes: about so many shingles and sets."""
SMALL = 512
"""Sets up to this size have bitmaps of as many bits, larger ones four times as many."""
_REMEMBERED = 100_000
_BITS = 53


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle): the distinct shingles of each text, in order, as numbers of 53 bits.

    A text of fewer than SHINGLE words has its whole sequence as one shingle, one without words none.
    """
    stream = words_of(texts, BLANK_SEPARATED, lower=True)
    words, starts = stream.hashes(), stream.starts_of(SHINGLE)
    text, value = [stream.text[starts]], [sequence_hashes(words, SHINGLE)[starts] if len(starts) else np.zeros(0, np.uint64)]
    for size in range(1, SHINGLE):
        short = np.flatnonzero(stream.count == size)
        if len(short):
            text.append(short)
            value.append(sequence_hashes(words, size, seed=100 + size)[stream.first[short]])
    number = np.concatenate(text).astype(np.uint64), np.concatenate(value)
    keys = (number[0] << np.uint64(_BITS)) | (number[1] >> np.uint64(64 - _BITS))
    keys.sort()
    keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
    return (keys >> np.uint64(_BITS)).astype(np.int64), keys & np.uint64((1 << _BITS) - 1)


def _sums(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    running = np.append(np.uint64(0), np.cumsum(values, dtype=np.uint64))
    return (running[last] - running[first]).view(np.int64)


_FIELDS = ["bucket", "doc", "size", "sum", "check", "loose", "token", "owner"]
_SCHEMA = (
    "bucket int, doc array<long>, size array<long>, sum array<long>, check array<long>, loose array<long>,"
    " token array<long>, owner array<long>"
)


def _profiles(docs: DataFrame) -> DataFrame:
    """Rows (doc, size, sum, check, loose) for every document, and rows (sum, shared) for sets.

    ``sum`` and ``check`` are hashes of the set. A task sends a sampled shingle that several sets of its piece
    hold for two of them only, so one that is everywhere costs two entries per piece. ``loose`` are the sampled
    shingles without those kept back; ``shared`` those of the sent ones that other sets hold too.
    """
    short_batches(docs)
    tasks = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    buckets = 8 * tasks
    limit = np.uint64(int(SAMPLED * (1 << _BITS)))
    named = docs.select(F.struct("text").alias("row"), F.col("doc_id").cast("long").alias("doc"))

    def lists(columns: list[np.ndarray | pa.Array], bucket: np.ndarray, used: np.ndarray) -> list[pa.Array]:
        cuts = pa.array(np.append(np.searchsorted(bucket, used), len(bucket)), pa.int32())
        return [pa.ListArray.from_arrays(cuts, c if isinstance(c, pa.Array) else pa.array(c)) for c in columns]

    def nothing(count: int) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.zeros(count + 1, np.int32)), pa.array([], pa.int64()))

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            text, value = shingles(texts)
            cuts = np.searchsorted(text, np.arange(len(texts) + 1))
            total = _sums(mixed(value, 1), cuts[:-1], cuts[1:])
            check = _sums(mixed(value, 2), cuts[:-1], cuts[1:])
            bucket = (mixed(total.view(np.uint64), 3) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            used = np.unique(bucket)
            sampled = value < limit
            token, owner = value[sampled].view(np.int64), total[text[sampled]]
            by_token = np.lexsort((owner, token))
            token, owner = token[by_token], owner[by_token]
            pair = np.ones(len(token), bool)
            pair[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
            token, owner = token[pair], owner[pair]
            place = np.arange(len(token)) - np.searchsorted(token, token)
            sums, back = np.unique(total, return_inverse=True)
            kept_back = np.bincount(np.searchsorted(sums, owner[place >= 2]), minlength=len(sums))[back]
            loose = np.bincount(text[sampled], minlength=len(texts)) - kept_back
            token, owner = token[place < 2], owner[place < 2]
            columns = [np.diff(cuts), total, check, loose]
            own = [batch.column("doc").take(pa.array(order)), *(c[order] for c in columns)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(used), *lists(own, bucket[order], used), nothing(len(used)), nothing(len(used))], _FIELDS
            )
            bucket = (mixed(token.view(np.uint64), 4) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            used = np.unique(bucket)
            yield pa.RecordBatch.from_arrays(
                [pa.array(used), *[nothing(len(used))] * 5, *lists([token[order], owner[order]], bucket[order], used)],
                _FIELDS,
            )

    def settle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        names = ["doc", "size", "sum", "check", "loose", "shared"]
        for batch in batches:
            columns = [batch.column(name).flatten() for name in _FIELDS[1:]]
            if len(columns[0]):
                yield pa.RecordBatch.from_arrays([*columns[:5], pa.nulls(len(columns[0]), pa.int64())], names)
            tokens.append(columns[5].to_numpy())
            owners.append(columns[6].to_numpy())
        token, owner = np.concatenate(tokens), np.concatenate(owners)
        order = np.lexsort((owner, token))
        token, owner = token[order], owner[order]
        fresh = np.append(True, token[1:] != token[:-1]) if len(token) else np.zeros(0, bool)
        pair = fresh.copy()
        pair[1:] |= owner[1:] != owner[:-1]
        holders = np.bincount(np.cumsum(fresh)[pair] - 1)
        sums, shared = np.unique(owner[pair][np.repeat(holders, holders) > 1], return_counts=True)
        none = pa.nulls(len(sums), pa.int64())
        columns = [none, none, pa.array(sums), none, none, pa.array(shared, pa.int64())]
        del token, owner, order, fresh, pair, tokens, owners
        release()
        yield pa.RecordBatch.from_arrays(columns, names)

    sent = named.mapInArrow(send, _SCHEMA).repartition(tasks, "bucket")
    return sent.mapInArrow(settle, "doc long, size long, sum long, check long, loose long, shared long")


def _least(size: Column) -> Column:
    """Shingles that a set of this size shares with any that it links with, at least."""
    return F.ceil(size * THRESHOLD / 100)


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, size, shingles, keys) of the classes in ``wanted`` (node, sum), read again from their texts."""
    named = docs.select(F.struct("text").alias("row"), F.col("doc_id").cast("long").alias("node"))
    texts = joined(named, wanted, ["node"], "inner")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, piece in pieces(batches):
            text, value = shingles(piece)
            cuts = np.searchsorted(text, np.arange(len(piece) + 1))
            right = _sums(mixed(value, 1), cuts[:-1], cuts[1:]) == batch.column("sum").to_numpy()
            rows = np.flatnonzero(right & (np.diff(cuts) > 0))
            keys = [np.minimum.reduceat(mixed(value, 80 + o), cuts[rows]).view(np.int64) for o in range(ORDERS) if len(rows)]
            use = right[text]
            ends = np.append(0, np.cumsum(np.diff(cuts)[rows])).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("node").take(pa.array(rows)),
                    pa.array(np.diff(cuts)[rows], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(value[use].view(np.int64))),
                    pa.array(list(np.stack(keys, axis=1)) if keys else [], pa.list_(pa.int64())),
                ],
                ["node", "size", "shingles", "keys"],
            )

    return texts.mapInArrow(run, "node long, size long, shingles array<long>, keys array<long>")


def _grouped(rows: DataFrame, tree: Callable[[pa.RecordBatch], SignatureTree]) -> DataFrame:
    """Links (a, b) within each ``group`` of rows (group, node, label, ...), found by one tree per group.

    Links connect the labels of a group as all its links do. A group with the same nodes as one before in its
    task adds nothing and is passed over.
    """
    tasks = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def linked(parts: list[pa.RecordBatch], seen: set[bytes]) -> pa.RecordBatch:
        batch = parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        nodes = batch.column("node").to_numpy()
        a, b = [], []
        name = hashlib.blake2b(np.sort(nodes).tobytes(), digest_size=16).digest()
        if len(nodes) > 1 and name not in seen:
            if len(seen) > _REMEMBERED:
                seen.clear()
            seen.add(name)
            found = list(tree(batch).links())
            a, b = nodes[[f[0] for f in found]] if found else [], nodes[[f[1] for f in found]] if found else []
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, seen = None, [], set()
        for batch in batches:
            group = batch.column("group").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
            for low, high in zip(cuts, cuts[1:]):
                if high > low:
                    if group[low] != current and held:
                        yield linked(held, seen)
                        held = []
                    current = group[low]
                    held.append(batch.slice(low, high - low))
        if held:
            yield linked(held, seen)
        held.clear()
        release()

    return rows.repartition(tasks, "group").sortWithinPartitions("group").mapInArrow(run, "a long, b long")


def _by_sets(batch: pa.RecordBatch) -> SignatureTree:
    """A tree that links sets exactly."""
    lists = batch.column("shingles")
    cuts = lists.offsets.to_numpy()
    values = lists.values.to_numpy()
    sets = [values[low:high] for low, high in zip(cuts, cuts[1:])]
    return SignatureTree.over(sets, batch.column("label").to_numpy())


def _by_bitmaps(batch: pa.RecordBatch) -> SignatureTree:
    """A tree that takes every pair for a link that bitmaps of shingles can't rule out."""
    rows = np.frombuffer(b"".join(batch.column("bitmap").to_pylist()), np.uint64)
    return SignatureTree(
        batch.column("size").to_numpy(), rows.reshape(batch.num_rows, -1), batch.column("label").to_numpy(), lambda a, b: True
    )


def _parts(sets: Column, elements: Column) -> Column:
    """Blocks that so many sets with so many shingles need."""
    return F.ceil(F.greatest(elements / BLOCK_SHINGLES, sets / BLOCK_SETS, F.lit(1.0))).cast("int")


def _block_pairs(parts: Column, *key: str) -> Column:
    """Groups that a row of a group cut into ``parts`` blocks belongs to, so that each pair of blocks meets."""
    own = F.pmod(F.xxhash64("node"), parts).cast("int")
    others = F.sequence(F.lit(0), parts - 1)
    return F.transform(others, lambda x: F.xxhash64(*key, F.least(own, x), F.greatest(own, x)))


def _links_by_order(sets: DataFrame) -> DataFrame:
    """Links between sets that share their smallest shingle in one of the orders; large groups in blocks.

    This connects groups of copies cheaply. What it misses between blocks or orders is found later.
    """
    keyed = sets.select("node", "size", F.posexplode("keys").alias("order", "smallest"))
    sizes = keyed.groupBy("order", "smallest").agg(F.count(F.lit(1)).alias("_sets"), F.sum("size").alias("_elements"))
    shared = joined(keyed, checkpointed(sizes.filter("_sets > 1")), ["order", "smallest"], "inner")
    block = F.pmod(F.xxhash64("node", "order"), _parts(F.col("_sets"), F.col("_elements")))
    placed = shared.select("node", F.xxhash64("order", "smallest", block).alias("group"))
    groups = checkpointed(placed.groupBy("node").agg(F.collect_list("group").alias("groups")))
    rows = joined(sets, groups, ["node"], "inner")
    return _grouped(rows.select(F.explode("groups").alias("group"), "node", F.col("node").alias("label"), "shingles"), _by_sets)


def _bitmaps(sets: DataFrame) -> DataFrame:
    """(node, size, kind, bitmap): a short bitmap up to SMALL shingles, a long one above; both near the border."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for node, size, values in zip(*(batch.column(c) for c in ("node", "size", "shingles"))):
                numbers = values.values.to_numpy()
                if len(numbers) <= SMALL:
                    rows.append((node.as_py(), size.as_py(), 0, bitmap_of(numbers, SMALL).tobytes()))
                if 100 * len(numbers) > THRESHOLD * SMALL:
                    rows.append((node.as_py(), size.as_py(), 1, bitmap_of(numbers, 4 * SMALL).tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["node", "size", "kind", "bitmap"])

    return sets.select("node", "size", "shingles").mapInArrow(run, "node long, size long, kind int, bitmap binary")


def _remaining_links(sets: DataFrame, known: DataFrame) -> DataFrame:
    """All links between components of ``known`` (node, component), or as many as connect them alike.

    Sets that link share one of their first shingles, by hash: so many that what is left can't suffice. Such
    shingles that sets of different components hold are followed up: bitmaps tell which components may link at
    all, and the sets of those are compared exactly.
    """
    labelled = joined(sets.select("node", "size", "shingles"), known, ["node"], "left").withColumn(
        "label", F.coalesce("component", "node")
    )
    first = (F.col("size") - _least(F.col("size")) + 1).cast("int")
    tokens = labelled.select("node", "label", F.explode(F.slice("shingles", F.lit(1), first)).alias("token"))
    same = Window.partitionBy("token")
    mixed_rows = checkpointed(
        tokens.select(
            "*", F.min("label").over(same).alias("low"), F.max("label").over(same).alias("high"), F.count(F.lit(1)).over(same).alias("sets")
        )
        .filter("low < high")
        .select("token", "node", "label", "sets")
    )
    members = mixed_rows.select("node", "label").distinct()
    bitmaps = checkpointed(_bitmaps(joined(sets, members.select("node"), ["node"], "left_semi")))
    shown = joined(mixed_rows, bitmaps, ["node"], "inner")
    groups = _block_pairs(_parts(F.col("sets"), F.lit(0)), "token", "kind")
    hopeful = _grouped(shown.select(F.explode(groups).alias("group"), "node", "label", "size", "bitmap"), _by_bitmaps)
    # pairs of components that may link, then groups of such components
    named = checkpointed(hopeful.distinct())
    labels = checkpointed(members)
    one, two = (labels.select(F.col("node").alias(side), F.col("label").alias(f"_{side}")) for side in ("a", "b"))
    pairs = named.join(one, "a").join(two, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    families = components(pairs).select(F.col("node").alias("label"), F.col("component").alias("family"))
    placed = checkpointed(
        labels.join(families, "label").join(sets.select("node", "size"), "node").select("node", "label", "family", "size")
    )
    sizes = placed.groupBy("family").agg(F.count(F.lit(1)).alias("_sets"), F.sum("size").alias("_elements"))
    groups = _block_pairs(_parts(F.col("_sets"), F.col("_elements")), "family")
    wanted = placed.join(sizes, "family").select("node", "label", groups.alias("groups"))
    rows = joined(sets.select("node", "shingles"), checkpointed(wanted), ["node"], "inner")
    return _grouped(rows.select(F.explode("groups").alias("group"), "node", "label", "shingles"), _by_sets)


def linked_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text).

    Documents link when 100 * intersection >= THRESHOLD * union of their shingles; a component is named by the
    smallest doc_id reachable by links. Documents without words link with nothing. A row without doc_id takes no
    part and has no component. Each row is judged by its own text; doc_id should name one text, and rows that
    share it as the smallest one of their class are one node. An empty table gives an empty one.
    """
    profiles = checkpointed(_profiles(docs))
    known = profiles.filter("size IS NOT NULL")
    shared = profiles.filter("size IS NULL").groupBy("sum").agg(F.sum("shared").alias("shared"))
    classes = checkpointed(
        known.filter("doc IS NOT NULL AND size > 0")
        .groupBy("size", "sum", "check")
        .agg(F.min("doc").alias("node"), F.min("loose").alias("loose"))
        .join(shared, "sum", "left")
        .select("size", "sum", "check", "node", (F.col("loose") - F.coalesce("shared", F.lit(0))).alias("own"))
    )
    # a set that links holds at least _least(size) shingles of others; what it certainly has of its own is too much
    near = checkpointed(classes.filter(F.col("own") <= F.col("size") - _least(F.col("size"))).select("node", "sum"))
    sets = checkpointed(_sets(docs, near))
    links = checkpointed(_links_by_order(sets))
    rest = checkpointed(_remaining_links(sets, checkpointed(components(links))))
    found = components(links.unionAll(rest))
    named = joined(classes.select("size", "sum", "check", "node"), checkpointed(found), ["node"], "left").select(
        "size", "sum", "check", F.coalesce("component", "node").alias("component")
    )
    return known.join(named, ["size", "sum", "check"], "left").select(
        F.col("doc").alias("doc_id"), F.col("size").alias("n_shingles"), F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc")).alias("component_id")
    )


def one_per_component(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id names their component, and those without doc_id, with all columns."""
    linked = linked_documents(docs.select("doc_id", "text"))
    copies = checkpointed(linked.filter("doc_id <> component_id").select("doc_id").distinct())
    return joined(docs, copies, ["doc_id"], "left_anti")
