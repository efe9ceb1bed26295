"""The ways for hot keys must give what the plain windows give."""

import random

import pytest
from pyspark.sql import functions as F

from alertfold.plans.ordered import hot_keys, nearest, numbered, previous_rows


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = []
    for i in range(3000):
        key = 0 if rng.random() < 0.5 else rng.randrange(1, 40)
        data.append((key if key != 5 else None, rng.randrange(400), i, rng.choice([None, None, i])))
    return spark.createDataFrame(data, "k long, t long, seq long, v long").cache()


def as_set(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_hot_keys_are_found(rows):
    assert hot_keys(rows, ["k"], 10_000) is None
    assert [r.k for r in hot_keys(rows, ["k"], 500).collect()] == [0]


def test_few_large_rows_are_hot_and_do_not_meet_in_one_task(spark):
    """A key of 400 texts of 64 KB (26 MB) counts as 400,000 rows; numbering them moves the texts once, by ranges."""
    text = F.repeat(F.sha2(F.col("id").cast("string"), 256), 1024)
    rows = spark.range(400).select((F.col("id") % 2 - F.col("id") % 2).alias("k"), F.col("id").alias("seq"), text.alias("text"))
    assert hot_keys(rows.drop("text"), ["k"], 100_000) is None
    assert [r.k for r in hot_keys(rows, ["k"], 100_000).collect()] == [0]
    placed = numbered(rows, ["k"], ["seq"], "n", 100_000, "total")
    assert placed.filter("n = seq + 1 AND total = 400 AND length(text) = 65536").count() == 400
    sizes = placed.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) >= 4 and max(r["count"] for r in sizes) < 200


@pytest.mark.parametrize("hot_rows", [1, 50, 500])
@pytest.mark.parametrize("keys", [["k"], []])
def test_numbering(rows, keys, hot_rows):
    want = as_set(numbered(rows, keys, ["t", "seq"], "n", None), "k", "t", "seq", "n")
    assert as_set(numbered(rows, keys, ["t", "seq"], "n", hot_rows), "k", "t", "seq", "n") == want


@pytest.mark.parametrize("hot_rows", [1, 500])
@pytest.mark.parametrize("after", [False, True])
@pytest.mark.parametrize("keys", [["k"], []])
def test_nearest(rows, keys, after, hot_rows):
    got = as_set(nearest(rows, keys, ["t", "seq"], "v", "o", after, hot_rows), "k", "seq", "o")
    data = [tuple(r) for r in rows.collect()]
    by_key = {}
    for k, t, seq, v in sorted(data, key=lambda r: (r[1], r[2])):
        by_key.setdefault(k if keys else 0, []).append((k, seq, v))
    want = []
    for group in by_key.values():
        held = None
        for k, seq, v in reversed(group) if after else group:
            want.append((k, seq, held))
            held = v if v is not None else held
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("hot_rows", [1, 500])
def test_previous_rows(rows, hot_rows):
    plain = previous_rows(rows, ["k"], ["t", "seq"], ["seq"], 3, "before", None)
    hot = previous_rows(rows, ["k"], ["t", "seq"], ["seq"], 3, "before", hot_rows)
    flat = F.transform("before", lambda b: b["seq"]).cast("string").alias("b")
    assert as_set(hot, "k", "seq", flat) == as_set(plain, "k", "seq", flat)
