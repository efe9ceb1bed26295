import random

from pyspark.sql import functions as F

from alertfold.functions.distance import byte_levenshtein
from alertfold.functions.templates import text_matches, equivalent, matches, parse_header


CASES = [
    ("disk ? full", "disk 9 full", True),
    ("disk ?? full", "disk 95 full", True),
    ("disk ? full", "disk 12345 full", True),
    ("disk ? full", "disk ab full", False),
    ("disk ?? full", "disk ab full", True),
    ("disk ?", "disk ", True),
    ("disk", "disk\n", False),
    ("a.b*c", "a.b*c", True),
    ("a.b*c", "axbbc", False),
    ("[\\s\\S] (x) {1} ^$| +\\", "[\\s\\S] (x) {1} ^$| +\\", True),
    ("? €", "é €", True),
    ("?", "𝄞", True),
    ("?", "\n", True),
    ("", "", True),
    ("???", "", True),
    ("?5", "995", True),
    ("?5x", "99x", False),
    ("? ?", "12 34", True),
    ("?a", "ba", True),
    ("?a", "bba", False),
]


def test_matching(spark):
    df = spark.createDataFrame(CASES, "template string, text string, want boolean")
    got = df.select("template", "text", "want", matches(F.col("template"), F.col("text")).alias("got")).collect()
    assert [r for r in got if r.got != r.want] == []
    assert all(text_matches(t, x) == want for t, x, want in CASES)


def test_equivalence_needs_both_directions(spark):
    df = spark.createDataFrame([("a ??", "a ??"), ("a ?", "a ??"), ("a ??", "a 1")], "a string, b string")
    assert [r[0] for r in df.select(equivalent(F.col("a"), F.col("b"))).collect()] == [True, False, False]


def test_headers(spark):
    texts = [
        ("3 similar messages were received:\ndisk ?? full",),
        ("3 disks failed",),
        ("x 3 similar messages were received:\ny",),
        ("12 similar messages were received:\n",),
    ]
    count, template = parse_header(F.col("text"))
    rows = spark.createDataFrame(texts, "text string").select(count.alias("c"), template.alias("t")).collect()
    assert [tuple(r) for r in rows] == [
        (3, "disk ?? full"),
        (0, "3 disks failed"),
        (0, "x 3 similar messages were received:\ny"),
        (12, ""),
    ]


def test_distance_counts_bytes(spark):
    df = spark.createDataFrame([("été 5", "ete 7"), ("a b c d", "a b c d"), ("", "é")], "a string, b string")
    assert [r[0] for r in df.select(byte_levenshtein(F.col("a"), F.col("b"))).collect()] == [5, 0, 2]
    limited = df.select(byte_levenshtein(F.col("a"), F.col("b"), F.lit(3)))
    assert [r[0] for r in limited.collect()] == [-1, 0, 2]


def test_matching_is_the_same_in_and_outside_expressions(spark):
    rng = random.Random(2)
    piece = lambda: "".join(rng.choice("a0?.[é\n") for _ in range(rng.randrange(6)))
    pairs = [(piece(), piece().replace("?", "1")) for _ in range(1500)]
    df = spark.createDataFrame(pairs, "template string, text string")
    got = df.select("template", "text", matches(F.col("template"), F.col("text")).alias("m")).collect()
    assert [r for r in got if r.m != text_matches(r.template, r.text)] == []
    assert any(r.m for r in got)


def test_ambiguous_templates_end_soon(spark):
    """A regex would try every way to place the wildcards."""
    template, text = " ?" * 60 + "x", " " * 120
    assert not text_matches(template, text)
    df = spark.createDataFrame([(template, text), (" ?" * 60, text)], "a string, b string")
    assert [r[0] for r in df.select(matches(F.col("a"), F.col("b"))).collect()] == [False, True]


def test_literals_that_look_like_patterns(spark):
    literals = ["a\\E", "\\Q(", "$b", "[0-9]", "\\", "x\ny", "\\E\\E"]
    rows = [(f"{a}?{b}??", f"{a}{x}{b}{y}") for a in literals for b in literals for x in ("7", "z", "") for y in ("12345", "é!", "")]
    rows += [(a, b) for a in literals for b in literals] + [("?", "7\n"), ("7", "7\n"), (None, "a"), ("a", None), ("", "")]
    frame = spark.createDataFrame(rows, "template string, text string")
    found = frame.select("*", matches(F.col("template"), F.col("text")).alias("ok")).collect()
    for r in found:
        assert bool(r.ok) == (r.template is not None and r.text is not None and text_matches(r.template, r.text)), r
