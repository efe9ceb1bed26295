"""Queries over the given tables, one per operator, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertfold.llm import decontaminate, jaccard, labelled, license_scan, mixing, neighbours, packing, periodic_runs
from alertfold.llm import quality, sharding, substring_dedup, toxicity, vector_codes, warc
from alertfold.llm.small_side import joined
from alertfold.plans.storage import checkpointed, scratch_path

SHARDS = 24
TOKENIZER = "byte_bpe_50k.json"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _labels(places):
    return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")


@query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the contract's phrases; beside them those of the licenses' names, wherever they stand."""
    names = {label: name for name, label in license_scan.NAMES.items()}
    base = F.filter("places", lambda p: p["base"])
    named = F.filter("places", lambda p: ~p["base"] & p["label"].isin(*names))
    at_base, at_name = F.transform(base, lambda p: p["first"]), F.transform(named, lambda p: p["first"])
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan.scan(docs, license_scan.TEMPLATES | names, license_scan.BASE_PHRASES).select(
        "row.doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(at_base).alias("first_word"),
        F.array_max(at_base).alias("last_word"),
        _labels(base).alias("base_labels"),
        _labels(F.col("places")).alias("labels"),
        "score",
        F.size(named).cast("long").alias("n_names"),
        F.array_min(at_name).alias("first_name"),
        F.array_max(at_name).alias("last_name"),
        _labels(named).alias("name_labels"),
    )


@query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.without_repeats(docs).select(
        "row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


@query
def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized, plan = mixing.mixture(table(spark, sf_dir, "documents"))
    return mixing.joined(sized, plan, ["source"], "inner").select(
        "doc_id", "size", "source_size", "target", (F.col("size") * mixing.copies()).alias("taken")
    )


@query
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), folder)
    return warc.read_warc(spark, folder, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["last"] - h["first"] + 1)
    names = F.array_sort(F.transform("item_ids", lambda i: i.cast("string")))
    return found.select(
        "row.doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


@query
def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(vectors, vectors.filter("vec_id % 50 = 0"), 5)


def _scored(spark: SparkSession, sf_dir: str, kind, column: str, modulus: int, kept_back: int) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = kind.fit(docs, labelled.training(table(spark, sf_dir, "labels"), column, modulus, kept_back))
    return kind.score(docs, model).select("row.doc_id", "score").select(
        "doc_id",
        labelled.held_out(modulus, kept_back).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, quality, "quality", 3, 1)


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, toxicity, "toxic", 5, 0)


@query
def op8_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    narrow = docs.select(
        "doc_id",
        "text",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
    )
    return sharding.into_shards(narrow, SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


@query
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    coded, books = vector_codes.compress(vectors)
    narrow = checkpointed(
        coded.select("row.vec_id", "row.label", F.lower(F.hex("code")).alias("code"), "error")
    )
    per_label = narrow.groupBy("label").agg(F.sum("error").alias("label_error"))
    return joined(narrow, per_label, ["label"], "inner").select(
        "vec_id", "code", "error", "label_error", F.sha2(F.lit(books.text()), 256).alias("codebooks_sha256")
    )


@query
def op12_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path(TOKENIZER)).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def _planted(docs: DataFrame) -> DataFrame:
    """A tenth of the documents, chosen by the hash of doc_id, repeat a stretch of their words up to their end."""
    hashed = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0)
    n, g = F.size(words), F.floor(hashed / 10)
    at = F.pmod(g, F.greatest(n, F.lit(1))).cast("int")
    period = (1 + F.floor((n - at) / (3 + F.pmod(g, F.lit(8))))).cast("int")
    times = F.ceil((n - at) / period).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, at + 1, period), times)), F.lit(1), n - at)
    repeated = F.array_join(F.concat(F.slice(words, F.lit(1), at), tail), " ")
    chosen = (hashed % 10 == 0) & F.col("text").isNotNull() & (n > 0)
    return docs.select("doc_id", F.when(chosen, repeated).otherwise(F.col("text")).alias("text"))


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _planted(table(spark, sf_dir, "documents").select("doc_id", "text"))
    best = F.array_max(
        F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("early"), (-r["period"]).alias("short"), r["start"], r["period"]))
    )
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    found = periodic_runs.find_runs(docs).select("row.doc_id", "runs", "collapsed", best.alias("best"))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
