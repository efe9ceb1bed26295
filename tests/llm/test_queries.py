"""Registered queries against their SQL, and the pipeline against its operators, on the smallest data."""

import os
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as contract
import corpus_pipeline
from alertfold.llm.oracles import ORACLES
from alertfold.llm.queries import QUERIES
from alertfold_checks.verify import connect, rows_of

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    frame = contract.queries()[name](spark, SF_DIR)
    result = connect(SF_DIR).execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(frame.columns)
    assert rows_of(frame.columns, frame.collect()) == rows_of(columns, result.fetchall())


def test_all_operators_and_the_pipeline_are_registered():
    assert {int(name[2:].split("_")[0]) for name in QUERIES} == set(range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(contract.queries())


def test_packed_pieces_are_slices_of_their_documents(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {
        r.doc_id: np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")
        for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    }
    covered, used = {doc: 0 for doc in want}, {}
    for r in contract.queries()["op12_pack"](spark, SF_DIR).orderBy("doc_id", "start").collect():
        ids = want[r.doc_id]
        assert r.start == covered[r.doc_id] and r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        covered[r.doc_id] += r.length
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert covered == {doc: len(ids) for doc, ids in want.items()}
    sizes = []
    for parts in used.values():
        offset = 0
        for at, length in sorted(parts):
            assert at == offset
            offset += length
        sizes.append(offset)
    assert max(sizes) <= 1024
    assert sum(1024 - n for n in sizes if n & (n - 1)) < 0.01 * sum(sizes)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_DIR)
        path = corpus_pipeline.scratch_path(spark, f"test-{name}")
        out.write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        seen[name] = (before, docs)
        assert docs.columns[: len(before.columns)] == before.columns
    for name in ("quality", "near_copies", "decontamination"):
        before, after = seen[name]
        assert after.exceptAll(before).count() == 0 and after.count() > 0.5 * before.count()
    assert seen["mixture"][1].select("doc_id").subtract(seen["mixture"][0].select("doc_id")).count() == 0
    final = seen["shards"][1]
    assert final.count() == seen["mixture"][1].count()
    assert sorted(map(str, final.collect())) == sorted(map(str, corpus_pipeline.run(spark, SF_DIR).collect()))
