"""Findings of round 3 on size: what moves grows with the text, not with what is made of it."""

from __future__ import annotations

import re

import pytest

from foliant.operators import spans as SP
from foliant.plans import catalogue

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["note_areas", "main_size", "marked_blocks", "chunk_prompts"])
def test_texts_are_dealt_once(spark, name):
    """documents are dealt by paper before they are cut; no words, lines or sums of them are dealt again."""
    assert re.findall(r"Exchange hashpartitioning\((\w+)#", _plan(catalogue.queries()[name](spark, SF))) == ["doc_id"]


def test_main_sizes_and_note_areas_of_any_spans(spark):
    """ties go to the size seen first; a null text weighs nothing; a mark is the first span of its line."""
    rows = [(1, 1, 1, 0, 0, "ab", 8.0), (1, 1, 1, 0, 1, "cd", 7.0), (1, 1, 2, 0, 0, None, 3.0), (1, 1, 2, 0, 1, "x", 9.0)]
    rows += [(1, 2, 1, k, s, t, z) for k in range(2) for s, t, z in ((-1, "b", 5.0), (0, "some words", 8.5), (1, "b", 5.0))]
    rows += [(1, 3, 1, k, s, t, z) for k in range(2) for s, t, z in ((0, "long", 8.5), (1, "b", 5.0))]
    df = spark.createDataFrame(rows, "paper_id long, page long, block long, line long, span long, text string, size double")
    assert {(r.page, r.block): r.main for r in SP.main_sizes(df, SP.BLOCK).where("page = 1").collect()} == {(1, 1): 8.0, (1, 2): 9.0}
    assert [(r.page, r.block, r.marks, r.em) for r in SP.note_areas(df, 10.0).collect()] == [(2, 1, 2, 0.85)]


def test_python_holds_parts_of_batches(spark):
    """a batch goes through in parts, so that what is made of it is held a part at a time."""
    from foliant.functions import models as M
    from foliant.sources import markers as MK

    rows = spark.range(2 * M.CALL_ROWS + 1, numPartitions=1).selectExpr("id", "string(id) AS t")
    got = M.answers(rows, "t", lambda texts: [(str(len(texts)), 1) for _ in texts]).collect()
    assert len(got) == 2 * M.CALL_ROWS + 1 and {int(r.answer) for r in got} == {M.CALL_ROWS, 1}
    docs = spark.range(2 * MK.PART_ROWS + 1, numPartitions=1).selectExpr("id AS paper_id", "concat('<p data-b=\"b', id, '\">x</p>') AS html")
    assert {(r.paper_id, r.id, r.text) for r in MK.markers(docs).collect()} == {(k, f"b{k}", "x") for k in range(2 * MK.PART_ROWS + 1)}


def test_a_bucket_may_have_several_writers(spark, tmp_path):
    """a large bucket is written by several tasks, and stays whole when it is replaced."""
    from foliant.sources import documents as DO

    path = f"{tmp_path}/stored"
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20000")
    try:
        blocks = spark.range(20000, numPartitions=8).selectExpr("id % 50 AS paper_id", "id AS ord", "string(id) AS id", "sha2(string(id), 256) AS en")
        DO.save_blocks(blocks, path, 1)
        assert len(list(tmp_path.glob("stored/buckets=1/bucket=0/*.parquet"))) > 1
        DO.save_blocks(blocks.where("paper_id = 7 and ord < 100"), path)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    assert [DO.load_blocks(spark, path, k).count() for k in (7, 8)] == [2, 400]


def test_words_used_lately_stay_known():
    """op5: when a worker's words are too many, those used since the last turn are kept for one more."""
    from foliant.llm import packing

    ids = packing.ChunkIds(packing.tokenizer_path())
    want = [bytes(x) for x in ids.of([f"w{chr(97 + k % 26)}{'xyz'[k % 3]} common" for k in range(60)])]
    kept, packing.CACHE = packing.CACHE, 8
    try:
        small, asked = packing.ChunkIds(packing.tokenizer_path()), []
        words = small._words
        small._words = lambda w: asked.extend(w) or words(w)
        got = [bytes(next(iter(small.of([f"w{chr(97 + k % 26)}{'xyz'[k % 3]} common"])))) for k in range(60)]
    finally:
        packing.CACHE = kept
    assert got == want and asked.count("common") == 1
