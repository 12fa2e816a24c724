"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, for every operator and stage."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foliant.llm import decontam, html_text, line_dedup, minhash, packing, pii, quality, topk, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, _row int, key string, h1 int, `Text` string, owner string"
LONG = "word " * 30_000 + "x" * 50_000 + " " + "1" * 20_000 + "\n" * 500 + "a@b." * 2_000
BASE = [(1, "Some line of text here\nshort\nSome line of text here"), (2, "some LINE of text here \nother words in this line"), (3, None), (4, ""), (None, "Some line of text here"), (5, LONG), (6, "Some line of text here\nshort\nSome line of text here"), (6, "Some line of text here\nshort\nSome line of text here"), (7, " \t\n "), (8, "é" * 12 + "\n日本語 テキスト 文字列 です よ")]


def table(spark, rows, schema=SCHEMA):
    extra = ("en", "src", 1, "own", 3, "k", 4, "T", "o")
    return spark.createDataFrame([(i, t, *extra) for i, t in rows], schema)


@pytest.fixture(scope="module")
def docs(spark):
    spark.conf.set("spark.sql.caseSensitive", "true")  # so that the table can be made
    df = table(spark, BASE)
    yield df
    spark.conf.set("spark.sql.caseSensitive", "false")


@pytest.fixture(scope="module")
def plain(spark):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in BASE], "doc_id long, text string, lang string, source string, n_chars long")


def benchmark(spark, rows=((1, "some line of text here"), (2, None), (3, ""), (None, "other words"))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def labels(spark, rows=((1, 1, 0), (2, 0, 1), (5, None, None), (None, 1, 1))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


OPERATORS = {
    "lines": lambda s, d: line_dedup.dedup_lines(d),
    "near": lambda s, d: minhash.near_duplicates(d, shingle=2),
    "contamination": lambda s, d: decontam.decontaminate(d, benchmark(s)),
    "pack": lambda s, d: packing.pack(d),
    "pii": lambda s, d: pii.detect(d),
    "quality": lambda s, d: quality.classify(d, quality.learn(d, labels(s))),
    "accepted": lambda s, d: quality.accepted(d, quality.learn(d, labels(s))),
    "toxicity": lambda s, d: toxicity.classify(d, toxicity.learn(d, labels(s))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_has_a_result(spark, docs, name):
    out = OPERATORS[name](spark, docs).collect()
    if name == "pack":
        assert len({(r.doc_id, r.piece) for r in out}) == len(out) - 1  # one row repeats
    elif name != "accepted":
        assert len(out) == len(BASE)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, docs, name):
    assert OPERATORS[name](spark, docs.limit(0)).collect() == []


def test_line_results(spark, docs):
    out = {(r.doc_id, r._n_dropped): r._kept for r in line_dedup.dedup_lines(docs).collect()}
    assert out[1, 0] == BASE[0][1]
    assert out[2, 1] == "other words in this line"
    assert out[3, 0] == out[4, 0] == ""
    assert out[None, 1] == "" and out[6, 2] == "short"


def test_near_results(spark, docs):
    out = minhash.near_duplicates(docs, shingle=2).collect()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert [(r.component_id, r.kept) for r in by[6]] == [(1, False)] * 2
    assert by[3][0].n_shingles == 0 and by[3][0].kept and by[7][0].kept
    assert by[None][0].component_id is None and by[None][0].kept


def test_contamination_results(spark, docs):
    out = {r.doc_id: r for r in decontam.decontaminate(docs, benchmark(spark)).collect()}
    assert out[1].n_hit == 10 and out[1].contaminated and out[1].items == ["1"]
    assert out[2].n_hit == 7 and out[2].n_items == 1
    assert out[3].n_words == 0 and not out[3].contaminated
    none = decontam.decontaminate(docs, benchmark(spark).limit(0)).collect()
    assert len(none) == len(BASE) and not any(r.n_hit for r in none)


def test_pieces_of_a_long_text(spark, docs):
    out = [r for r in packing.pack(docs).collect() if r.doc_id == 5]
    out.sort(key=lambda r: r.piece)
    assert [r.start for r in out] == [4096 * r.piece for r in out] and all(r.length == 4096 for r in out[:-1])


def test_pages(spark, tmp_path):
    spark.conf.set("spark.sql.caseSensitive", "true")
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>x" * 40), (3, "a\r\nX: y", "<p>x" * 40), (3, "u", "<p>x" * 40), (4, "u", "<p>x" * 40)]
    pages = spark.createDataFrame([(*r, "c", b"p", "h") for r in rows], "page_id long, url string, html string, digest string, payload binary, header string")
    text = html_text.extract_pages(pages).collect()
    assert len(text) == 6 and all(r.n_chars == len(r.text) for r in text) and text[0].text == ""
    path = str(tmp_path / "pages")
    warc.write_archive(pages, path)
    got = warc.read_pages(spark, path).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in got) == [(0, "revisit", 3), (1, "response", 0), (2, "response", 0), (3, "response", 0), (3, "response", 0), (4, "revisit", 3)]
    assert {r.refers_to for r in got if r.record_type == "revisit"} == {3}
    empty = str(tmp_path / "empty")
    warc.write_archive(pages.limit(0), empty)
    assert warc.read_pages(spark, empty).collect() == [] and html_text.extract_pages(pages.limit(0)).collect() == []


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (50, [1.0, 0.5]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [1.0, 0.5]), (5, [1.0, 0.5]), (6, []), (7, [-0.001, 2.0**40]), (None, [1.0, 1.0])]
    v = spark.createDataFrame([(*r, 1, True) for r in rows], "vec_id long, embedding array<double>, row int, query boolean")
    out = topk.top_k(v, F.expr("id % 50 = 0")).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in out] == [(0, 1, 7), (0, 2, None), (0, 3, 5), (0, 4, 5), (0, 5, 50), (50, 1, 7), (50, 2, None), (50, 3, 0), (50, 4, 5), (50, 5, 5)]
    assert topk.top_k(v.limit(0), F.expr("id % 50 = 0")).collect() == topk.top_k(v, F.expr("id < 0")).collect() == []


def test_repeated_and_null_ids_in_small_blocks(spark, monkeypatch):
    """Every row counts for itself, whatever the blocks are."""
    import random

    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 31)
    rng = random.Random(12)
    rows = [(rng.choice([None, 0, 50, 100, *range(1, 20)]), [rng.choice((-0.5, 0.25, 0.5)) for _ in range(4)]) for _ in range(150)]
    got = Counter(tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.expr("id % 50 = 0")).select("query_id", "rank", "vec_id", "score").collect())
    want = Counter()
    for i, (q, x) in enumerate(rows):
        if q is not None and q % 50 == 0:
            scored = [(-sum(int(256 * a) * int(256 * b) for a, b in zip(x, y, strict=True)), c is None, c or 0, c) for j, (c, y) in enumerate(rows) if j != i]
            want.update((q, rank, c, -s) for rank, (s, _, _, c) in enumerate(sorted(scored, key=lambda t: t[:3])[:5], 1))
    assert got == want


def test_vectors_of_one_id_all_count(spark, tmp_path):
    import random

    import duckdb

    rng = random.Random(11)
    rows = [(rng.choice([0, 50, 100, *range(1, 20)]), [rng.uniform(-1, 1) for _ in range(6)]) for _ in range(120)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in topk.query(spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect())
    sql = duckdb.connect()
    sql.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert got == sorted(sql.execute(f"SELECT query_id, rank, vec_id, score FROM ({topk.ORACLE})").fetchall())


def test_stages_keep_clashing_names(spark, docs, tmp_path):
    """Columns that differ in case alone, or like the operators' own, come back in order with their values."""
    benchmark(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    extra = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for own in (docs, docs.limit(0)):
            out = stage(spark, own, str(tmp_path))
            assert out.columns == docs.columns, name
            rows = out.collect()
            at = [docs.columns.index(c) for c in extra]
            assert all(tuple(r[k] for k in at) == ("en", "src", "own", 3, "k", 4, "T", "o") for r in rows), name
            assert bool(rows) == (own is docs) or name == "quality classifier"


def test_stages(spark, plain, tmp_path):
    benchmark(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for docs in (plain, plain.limit(0)):
            out = stage(spark, docs, str(tmp_path))
            rows = out.collect()
            assert name == "best-fit packing" or out.columns == plain.columns
            assert len(rows) > 0 or docs is not plain or name == "quality classifier"
    near = corpus_pipeline.unlike_others(spark, plain, str(tmp_path)).where(F.col("doc_id").isNotNull())
    assert near.where("doc_id in (1, 6)").count() == 1
