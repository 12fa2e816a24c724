"""The layout source: ranges of pages, named columns, filters, files that fail; and the ledger of model calls."""

import json
import os
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from foliant.functions import ledger as L
from foliant.sources import layout as LA


@pytest.fixture
def folder(tmp_path):
    for name, n in (("one", 3), ("two", 40)):
        pages = [{"document": name, "width": 600.0, "height": 800.0, "rotation": 0, "spans": [{"text": f"{name} {k}", "size": 9.5, "x0": 1.0, "y0": 2.0, "x1": 3.0, "y1": 4.0}], "drawings": [{"kind": "l", "x0": 0.0, "y0": 9.0, "x1": 500.0, "y1": 9.5 + k % 2 * 9, "color": 255, "width": 0.5}]} for k in range(1, n + 1)]
        (tmp_path / f"{name}.jsonl").write_text("\n".join(map(json.dumps, pages)))
    (tmp_path / "bad.jsonl").write_text('{"document": "bad"}\n{broken')
    return str(tmp_path)


def test_pages_and_failures(spark, folder):
    """The page before the fault is read; the file's fault is a row of its own."""
    rows = LA.read_layouts(spark, folder, splitBytes="2000", pagesPerTask="7").collect()
    assert sorted((r.document, r.page) for r in rows if r.error is None) == sorted([("bad", 1), *(("one", k) for k in (1, 2, 3)), *(("two", k) for k in range(1, 41))])
    (failed,) = [r for r in rows if r.error]
    assert failed.path.endswith("bad.jsonl") and failed.page is None and "JSONDecodeError" in failed.error
    assert rows[0].spans is None or rows[0].spans[0].text
    with pytest.raises(Exception, match="JSONDecodeError"):
        LA.read_layouts(spark, folder, mode="failfast").collect()


def test_partitions_follow_bytes_and_pages(spark, folder):
    assert LA.read_layouts(spark, folder).rdd.getNumPartitions() == 1
    # the large file in tasks of seven pages, both small ones together
    assert LA.read_layouts(spark, folder, splitBytes="2000", pagesPerTask="7").rdd.getNumPartitions() == 7
    assert LA.read_layouts(spark, folder, splitBytes="2000", pagesPerTask="7", firstPage="8", lastPage="20").rdd.getNumPartitions() == 3


#: Workers may have been started before the test, so the name is agreed on.
WATCHED = f"{tempfile.gettempdir()}/foliant-watched-{os.getuid()}"


class Watched(LA.JsonPages):
    """Notes which pages and columns it was asked for."""

    def pages(self, file, first, last, columns):
        with open(WATCHED, "a") as f:
            f.write(json.dumps([first, last, sorted(columns)]) + "\n")
        yield from super().pages(file, first, last, columns)


def test_columns_and_filters_reach_the_decoder(spark, folder):
    open(WATCHED, "w").close()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        options = {"decoder": "tests.test_layout_source:Watched", "pushdown": "true", "suffix": "two.jsonl"}
        named = LA.read_layouts(spark, folder, "document string, page int", **options).where("page >= 5 and page < 9")
        got = named.collect()
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    assert sorted(r.page for r in got) == [5, 6, 7, 8]
    with open(WATCHED) as f:
        assert [json.loads(line) for line in f] == [[5, 8, ["document", "page"]]]


def test_thin_lines(spark, folder):
    rows = LA.thin_lines(LA.read_layouts(spark, folder, suffix="two.jsonl"))
    assert rows.count() == 20 and rows.where("y1 - y0 > 2").count() == 0


def test_round_trip(spark, folder, tmp_path):
    pages = LA.read_layouts(spark, folder, suffix="one.jsonl").drop("path", "error")
    LA.write_layouts(pages, str(tmp_path / "again"))
    again = LA.read_layouts(spark, str(tmp_path / "again"))
    assert sorted(map(str, again.drop("path", "error").select(pages.columns).collect())) == sorted(map(str, pages.collect()))


def test_a_failed_job_keeps_its_charges(spark, tmp_path):
    """A model that raises half-way: what it answered is charged once, and asked for no more."""
    calls, broken, path = str(tmp_path / "calls"), str(tmp_path / "broken"), str(tmp_path / "ledger")
    open(broken, "w").close()

    def model(texts):
        if os.path.exists(broken) and any("150" in t for t in texts):
            raise RuntimeError("out of credit")
        with open(calls, "a") as f:
            f.writelines(f"{t}\n" for t in texts)
        return [(t.upper(), len(t)) for t in texts]

    rows = spark.range(200).select("id", F.concat(F.lit("text "), F.col("id").cast("string")).alias("text")).coalesce(1)
    with pytest.raises(Exception, match="out of credit"):
        L.answered(rows, "id", "text", model, path).collect()
    before = open(calls).read().splitlines()
    charged = L.charges(spark, path).count()
    assert 0 < charged == len(before) < 200
    os.remove(broken)
    got = L.answered(rows, "id", "text", model, path).collect()
    assert len(got) == 200 and all(r.answer == r.text.upper() and r.tokens == len(r.text) for r in got)
    after = open(calls).read().splitlines()
    assert len(after) == 200 == len(set(after)) and after[: len(before)] == before
    assert [tuple(r) for r in L.spent(spark, path).collect()] == [(1, 200, sum(map(len, after)))]
    # another run asks nothing; another try asks anew
    assert L.answered(rows, "id", "text", model, path).count() == 200 and len(open(calls).read().splitlines()) == 200
    L.answered(rows.where("id < 5"), "id", "text", model, path, attempt=2).collect()
    assert {r["try"]: r.calls for r in L.spent(spark, path).collect()} == {1: 200, 2: 5}


def test_what_was_written_twice_counts_once(spark, tmp_path):
    path = str(tmp_path / "ledger")
    model = lambda texts: [(t, 1) for t in texts]
    L._asked(model, ["1", "2"], ["a", "b"], 1, path)
    L._asked(model, ["2", "3"], ["b", "c"], 1, path)
    assert [tuple(r) for r in L.spent(spark, path).collect()] == [(1, 3, 3)]
    assert L.spent(spark, str(tmp_path / "none")).collect() == []


def test_quick_calls_share_a_file(tmp_path):
    """files don't grow in number with the calls; a slow model's answers are each charged at once, and a retry takes up where the parts end."""
    path, keys, calls = tmp_path / "ledger", [f"{k:04d}" for k in range(1000)], []
    files = lambda: sorted(path.rglob("*.parquet"))

    def model(texts):
        calls.append(len(texts))
        if texts[0] == "0320" and len(files()) < 3:
            raise RuntimeError("out of credit")
        if texts[0] in ("0064", "0128"):
            time.sleep(L.HELD)
        return [(t, 1) for t in texts]

    with pytest.raises(RuntimeError, match="out of credit"):
        L._asked(model, keys, keys, 1, str(path) + "/")
    assert len(files()) == 3 and sum(calls) == 352
    for _ in range(2):
        assert L._asked(model, keys, keys, 1, str(path) + "/").column("answer").to_pylist() == keys
    assert len(files()) == 4 and sum(calls) == 352 + 1000 - 320
