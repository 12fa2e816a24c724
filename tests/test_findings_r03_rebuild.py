"""Findings of round 3 on rebuilt lists: places by the text before them, starts that come with their own fragment alone, stretches formed once."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from foliant.operators import offsets as O
from foliant.operators import rebuild as RB

BLOCK = "paper_id long, ord long, id string, type string, page long, band string, en string"
ANCHOR = "paper_id long, id long, block_id string, lang string, start long, end long"


def _list(spark, n=30):
    """n entries, each cut in the middle: a fragment holds the end of one and the beginning of the next."""
    entries = [f"[{k + 1}] Adams, A. Title  number {k}. J. {1980 + k}." for k in range(n)]
    cut = [f"{a[25:]} {b[:25]}".strip() for a, b in zip(["", *entries], [*entries, ""])]
    return spark.createDataFrame([(1, k, f"b-{k + 1:04d}", "refs", 1, None, x) for k, x in enumerate(cut)], BLOCK), cut


def test_places_by_the_text_before_them(spark):
    """where a sign goes is told by squeezing what stands before it, as the map of all words tells it."""
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab𝛼 \t\n\x0b") for _ in range(rng.randrange(1, 14))) for _ in range(150)]
    rows = [(t, s, e) for t in texts if t.strip() for s in range(len(t)) for e in (s + 1, len(t), len(t) + 2) if e > s]
    df = spark.createDataFrame(rows, "t string, s int, e int").withColumns({"m": O.squeeze_map(F.col("t")), "n": F.length(O.squeezed(F.col("t")))})
    old, new = O.moved_range(F.col("m"), F.col("s"), F.col("e")), O.squeezed_range(F.col("t"), F.col("n"), F.col("s"), F.col("e"))
    assert df.where((old[0] != new[0]) | (old[1] != new[1]) | new[0].isNull() | new[1].isNull()).collect() == [] and len(rows) > 500


def test_a_fragment_brings_its_own_starts(spark):
    """the starts of a whole list don't come with each of its fragments."""
    moves = RB.Rebuild(_list(spark)[0]).moves().collect()
    assert len(moves) == 31 and sum(len(r.starts) for r in moves) <= 30
    assert sorted(r.before for r in moves) == [1, *range(1, 31)]


def test_anchors_by_own_starts(spark):
    """an anchor at each sign goes to the entry that has it, with the same sign."""
    blocks, cut = _list(spark)
    done = RB.Rebuild(blocks)
    text = {r.id: r.en for r in done.after().collect()}
    anchors = [(1, 1000 * k + s, f"b-{k + 1:04d}", "en", s, s + 1) for k, x in enumerate(cut) for s in range(len(x))]
    got = done.anchors(spark.createDataFrame(anchors, ANCHOR)).collect()
    assert len(got) == len(anchors)
    for r in got:
        sign = cut[r.id // 1000][r.id % 1000]
        assert r.moved and (sign == " " or text[r.block_id][r.start : r.end] == sign), r


def test_a_report_forms_stretches_once(spark):
    """counts and moves are read from what was written once; Python reads no stream again."""
    blocks, _ = _list(spark)
    anchors = spark.createDataFrame([(1, 1, "b-0003", "en", 2, 4), (1, 2, "b-9999", "en", 2, 4), (2, 3, "b-0003", "en", 2, 4)], ANCHOR)
    done = RB.Rebuild(blocks).report(anchors)
    assert "EvalPython" not in done._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in done.collect()] == [(1, True, 31, 30, 0, 1)]


def test_streams_are_read_one_at_a_time(spark):
    """Python gets streams as Arrow arrays, without a second copy of the batch as objects."""
    plan = RB.Rebuild(_list(spark)[0]).after()._jdf.queryExecution().executedPlan().toString()
    assert "_found(" in plan and "_starts(" not in plan
