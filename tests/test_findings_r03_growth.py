"""Findings of round 3 on growth: the same results from less work for each sign, word, line or row."""

from __future__ import annotations

import random
import re
import time
from collections import Counter

from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import geometry as G
from foliant.operators import validate as VA
from foliant.plans import catalogue
from foliant.sources import layout as LA


def _seconds(df) -> float:
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def _math(t: str) -> bool:
    q = re.sub(r"^ | \Z", "", re.sub(r"[ \t\n\r\f\x0b]+", " ", t))
    n = len(re.findall("[A-Za-z]{3,}", q))
    return any(c in T.MATH_CHARS for c in q) or bool(re.search(r"\( *[0-9]{1,2} *\)\Z", q)) and n < 8 or "=" in q and n < 4 and len(q) < 160


def test_flags_of_odd_texts(spark):
    """F16: shortcuts flag what the whole text would have: blanks of all kinds around a number, signs beside the mathematical ones, words just too many."""
    chance = random.Random(5)
    some = ["(", "7", "12", ")", "=", " ", "\t", "\x0b", "\n", " ", "abc ", "word word word ", "∑", "·", "é", "’", "译", "x" * 150, "pp.", "vol.", " doi:", ", 1999", "Proc.", "[12]", "Figure"]
    texts = ["".join(chance.choices(some, k=chance.randint(0, 9))) for _ in range(600)] + list(T.MATH_CHARS) + [chr(ord(c) + 1) for c in T.MATH_CHARS]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    for r in df.select("t", T.looks_math(t).alias("m"), T.reference_like(t).alias("r"), T.caption_like(t).alias("c"), T.numbered_reference(t).alias("n")).collect():
        assert r.m == _math(r.t), r.t
        assert r.r == bool(re.search(r"(?<![0-9A-Za-z_])(?:pp\.|vol\.|Proc\.|doi:)|IEEE Trans|arXiv:|,[ \t\n\r\f]*(?:19|20)[0-9]{2}(?![0-9A-Za-z_])", r.t)), r.t
        bare = r.t.lstrip(" \t\n\r\f")
        assert r.c == bool(re.match(r"(fig|figure|table|tab\.|表|图)", bare.lower())) and r.n == bool(re.match(r"\[[0-9]{1,3}\]", bare)), r.t
    assert spark.range(1).select(T.looks_math(F.lit(None).cast("string")).alias("x")).first().x is None


def test_flags_cost_little_more_than_reading(spark):
    """F16: a class of a hundred signs isn't tried in turn on each letter, and plain texts aren't squeezed."""
    df = spark.range(400, numPartitions=1).select(F.repeat(F.lit("some plain words of a text "), 1000).alias("t")).localCheckpoint()
    plain = lambda: _seconds(df.select(F.regexp_count("t", F.lit("[#@]")).alias("n")))
    flags = lambda: _seconds(df.select(T.looks_math(F.col("t")).alias("n")))
    plain(), flags()
    assert min(flags() for _ in range(3)) < 6 * min(plain() for _ in range(3)) + 0.1


def test_rules_by_one_sort(spark):
    """rules of odd segments (turned round, of no end, equal ones) by the runs of a sort, with no table of runs beside it."""
    chance = random.Random(7)
    rows = [(1, chance.randint(1, 60), k, chance.choice([None, 0.0, float(chance.randint(0, 90)), float(chance.randint(0, 90))]), float(chance.randint(0, 2)), chance.choice([None, float(chance.randint(0, 130)), float(chance.randint(0, 130))])) for k in range(600)]
    df = spark.createDataFrame(rows, "paper_id long, page long, id long, x0 double, y0 double, x1 double")
    done = G.stitched_rules(df, dy=1.0, gap=0.5, least=0.1, width=100.0)
    assert "Aggregate" not in done._jdf.queryExecution().executedPlan().toString()
    least, want = lambda v: (v is not None, v or 0.0), []
    for page in range(1, 61):
        for y in (0, 1, 2):
            runs, reach = [], None
            for _, _, _, x0, _, x1 in sorted((r for r in rows if r[1] == page and r[4] == y), key=lambda r: (least(r[3]), least(r[5]), r[2])):
                if x0 is None or reach is None or not x0 - reach <= 0.5:
                    runs.append([])
                runs[-1].append((x0, x1))
                reach = x1 if reach is None else reach if x1 is None else max(reach, x1)
            for run in runs:
                low, high = [a for a, _ in run if a is not None], [b for _, b in run if b is not None]
                if low and high and max(high) - min(low) >= 10:
                    want.append((1, page, y, min(low), max(high), len(run)))
    assert sorted(map(tuple, done.collect())) == sorted(want) and len(want) > 10


def test_lost_words_by_counting(spark):
    """words outside mathematics, with those of commands inside it, counted; both texts are compared once."""
    chance = random.Random(9)
    some = ["alpha", "beta", "Alpha ", " ", "cata-\n", "logue", "- ", r"\(", r"\)", r"\[", r"\]", r"\text{", "}", "<b>", "\u0001", "\u0002", "longer words here ", "longer"]
    pairs = [tuple("".join(chance.choices(some, k=chance.randint(0, 14))) for _ in "ab") for _ in range(500)] + [(None, "some"), ("some", None), (None, None)]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, a string, b string")
    own = [df.select("k", T.prose_words(F.col(c)).alias("w")) for c in "ab"]
    words = [{r.k: r.w for r in o.collect()} for o in own]
    for r in df.select("*", VA.lost_words(F.col("a"), F.col("b")).alias("got")).collect():
        was, now = words[0][r.k], words[1][r.k]
        assert r.got.words == (None if was is None else len(was))
        assert r.got.lost == (None if was is None or now is None else sorted(Counter(was) - Counter(now))), r
    plan = catalogue.queries()["latex_fidelity"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\+- ArrowEvalPython|ArrowEvalPython \[", plan)) == 1 and "aggregate(" not in plan and "array_sort" not in plan


def test_prose_words_of_any_text(spark):
    """what is skipped where there is no sign of it changes no words: a plain form of the same in Python."""
    chance = random.Random(3)
    some = ["alpha", "beta", "ab", "K", "é", "- ", "-", "\u00ad", " ", r"\(", r"\)", r"\[", r"\]", r"\text{", r"\mbox {", "{", "}", "<b>", "<", ">", "\u0001", "\u0002", "\\", "\n"]
    texts = ["".join(chance.choices(some, k=chance.randint(0, 16))) for _ in range(1500)]

    def plain(c: str) -> list[str]:
        for _ in range(3):
            c = re.sub("([A-Za-z])-[ \\t\\n\\r\u00ad]+([a-z])", r"\1\2", c)
        kept = re.sub(T.TEXT_COMMAND, "\u0001\\1\u0002", c)
        region = re.compile(r"\\\(.*?\\\)|\\\[.*?\\\]", re.S)
        inside = " ".join(" ".join(re.findall("\u0001([^\u0001\u0002]*)\u0002", m)) for m in region.findall(kept))
        outside = re.sub(T.TAG, " ", region.sub(" ", re.sub("[\u0001\u0002]", " ", kept)))
        return [w.lower() for w in re.findall("[A-Za-z]{4,}", f"{outside} {inside}")]

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", T.prose_words(F.col("t")).alias("w")).collect():
        assert r.w == plain(r.t), repr(r.t)


def test_layouts_are_read_once(spark):
    """pages, text and rules come of one reading, of the columns that they need."""
    plan = catalogue.queries()["layout_pages"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("RelationV2", plan)) == 1 and "Join" not in plan


def test_written_layouts_are_bounded_files(spark, tmp_path):
    """a file holds FILE_PAGES pages at most, however many a task writes; none is read again for each of its ranges."""
    pages = spark.range(3 * LA.FILE_PAGES + 1, numPartitions=1).select(F.lit("d").alias("document"), F.col("id").cast("int").alias("page"))
    LA.write_layouts(pages, str(tmp_path / "layouts"))
    sizes = [len(p.read_text().splitlines()) for p in (tmp_path / "layouts").glob("part-*")]
    assert sorted(sizes) == [1, *[LA.FILE_PAGES] * 3]
    assert LA.read_layouts(spark, str(tmp_path / "layouts")).select("page").distinct().count() == 3 * LA.FILE_PAGES + 1
