"""Rebuilt reference lists and notes: every style, page furniture, quoted anchors, a second run, white space by brute force."""

import random

import pytest
from pyspark.sql import functions as F

from foliant.operators import offsets as O
from foliant.operators import rebuild as RB

BLOCK = "paper_id long, ord long, id string, type string, page long, band string, en string"
ANCHOR = "paper_id long, id long, block_id string, lang string, start long, end long"
STYLES = {
    "bracket": ["[1] Adams, A. A first title. J. 2001.", "[2] Brown, B. A second title, longer. J. 2002.", "[3] Clark, C. A third title. J. 2003.", "[4] Dale, D. The last. 2004."],
    "stop": ["7. Adams, A. A first title. J. 2001.", "8. Brown, B. A second title. J. 2002.", "10. Clark, C. A third title. J. 2003."],
    "author": ["Adams, A. B. (2001). A first title. J.", "Brown, B., & Clark, C. (2002). A second title. J.", "De Vries, D. (2003). A third title. J."],
}


def blocks(spark, parts):
    """A heading, then (type, page, band, text)."""
    rows = [(1, 0, "b-0001", "h2", 1, None, "References"), *((1, k, f"b-{k + 1:04d}", *p) for k, p in enumerate(parts, 1))]
    return spark.createDataFrame(rows, BLOCK)


@pytest.mark.parametrize("style", STYLES)
def test_an_entry_cut_by_furniture_is_one(spark, style):
    """The stream is cut in pieces of 23 signs at blanks; a footer and a header stand between the pages."""
    words, pieces = " ".join(STYLES[style]).split(" "), [""]
    for w in words:
        if len(pieces[-1]) > 23:
            pieces.append("")
        pieces[-1] = f"{pieces[-1]} {w}".strip()
    half = len(pieces) // 2
    parts = [("refs", 1, None, p) for p in pieces[:half]] + [("refs", 1, "foot", "12"), ("refs", 2, "head", "A head")] + [("refs", 2, None, p) for p in pieces[half:]] + [("p", 2, None, "The end.")]
    before = blocks(spark, parts)
    done = RB.Rebuild(before)
    after = done.after()
    rows = after.orderBy("place").collect()
    assert [r.en for r in rows if r.type == "ref"] == STYLES[style]
    assert [r.en for r in rows if r.band] == ["12", "A head"] and rows[0].en == "References" and rows[-1].en == "The end."
    assert [r.page for r in rows] == sorted(r.page for r in rows)
    assert len({r.id for r in rows}) == len(rows) and min(r.id for r in rows if r.type == "ref") == f"b-{len(parts) + 2:04d}"
    # every quoted anchor keeps its words
    anchors, quotes, k = [], {}, 0
    for at, (kind, _, band, text) in enumerate(parts, 1):
        if kind == "refs" and not band:
            for word in text.split(" "):
                start = text.index(word)
                anchors.append((1, k, f"b-{at + 1:04d}", "en", start, start + len(word)))
                quotes[k], k = word, k + 1
    anchors.append((1, 999, "b-0001", "en", 0, 3))
    df = spark.createDataFrame(anchors, ANCHOR)
    text = {r.id: r.en for r in rows}
    for r in done.anchors(df).collect():
        if r.id == 999:
            assert (r.block_id, r.start, r.end, r.moved) == ("b-0001", 0, 3, False)
        else:
            assert r.moved and text[r.block_id][r.start : r.end] == quotes[r.id]
    # nothing is left to do
    again = after.select("paper_id", F.col("place").alias("ord"), "id", "type", "page", "band", "en")
    second = RB.Rebuild(again)
    twice, none = second.after(), second.lists
    assert [tuple(r) for r in twice.orderBy("place").collect()] == [tuple(r) for r in rows] and none.collect() == []


def test_lists_without_entries_stay(spark):
    before = blocks(spark, [("refs", 1, None, "no numbers here"), ("refs", 1, "foot", "9"), ("refs", 2, None, "and none there"), ("p", 2, None, "x"), ("refs", 2, None, None), ("refs", 2, None, "[1] alone")])
    done = RB.Rebuild(before)
    after = done.after()
    assert [r.id for r in after.orderBy("place").collect()] == [r.id for r in before.orderBy("ord").collect()] and done.lists.collect() == []


def test_lead_and_anchors_without_range(spark):
    before = blocks(spark, [("refs", 1, None, "Before all. [1] Adams, A. One"), ("refs", 1, None, "title. [2] Brown, B."), ("refs", 1, None, "Another.")])
    done = RB.Rebuild(before)
    after = done.after()
    rows = {r.id: r.en for r in after.collect()}
    assert rows["b-0002"] == "Before all." and rows["b-0005"] == "[1] Adams, A. One title." and rows["b-0006"] == "[2] Brown, B. Another."
    anchors = spark.createDataFrame([(1, 1, "b-0002", "en", None, None), (1, 2, "b-0003", "en", None, None), (1, 3, "b-0004", "en", None, None), (1, 4, "b-0002", "en", 0, 40), (1, 5, "b-0003", "en", 5, 30), (2, 6, "b-0003", "en", 1, 2)], ANCHOR)
    got = {r.id: (r.block_id, r.start, r.end) for r in done.anchors(anchors).collect()}
    assert got == {1: ("b-0002", None, None), 2: ("b-0005", None, None), 3: ("b-0006", None, None), 4: ("b-0002", 0, 11), 5: ("b-0005", 23, 24), 6: ("b-0003", 1, 2)}


def test_translated_titles_shift_their_ranges(spark):
    before = blocks(spark, [("refs", 1, None, "[1] Adams, A. One title. J. 2001."), ("refs", 1, None, "[2] Brown, B. Two titles. J. 2002.")])
    done = RB.Rebuild(before)
    zh = "[1] Adams, A. 一个题目. J. 2001."
    titles = spark.createDataFrame([(1, "b-0004", zh, "One title", "一个题目")], "paper_id long, id string, zh string, title_en string, title_zh string")
    anchors = [(1, k, "b-0002", "zh", s, e) for k, (s, e) in enumerate([(4, 9), (14, 17), (20, 26), (25, 32)])] + [(1, 9, "b-0003", "zh", 4, 9)]
    got = {r.id: (r.start, r.end) for r in done.anchors(spark.createDataFrame(anchors, ANCHOR), titles).collect()}
    assert got == {0: (4, 9), 1: (14, 14), 2: (14, 21), 3: (20, 27), 9: (4, 9)}


def test_squeeze_maps_by_brute_force(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab \t\n") for _ in range(rng.randrange(0, 14))) for _ in range(120)]
    rows = [(k, t, p) for k, t in enumerate(texts) for p in range(len(t))]
    df = spark.createDataFrame(rows, "k long, t string, p int").withColumn("m", O.squeeze_map(F.col("t")))
    for r in df.select("t", "p", O.moved(F.col("m"), F.col("p")).alias("to"), O.squeezed(F.col("t")).alias("flat")).collect():
        flat = " ".join(r.t.split())
        assert r.flat == flat
        if not flat:
            assert r.to is None
            continue
        ahead = next((i for i in range(r.p, len(r.t)) if not r.t[i].isspace()), None)
        assert r.to == (len(flat) if ahead is None else len(" ".join((r.t[:ahead] + "#").split())) - 1)


def test_notes_by_fate(spark):
    stored = spark.createDataFrame([(1, "b-1", 1, "a  note", "旧", "mt", True), (1, "b-2", 1, "same", "", "mt", False), (1, "b-3", 1, "twice", "二", "mt", False), (1, "b-4", 1, "twi ce", "二", "mt", False), (1, "b-5", 1, "by hand", "手", "human", True), (1, "b-6", 1, "no zh", None, "none", False), (2, "b-1", 1, "a  note", "旧", "mt", False)], "paper_id long, id string, page long, en string, zh string, zh_source string, needs_review boolean")
    fresh = spark.createDataFrame([(1, "n1", 1, "a\nnote", "n"), (1, "n2", 1, "same", "n"), (1, "n3", 1, "tw\nice", "n"), (1, "n5", 1, "by\nhand", "n"), (1, "n6", 1, "no\nzh", "n"), (1, "n7", 1, "new one", "n")], "paper_id long, id string, page long, en string, note string")
    new = spark.createDataFrame([(1, "b-1", "新", False), (1, "b-5", "新", False)], "paper_id long, id string, text string, bad boolean")
    after = RB.notes_rebuilt(stored, fresh, new)
    got = {(r.paper_id, r.id): (r.fate, r.en, r.zh, r.needs_review, r.note) for r in after.collect()}
    assert got == {(1, "b-1"): ("restamped", "a\nnote", "新", False, "n"), (1, "b-2"): ("kept", "same", "", False, None), (1, "b-3"): ("ambiguous", "twice", "二", False, None), (1, "b-4"): ("ambiguous", "twi ce", "二", False, None), (1, "b-5"): ("restamped", "by\nhand", "手", True, "n"), (1, "b-6"): ("restamped", "no\nzh", None, True, "n"), (1, "n7"): ("missing", "new one", None, False, "n"), (2, "b-1"): ("kept", "a  note", "旧", False, None)}
    anchors = spark.createDataFrame([(1, 1, "b-1", "en", 3, 7), (1, 2, "b-1", "en", 1, 3), (1, 3, "b-1", "zh", 0, 1), (1, 4, "b-5", "zh", 0, 1), (1, 5, "b-2", "en", 0, 2), (1, 6, "b-1", "en", None, None)], ANCHOR)
    moved = {r.id: (r.fate, r.start, r.end) for r in RB.note_anchors(anchors, after).collect()}
    assert moved == {1: ("moved", 2, 6), 2: ("removed", None, None), 3: ("removed", None, None), 4: ("kept", 0, 1), 5: ("kept", 0, 2), 6: ("kept", None, None)}


def test_two_exchanges_by_paper(spark):
    """Before the streams are formed, and after Python has read them; fragments, entries, ids, furniture and numbering keep to that."""
    plan = RB.Rebuild(blocks(spark, [("refs", 1, None, "[1] Adams, A. One.")])).after()._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Exchange hashpartitioning(paper_id") == 2
    assert plan.split("Initial Plan")[-1].count("Exchange ") == 2
