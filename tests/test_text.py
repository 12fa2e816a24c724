"""Vectors of the text functions."""

import pytest
from pyspark.sql import functions as F

from foliant.functions import models as M
from foliant.functions import text as T
from foliant.operators import geometry as G
from foliant.operators import references as R
from foliant.operators import validate as VA
from foliant.sources import html as H


def one(spark, f, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(f(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first().x


@pytest.mark.parametrize(("text", "want"), [
    ("It is 28.4 now. See Fig. 2 here.", ["It is 28.4 now.", " See Fig.", " 2 here."]),
    ('"Is it?" she said. "Yes!" (So.)', ['"Is it?"', " she said.", ' "Yes!"', " (So.)"]),
    ("no stop", ["no stop"]),
    ("a...b. c", ["a...b.", " c"]),
    ("", []),
])
def test_sentences(spark, text, want):
    assert one(spark, T.sentences, text) == want


def test_chinese_sentences(spark):
    assert one(spark, lambda c: T.sentences(c, "zh"), "一句。二句！？三") == ["一句。", "二句！？", "三"]


def test_offsets_tile(spark):
    text = "One. Two! Three"
    got = one(spark, lambda c: T.sentence_offsets(T.sentences(c)), text)
    assert [text[o.start : o.end] for o in got] == ["One.", " Two!", " Three"]


@pytest.mark.parametrize(("f", "text", "want"), [
    (T.clean_text, "ﬁnd eﬃcient soft­ness non‑plain", "find efficient softness non-plain"),
    (T.desmallcaps, "I NTRODUCTION  to A B", "INTRODUCTION to A B"),
    (T.join_hyphen_breaks, "vari- ous three-\ndimen- sional X- ray 3- d", "various threedimensional Xray 3- d"),
    (T.tags_of, "#a, b；a、c ,#d;e;f", ["a", "b", "c", "d", "e"]),
    (T.year_of, "Proc. 1987 and 2001", 1987),
    (T.year_of, "1890", None),
    (T.year_of, "2024", 2024),
    (T.escape, 'a & b < "c" >', 'a &amp; b &lt; "c" &gt;'),
    (T.equation_numbers, r"\[ x \tag{ 12 } \] (3)", ["12"]),
    (T.equation_numbers, "so (3) and ( 14 ) but (150)", ["3", "14"]),
    (T.caption_like, " Fig. 2 shows", True),
    (T.caption_like, "Figures", True),
    (T.looks_math, "x = y + 2", True),
    (T.looks_math, "plain words of a text", False),
    (T.artifacts, "vari- ous [ 12 ] and x .", ["hyphen_break", "cite_blank", "blank_stop"]),
    (T.without_fences, '```json\n{"a": 1}\n```', '{"a": 1}'),
    (T.first_json_object, 'Here: {"a": {"b": 2}} end', '{"a": {"b": 2}}'),
    (T.first_json_object, "nothing", None),
    (T.prose_core, r"The \(x = \text{value}\) inf of <b>sets</b>", ["the", "sets"]),
    (H.unescape, "&lt;a&gt; &amp;amp;", "<a> &amp;"),
    (H.paper_ref, "https://arxiv.org/abs/2401.01234v2", "2401.01234"),
    (H.paper_ref, "cs/0112017", "cs/0112017"),
    (H.paper_ref, "nothing", None),
    (H.math_to_text, '<math alttext="x^2">..</math>', r"\(x^2\)"),
])
def test_functions(spark, f, text, want):
    assert one(spark, f, text) == want


def test_units(spark):
    got = one(spark, T.math_units, r"let \(x\) be \[y\]")
    assert [(u.kind, u.text) for u in got] == [("text", "let "), ("inline", r"\(x\)"), ("text", " be "), ("display", r"\[y\]")]


def test_seams(spark):
    assert one(spark, T.continues, "the method is used to", "find the rest") is True
    assert one(spark, T.continues, "the end.", "find the rest") is False
    assert one(spark, T.continues, "the method is", "Next one") is False


def test_latex_problems(spark):
    assert one(spark, VA.latex_problems, "the value x of things (3)", r"the value \(x\) of things \tag{3}") == []
    assert one(spark, VA.latex_problems, "a remarkable discovery of things", "short") == ["no_math", "words", "shrunk"]


# references


def test_chain_takes_the_longest_and_allows_a_gap():
    assert R.chain([(1, 0), (2, 5), (9, 7), (4, 9), (5, 12)]) == [0, 5, 9, 12]
    assert R.chain([(53, 0), (54, 10), (1, 20), (55, 30)]) == [0, 10, 30]
    assert R.chain([]) == []


def test_numbered_entries():
    assert R.split_entries("References [1] A. One, 2001. [2] B. Two,  2002. [3] C.") == ("References", ["[1] A. One, 2001.", "[2] B. Two, 2002.", "[3] C."])
    assert R.split_entries("12. Alpha doi 10. 3390/x 13. Beta") == ("", ["12. Alpha doi 10. 3390/x", "13. Beta"])
    assert R.split_entries("nothing here") is None


def test_author_year_entries():
    text = "Ahlawat, S., & Yoon, B. (2020). Improved things. de Oliveira, T. A. (2019). Other things. Özel, T. (2021). Last."
    assert R.split_entries(text)[1] == ["Ahlawat, S., & Yoon, B. (2020). Improved things.", "de Oliveira, T. A. (2019). Other things.", "Özel, T. (2021). Last."]


def test_fragments_are_conserved(spark):
    rows = [(1, k, t) for k, t in enumerate(["[1] Some entry cut in the mid-", "dle of it. [2] Ano", "ther one, 2001. [3] Third"])] + [(2, 0, "no entries"), (2, 1, "at all")]
    out = R.reference_entries(spark.createDataFrame(rows, "paper_id long, ord long, text string")).collect()
    one = [r.entry for r in sorted(out, key=lambda r: r.n) if r.paper_id == 1]
    assert one == ["[1] Some entry cut in the mid-dle of it.", "[2] Ano ther one, 2001.", "[3] Third"]
    assert sorted(r.entry for r in out if r.paper_id == 2) == ["at all", "no entries"]


# models


def test_guarded_edit():
    assert M.change_refused("a text", "") == "empty" and M.change_refused("a text", " a text ") == "unchanged"
    assert M.change_refused("a", "x" * 400) == "grown" and M.change_refused("the first words", "zzzz yyyy") == "rewritten"
    assert M.change_refused("the frist words", "the first words") == ""


def test_model_channel_retries_only_what_failed(spark):
    rows = spark.createDataFrame([(1, "abcdefg"), (2, "abc")], "id long, text string")
    out = {r.id: r for r in M.translated(rows, "text", M.stub).collect()}
    assert (out[1].state, out[1].tries, out[1].answer) == ("needs_review", 3, None)
    assert (out[2].state, out[2].tries, out[2].answer) == ("mt", 1, "译abc")


# layout


def test_gutter_and_clusters(spark):
    boxes = [(1, 1, i, x, 100.0 + 30 * (i // 2), x + 200, 120.0 + 30 * (i // 2)) for i, x in enumerate([60.0, 340.0] * 4)]
    df = spark.createDataFrame(boxes, "paper_id long, page long, id long, x0 double, y0 double, x1 double, y1 double")
    gutter = G.gutters(df).first().gutter
    assert 260 <= gutter <= 340
    order = G.reading_order(df, F.lit(gutter)).orderBy("place").collect()
    assert [r.id for r in order] == [0, 2, 4, 6, 1, 3, 5, 7]
    assert sorted((r.x0, r.n) for r in G.clusters(df).collect()) == [(60.0, 4), (340.0, 4)]
