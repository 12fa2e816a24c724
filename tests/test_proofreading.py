"""Tables, multisets, formulas, exports and prompts against models of their own."""

import base64
import json
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from foliant.functions.multisets import fewer
from foliant.operators import export as EX
from foliant.operators import intervals as I
from foliant.operators import prompts as PR
from foliant.operators import tables as TB


def test_fewer_by_counting(spark):
    rng = random.Random(2)
    rows = [(k, [rng.choice("abcd") for _ in range(rng.randrange(9))], [rng.choice("abce") for _ in range(rng.randrange(9))]) for k in range(200)]
    df = spark.createDataFrame(rows, "k int, was array<string>, now array<string>")
    for r in df.select("*", fewer(F.col("was"), F.col("now")).alias("got")).collect():
        assert r.got == sorted(w for w, n in Counter(r.was).items() if n > r.now.count(w)), r


def test_many_words_take_linear_time(spark):
    """200,000 words each side; pairs of them would take hours."""
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(200_000)), lambda x: x.cast("string")).alias("was"))
    assert df.select(F.size(fewer(F.col("was"), F.slice("was", 2, 200_000))).alias("n")).first().n == 1


BLOCKS = [("b-0001", 0, 1, "p", "Sensor type Va-"), ("b-0002", 1, 1, "p", "lue Optical 12.5 mm"), ("b-0003", 2, 1, "p", "camera of the second kind with many more words"), ("b-0004", 3, 2, "p", "Other page"), ("b-0005", 4, 1, "figure", "fig")]
GRID = [["Sensor type", "Value"], ["Optical", "12.5 mm"]]


def verdicts(spark, proposals):
    blocks = spark.createDataFrame([(1, *b) for b in BLOCKS], "paper_id long, id string, ord long, page long, type string, en string")
    df = spark.createDataFrame([(1, k, *p) for k, p in enumerate(proposals)], "paper_id long, table_id long, ids array<string>, rows array<array<string>>, caption string")
    done = TB.settled(df, blocks)
    return {r.table_id: (r.verdict, list(r.detail)) for r in done.collect()}, TB.tabled(done, blocks)


def test_every_verdict(spark):
    two = ["b-0001", "b-0002"]
    cases = [
        (["b-0001", "b-0001"], GRID, None, "few blocks", []),
        ([*two, "b-9"], GRID, None, "no such block", []),
        (["b-0001", "b-0004"], GRID, None, "several pages", []),
        (["b-0001", "b-0005"], GRID, None, "no text block", []),
        (two, [["a", "b"], ["c"]], None, "ragged", []),
        (two, [], None, "ragged", []),
        (two, [["Sensor type", "Value"]], None, "too small", []),
        (two, [["Optical", "x"]] * 81, None, "too long", []),
        (two, [["", " "], ["", ""]], None, "empty", []),
        (two, [["Sensor type", "Value"], ["Acoustic", "12.5 mm"]], None, "not in the source", ["Acoustic"]),
        (["b-0001", "b-0002", "b-0003"], GRID, None, "text left out", ["camera", "second", "kind", "many", "words"]),
        (["b-0001", "b-0002", "b-0003"], GRID, "camera of the second kind with many more words", "", []),
        (two, GRID, None, "taken", []),
    ]
    got, after = verdicts(spark, [c[:3] for c in cases])
    assert got == {k: (c[3], c[4]) for k, c in enumerate(cases)}
    rows = [(r.id, r.type, r.en) for r in after.orderBy("ord", "id").collect()]
    assert rows == [("b-0006", "table", f"{cases[11][2]}\nSensor type | Value\nOptical | 12.5 mm"), ("b-0004", "p", "Other page"), ("b-0005", "figure", "fig")]


def test_a_refused_table_frees_its_blocks(spark):
    """The second loses to the first, so the third, which wants only what the second wanted, is made."""
    one, two, three = (["b-0001", "b-0002"], GRID, None), (["b-0002", "b-0003"], [["lue Optical 12.5 mm", "camera of the"], ["second kind with", "many more words"]], None), (["b-0003", "b-0003", "b-0001"], [["Sensor type Va-", "camera of the"], ["second kind with", "many more words"]], None)
    assert {k: v for k, (v, _) in verdicts(spark, [one, two, three])[0].items()} == {0: "", 1: "taken", 2: "taken"}
    assert {k: v for k, (v, _) in verdicts(spark, [two, one, three])[0].items()} == {0: "", 1: "taken", 2: "taken"}
    assert {k: v for k, (v, _) in verdicts(spark, [one, two])[0].items()} == {0: "", 1: "taken"}


def test_no_mark_ends_inside_a_formula(spark):
    rng, rows, marks = random.Random(5), [], []
    for k in range(40):
        rows.append((k, "".join(rng.choice(["word ", r"\(a+b\)", r"\[c\]", " and "]) for _ in range(6))))
        marks += [(k, j, s, s + rng.randrange(0, 12)) for j, s in enumerate(rng.randrange(0, 30) for _ in range(4))]
    texts = spark.createDataFrame(rows, "k int, t string")
    got = I.clip_atomic(spark.createDataFrame(marks, "k int, id int, start int, end int"), I.units_of(texts, ["k"], "t"), ["k"]).collect()
    text, want = dict(rows), Counter()
    for k, t in text.items():
        parts = [(m.start(), m.end(), True) for m in re.finditer(r"\\\(.+?\\\)|\\\[.+?\\\]", t)]
        units, at = [], 0
        for a, b, _ in [*parts, (len(t), len(t), None)]:
            units += [(at, a, False)] if a > at else []
            units += [(a, b, True)] if b > a else []
            at = b
        for n, (a, b, whole) in enumerate(units):
            hit = sorted((s, j, e) for kk, j, s, e in marks if kk == k and s < e and s < b and e > a)
            want.update([(k, hit[0][1], n, a, b)] if whole and hit else [] if whole else [(k, j, n, max(s, a), min(e, b)) for s, j, e in hit])
    assert Counter(tuple(r) for r in got) == want


def test_export_in_bounded_pieces(spark):
    data = bytes(range(256)) * 3
    html = 'é<img src="assets/a.png"><img src="assets/../b.png"><img src="assets/none.gif"><img src="assets/c.svg">' + "长" * 40
    docs = spark.createDataFrame([(1, html), (2, ""), (3, None), (4, 'x<img src="assets/a.png">')], "paper_id long, html string")
    assets = spark.createDataFrame([(1, "a.png", bytearray(data), len(data)), (1, "c.svg", bytearray(b""), 0), (2, "a.png", bytearray(b"no"), 2)], "paper_id long, name string, content binary, size long")
    parts = EX.pieces(docs, assets, 40).collect()
    assert all(len(r.piece.encode()) <= 40 for r in parts)
    whole = {k: "".join(r.piece for r in sorted((x for x in parts if x.paper_id == k), key=lambda r: (r.place, r.part))) for k in (1, 4)}
    assert whole[1] == html.replace("assets/a.png", f"data:image/png;base64,{base64.b64encode(data).decode()}").replace("assets/c.svg", "data:image/svg+xml;base64,")
    assert whole[4] == 'x<img src="assets/a.png">' and {r.paper_id for r in parts} == {1, 4}
    assert {r.paper_id: r.bytes for r in EX.inlined_bytes(docs, assets).collect()} == {1: len(data), 4: 0}


def test_prompts_have_terms_contexts_and_seams(spark):
    lines = [("p", "A neural network is shown here and it"), ("deco", "12"), ("p", "goes on in this second block."), ("h2", "Network"), ("p", "Another sentence stands here by itself."), ("p", "The last one of all of them.")]
    blocks = spark.createDataFrame([(1, k, f"b-{k}", t, e) for k, (t, e) in enumerate(lines)], "paper_id long, ord long, id string, type string, en string")
    glossary = spark.createDataFrame([(1, [("network", "网络"), ("neural network", "神经网络"), ("absent", "无")])], "paper_id long, terms array<struct<en:string,zh:string>>")
    rows = PR.prompts(blocks, glossary, 1, 1, 10).orderBy("chunk").collect()
    assert [r.ids for r in rows] == [["b-0", "b-2"], ["b-3"], ["b-4"], ["b-5"]]  # a seam is not cut
    assert rows[0].prompt == "Terms\nneural network = 神经网络\n\nSentences cut in two\nb-0 goes on in b-2: …A neural network is shown here and it | goes on in this second block.…\n\nTo be translated\nb-0: A neural network is shown here and it\nb-2: goes on in this second block.\n\nAfter, not to be translated\nb-3: Network"
    assert rows[1].prompt.startswith("Terms\nnetwork = 网络\n\nBefore, not to be translated\nb-2: ") and rows[3].prompt.endswith("To be translated\nb-5: The last one of all of them.")
    assert all(r.prompt.count("To be translated") == 1 for r in PR.prompts(blocks, glossary.limit(0)).collect())


def test_prompts_take_one_exchange_by_paper(spark):
    blocks = spark.createDataFrame([(1, 1, "b-1", "p", "x")], "paper_id long, ord long, id string, type string, en string")
    plan = PR.chunks(blocks)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Exchange hashpartitioning(paper_id") == 1


def test_grids_are_repaired_or_refused(spark):
    rows = [["a", "b"], ["c", "d"]]
    answers = {"whole": [["A", "B"], ["C", "D"]], "short": [["A"], ["C"]], "long": [["A", "B", "C"], ["C", "D", "E"]], "few": [["A", "B"]], "none": None}

    def model(prompts):
        kinds = [json.loads(p)["caption"] for p in prompts]
        return [("sorry" if answers[k] is None else json.dumps({"caption": f"{k}!", "rows": answers[k]}), 1) for k in kinds]

    df = spark.createDataFrame([(k, rows) for k in answers] + [("whole", [["a"], ["b", "c"]])], "caption string, rows array<array<string>>")
    got = [(r.caption, r.rows_zh, r.caption_zh, r.state, r.tries) for r in PR.grids_translated(df, model).collect()]
    assert sorted(got, key=str) == sorted([("whole", answers["whole"], "whole!", "mt", 1), ("short", [["A", ""], ["C", ""]], "short!", "mt", 1), *((k, None, None, "needs_review", 2) for k in ("long", "few", "none", "whole"))], key=str)
