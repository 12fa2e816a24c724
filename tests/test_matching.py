"""Vectors of matching, spans and queue states."""

import random

from pyspark.sql import functions as F

from foliant.functions import matching as M
from foliant.operators import edits as E
from foliant.operators import spans as SP


def _model(entry, title):
    """A title's span, a sign at a time."""

    def fold(text):
        out, at, i = [], [], 0
        while i < len(text):
            if text[i] == "-" and i and text[i - 1].isalnum():
                j = i + 1
                while j < len(text) and text[j].isspace():
                    j += 1
                if j < len(text) and text[j].isalnum():
                    i = j
                    continue
            if text[i].isspace():
                out.append(" "), at.append(i)
                while i < len(text) and text[i].isspace():
                    i += 1
                continue
            out.append(text[i].lower()), at.append(i)
            i += 1
        return "".join(out), at

    want = fold(title)[0].strip()
    have, at = fold(entry)
    k = have.find(want) if want else -1
    return (at[k], at[k + len(want) - 1] + 1) if k >= 0 else (None, None)


def test_title_spans(spark):
    rng = random.Random(6)
    rows = [("Smith. Slow-\n moving RIVERS of ice. 1999", "slowmoving  rivers of ice"), ("a-b", "ab"), ("- x -y", "x -y"), ("no such", "title"), ("x", ""), ("x", None), ("", "x")]
    for _ in range(400):
        entry = "".join(rng.choice(["ab", "C", "-", " ", "\n", "é", "9", ".", "- "]) for _ in range(rng.randint(0, 25)))
        a = rng.randint(0, len(entry))
        rows.append((entry, entry[a : a + rng.randint(0, 8)].upper()))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, entry string, title string")
    got = {r.i: (r.x.start, r.x.end) for r in df.select("i", M.title_span_column(F.col("entry"), F.col("title")).alias("x")).collect()}
    for i, (entry, title) in enumerate(rows):
        assert got[i] == _model(entry, title or ""), (entry, title)


def test_title_replaced(spark):
    entry = "Doe, J.  On slow rivers.\nIce Letters 7, 1999."
    cases = [("on slow rivers", "论慢河", "Doe, J. 论慢河. Ice Letters 7, 1999.", ""), ("on slow rivers", " ", "", "not Chinese"), ("on slow rivers", "slow", "", "not Chinese"), ("on slow rivers", "河 https://a.b", "", "an address"), ("fast rivers", "河", "", "no title"), (entry, "河", "", "all of the entry"), ("ice", "河" * 90, "", "too long"), ("fast", "doi: 10.1/x", "", "no title, not Chinese, an address")]
    df = spark.createDataFrame([(i, entry, *c) for i, c in enumerate(cases)], "i int, entry string, title string, zh string, text string, refused string")
    for r in df.select("*", M.title_replaced_column(F.col("entry"), F.col("title"), F.col("zh")).alias("x")).collect():
        assert (r.x.text, r.x.refused) == (r.text, r.refused), r


def test_queue_states(spark):
    rows = [(1, k, e) for k, e in enumerate(["enqueue", "claim", "restart", "claim", "done", "claim"])] + [(2, k, e) for k, e in enumerate(["enqueue", "lost", "lost", "lost", "claim"])] + [(3, 0, "claim")]
    log = spark.createDataFrame([(p, k, k, e) for p, k, e in rows], "paper_id long, ts long, seq long, event string")
    assert {r.paper_id: (r.state, r.attempts) for r in E.queue_states(log).collect()} == {1: ("done", 2), 2: ("failed", 3), 3: ("none", 0)}


def test_note_area(spark):
    line = lambda n, mark, text: [(1, 1, 1, n, 0, mark, 5.0), (1, 1, 1, n, 1, text, 8.5)]
    rows = [*line(0, "a", "Corresponding author"), *line(1, "b", "Department of things"), (1, 1, 2, 0, 0, "A body paragraph", 10.0), (1, 1, 2, 1, 0, "goes on", 10.0)]
    df = spark.createDataFrame(rows, "paper_id long, page long, block long, line long, span long, text string, size double")
    assert [(r.block, r.marks, r.em) for r in SP.note_areas(df, 10.0).collect()] == [(1, 2, 0.85)]


def test_nested_markers():
    from foliant.sources.markers import read

    html = '<style><p data-b="no">x</p></style><p data-b="b-1">one <b>two</b> <span data-b="b-2" data-nt="1">in &amp; side</span> three</p><br><p data-b="b-3" data-pt="1">end'
    assert read(html) == [(0, "b-1", "p", "one two three", False, False), (1, "b-2", "span", "in & side", True, False), (2, "b-3", "p", "end", False, True)]
    assert read("") == [] and read("</p>< text") == []


def test_metadata_fails_softly(spark):
    from foliant.functions import models as M

    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "paper_id long, text string")
    given = {"a": '```json\n{"title": "T", "year": 2019, "tags": "#x,y"}\n```', "b": "sorry", "c": 'see {"title": " ", "year": "about 1850"} end'}
    out = {r.paper_id: r for r in M.metadata(rows, lambda ts: [(given[t], 1) for t in ts]).collect()}
    assert (out[1].title, out[1].year, out[1].tags) == ("T", 2019, ["x", "y"])
    assert (out[2].title, out[2].year) == (None, None) and (out[3].title, out[3].year) == (None, None)


def test_each_model_call_is_made_once(spark, tmp_path):
    """A model that counts its calls and answers differently each time: no call is repeated, each row has one result."""
    from foliant.functions import models as MO

    def model(texts):
        with open(tmp_path / "calls", "a") as log:
            log.writelines(f"{t}\n" for t in texts)
        return [("" if t.startswith("bad") or random.random() < 0.3 else f"译{t}", 1) for t in texts]

    rows = spark.createDataFrame([(i, f"{'bad' if i % 5 == 0 else 'good'} {i}") for i in range(60)], "i long, text string")
    out = MO.translated(rows, "text", model).collect()
    calls = (tmp_path / "calls").read_text().split("\n")[:-1]
    assert len(out) == 60 == len({r.i for r in out})
    assert all(calls.count(r.text) == r.tries == r.tokens for r in out)
    assert all(r.state == "needs_review" and r.tries == 3 for r in out if r.i % 5 == 0)


def test_latex_acceptance(spark):
    from foliant.functions import models as MO

    cases = [("energy is m c 2 here (3)", r"energy is \(mc^2\) here \tag{3}", True), ("energy is m c 2 here", "energy is mc2 here", False), ("momentum conservation requires energy x = y", r"\(x=y\)", False)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, a string, b string, ok boolean")
    for r in df.select("*", MO.latex_accepted(F.col("a"), F.col("b")).alias("got")).collect():
        assert r.got == r.ok, r
