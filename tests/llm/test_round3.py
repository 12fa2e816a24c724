"""Sharding, hard negatives and repair of conversations: brute force, edges, long conversations in segments."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from foliant.llm import html_text, negatives, pii, sharding, topk, toxicity, turns

# sharding


def jump(key, shards):
    """The shard of a key of 64 bits, by the definition."""
    shard, onward = -1, 0
    while onward < shards:
        shard = onward
        key = (key * 2862933555777941757 + 1) % 2**64
        onward = math.floor((shard + 1) * (2.0**31 / ((key >> 33) + 1)))
    return shard


def bits(key):
    return int(hashlib.md5(("" if key is None else str(key)).encode()).hexdigest()[:16], 16)


@pytest.mark.parametrize(("shards", "jumps"), [(1, 32), (2, 32), (40, 32), (40, 2), (1000, 32), (1000, 3)])
def test_jumps(spark, monkeypatch, shards, jumps):
    """Also where rows need more jumps than are tried at first."""
    monkeypatch.setattr(sharding, "JUMPS", jumps)
    keys = spark.range(800).select(F.col("id").alias("k"))
    for r in sharding.placed(keys, F.col("k"), shards).collect():
        assert (r.shard, r.grown_shard) == (jump(bits(r.k), shards), jump(bits(r.k), shards + 1))
        assert r.grown_shard in (r.shard, shards)


def test_shards_of_any_rows(spark):
    """Null, repeated and textual keys, null and long texts, names like the operator's own."""
    rows = [(None, "a"), (None, None), ("x", "é" * 40_000), ("x", "é" * 40_000), ("x", "b"), ("y", ""), *((str(k), f"text {k}") for k in range(400))]
    docs = spark.createDataFrame([(*r, 7, "s", 1) for r in rows], "doc_id string, text string, size int, shard string, _at int")
    out = sharding.shard(docs, 5).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((k, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for k, t in rows)
    slots = defaultdict(list)
    for r in out:
        assert r.law == "key" and r.shard == jump(bits(r.doc_id), 5)
        slots[r.shard].append((r.slot, r.doc_id is not None, r.doc_id or "", r.size, r.text_crc32))
    for own in slots.values():
        own.sort()
        assert [s for s, *_ in own] == list(range(len(own))) and [x for _, *x in own] == sorted(x for _, *x in own)
    assert sharding.shard(docs.limit(0), 5).collect() == []


def test_written_shards(spark, tmp_path):
    """Files hold the rows of their shard alone, hot keys in several."""
    rows = [("hot", f"row {k}") for k in range(300)] + [(str(k), "x") for k in range(200)] + [(None, None)]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id string, text string, shard int")
    path = str(tmp_path / "shards")
    sharding.write_shards(docs, 7, path, files=4)
    done = spark.read.parquet(path).select("*", F.input_file_name().alias("file")).collect()
    assert Counter((r.doc_id, r.text, r.shard) for r in done) == Counter((*r, 5) for r in rows)
    assert all(r._shard == jump(bits(r.doc_id), 7) for r in done)
    assert len({r.file for r in done if r.doc_id == "hot"}) == 4 and len({r.file for r in done}) <= 28


def test_shares_are_even_and_few_rows_move(spark):
    out = sharding.placed(spark.range(40_000), F.col("id"), 40).groupBy("shard").agg(F.count("*").alias("n"), F.count_if(F.col("grown_shard") != F.col("shard")).alias("moved")).collect()
    assert len(out) == 40 and all(800 < r.n < 1200 for r in out)
    assert 0.8 < sum(r.moved for r in out) / (40_000 / 41) < 1.2


# hard negatives


def mined(rows, anchors, n_positive, k, low, high):
    """By definition, for rows of (id, vector, label)."""
    good = [(i, r) for i, r in enumerate(rows) if r[2] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    whole = {i: [math.floor(256 * x) for x in r[1]] for i, r in good}
    out = Counter()
    for i, (a, _, label) in good:
        if a is None or a % anchors:
            continue
        scored = [(-sum(map(int.__mul__, whole[i], whole[j])), c is None, c or 0, j, own) for j, (c, _, own) in good]
        for p in sorted(x for x in scored if x[4] == label and x[3] != i)[:n_positive]:
            fits = sorted(x for x in scored if x[4] != label and low * -p[0] <= 100 * -x[0] <= high * -p[0])
            out.update((a, None if p[1] else p[2], rank, None if x[1] else x[2], -p[0], -x[0]) for rank, x in enumerate(fits[:k], 1))
    return out


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize(("block", "digit"), [(32 << 20, 10), (8 * 5 * 20, 2)])
def test_negatives_by_brute_force(spark, monkeypatch, block, digit):
    """Null and repeated ids, many ties and copies, in one block and in many, with long and short digits."""
    monkeypatch.setattr(negatives, "BLOCK_BYTES", block)
    monkeypatch.setattr(negatives, "DIGIT_BITS", digit)
    rng = random.Random(digit)
    rows = [(rng.choice([None, 0, 10, 20, *range(1, 60)]), [rng.choice((-0.25, 0.25, 0.3, 0.5)) for _ in range(rng.choice((4, 5)))], rng.choice((1, 2, 3, None))) for _ in range(140)]
    rows += [(70 + k, [0.25, 0.25, 0.25, 0.25, 0.0], 2) for k in range(40)]
    rows += [(200, None, 1), (210, [1.0, None], 1), (220, [float("nan")], 2), (230, [float("inf"), 1.0], 2), (240, [], 1)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, label int, row int, windows int")
    got = Counter(tuple(r) for r in negatives.mine(df, F.expr("id % 10 = 0"), 3, 4, 30, 90).select(COLUMNS).collect())
    assert got == mined(rows, 10, 3, 4, 30, 90)


def test_huge_components_and_empty_tables(spark):
    rows = [(0, [2.0**20, 1.0], 1), (1, [2.0**20, 3.0], 1), (2, [2.0**19, -1.0], 2), (3, [2.0**19, 5.0], 2), (4, [2.0**18, 0.0], 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = Counter(tuple(r) for r in negatives.mine(df, F.expr("id = 0"), 2, 5).select(COLUMNS).collect())
    assert got == Counter({k: v for k, v in mined(rows, 1, 2, 5, 30, 90).items() if k[0] == 0}) and got
    assert negatives.mine(df.limit(0), F.expr("id = 0")).collect() == negatives.mine(df, F.expr("id < 0")).collect() == []


# conversations

ROLES = ["system", "user", "assistant", "tool"]
TEXTS = ["Yes.", "No.", "cut off", " \t\n", "", "Why?", "and so"]


def by_hand(rows):
    """The report on turns (turn, role, text) in order, by trying every list of edits with up to one insertion."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    best = None
    for choice in itertools.product("DKua", repeat=len(rows)):
        if any(c != "D" and f in ("blank", "duplicate") for c, f in zip(choice, faults, strict=True)):
            continue
        lists = [list(zip(choice, rows, faults, strict=True))]
        lists += [[*lists[0][:at], (f"I{r}", None, ""), *lists[0][at:]] for at in range(len(rows) + 1) for r in "ua"]
        for edits in lists:
            audit, cost, kept = "", 0, []
            for c, row, fault in edits:
                audit += "D" if c == "D" else "K" if c == "K" else "I" if c[0] == "I" else "R"
                cost += 2 if c == "D" else (0 if c == "K" else 5 if c[0] == "I" else 1) + 5 * (fault == "truncated")
                if c != "D":
                    role = row[1] if c == "K" else {"u": "user", "a": "assistant"}[c[-1]]
                    kept.append((role, row[2] if row else ""))
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or " " for r, _ in kept)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, "\n".join(f"{r}:{t}" for r, t in kept))
    turns_ = [t for t, *_ in rows if t is not None]
    gaps = max(turns_) - min(turns_) + 1 - len(set(turns_)) if turns_ else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, best[0], best[1], hashlib.sha256(best[2].encode()).hexdigest())


REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))


@pytest.mark.parametrize("bits_", [13, 1])
def test_repairs_by_brute_force(spark, monkeypatch, bits_):
    """In one segment, and cut into segments of two turns; a null id, null and repeated turns, null roles and texts."""
    monkeypatch.setattr(turns, "SEGMENT_BITS", bits_)
    rng, rows = random.Random(bits_), []
    for conv in [None, *range(90)]:
        for _ in range(rng.randrange(1, 5)):
            rows.append((conv, rng.choice([None, 0, 1, 2, 3, 9]), rng.choice([*ROLES, None, "user", "assistant"]), rng.choice([*TEXTS, None, *TEXTS])))
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "conv_id long, turn long, role string, text string, pos int, code string")
    want = defaultdict(list)
    for conv, turn, role, text in rows:
        want[conv].append((turn, " " if role is None else role, " " if text is None else text))
    got = {r.conv_id: tuple(r[c] for c in REPORT) for r in turns.Repair(df).report().collect()}
    assert got == {conv: by_hand(ordered(own)) for conv, own in want.items()}


def test_long_conversations_in_segments(spark, monkeypatch):
    """Segments and the whole give one result, and the repaired turns are the digest's."""
    rng, rows = random.Random(3), []
    for conv in range(6):
        rows += [(conv, k, rng.choice(ROLES), f"{rng.choice(TEXTS)}{k // 3}{rng.choice(['.', '', '!'])}") for k in range(rng.choice((40, 300)))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = {r.conv_id: r for r in turns.Repair(df).report().collect()}
    monkeypatch.setattr(turns, "SEGMENT_BITS", 3)
    repair = turns.Repair(df)
    assert {r.conv_id: r for r in repair.report().collect()} == whole
    lines = defaultdict(list)
    for r in repair.repaired().orderBy("conv_id", "place").collect():
        lines[r.conv_id] += ([f"{r.added}:"] if r.added else []) + ([f"{r.role}:{r.text}"] if r.edit != "close" else [])
    assert {c: hashlib.sha256("\n".join(x).encode()).hexdigest() for c, x in lines.items()} == {c: r.repaired_sha256 for c, r in whole.items()}


def test_insertions_where_they_are_cheap(monkeypatch):
    """With dear deletions the DP inserts turns: against all lists of edits with up to two insertions."""
    monkeypatch.setattr(turns, "DELETE", 9)
    monkeypatch.setattr(turns, "INSERT", 2)
    monkeypatch.setattr(turns, "REROLE", 3)
    monkeypatch.setattr(turns, "CLOSING", (0, 4, 2, 0))
    for n in range(1, 4):
        for code in itertools.product("aeimb", repeat=n):
            code, best = "".join(code), None
            signs = turns.letters(code)
            for choice in itertools.product("DKua", repeat=n):
                for held in range(4):
                    for places in itertools.combinations_with_replacement(range(n + 1), held):
                        for new in itertools.product("ua", repeat=held):
                            audit, roles, cost = "", "", 0
                            for at in range(n + 1):
                                for p, r in zip(places, new, strict=True):
                                    if p == at:
                                        audit, roles, cost = audit + "I", roles + r, cost + 2
                                if at < n:
                                    c, (initial, fault) = choice[at], signs[at]
                                    audit += c if c in "DK" else "R"
                                    roles += "" if c == "D" else "suax"[initial] if c == "K" else c
                                    cost += 9 if c == "D" else 5 * fault + 3 * (c != "K")
                            if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
                                best = (cost, audit)
            audit, _, cost, _ = turns.closed(code, None, turns.START)
            assert (cost, audit) == best, code


def test_a_damaged_table_keeps_every_conversation(spark, tmp_path):
    """Conversations that lose all rows have zeros; an empty table gives none."""
    dropped = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows = [(dropped, 0, "user", "Yes."), (None, None, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in turns.query(spark, str(tmp_path)).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert [got[dropped][c] for c in REPORT] == [0, 0, 0, 0, 0, 0, "", empty]
    assert [got[None][c] for c in REPORT] == [0, 1, 0, 0, 0, 2, "D", empty]
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert turns.query(spark, f"{tmp_path}/none").collect() == []


# personal data: thresholds on the trees that are used


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_named_tokens_of_the_tables_are_found(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    named = re.compile(r'(?i)token = "([0-9a-f]{40})"')
    texts = {r.doc_id: r.text or "" for r in docs.where("lower(text) like '%token = %'").select("doc_id", "text").collect()}
    want = {(k, f"secret:{m.start(1)}:{m.end(1)}") for k, t in texts.items() for m in named.finditer(t)}
    rows = pii.detect(docs).where("n_added > 0").select("doc_id", pii.joined_spans(F.col("spans")).alias("spans")).collect()
    got = {(r.doc_id, s) for r in rows for s in r.spans.split(",") if s.split(":")[0] in pii.WIDE}
    assert len(want & got) >= 0.9 * len(want) > 0
    assert len(got - want) <= 0.05 * len(got)


def test_as_many_spans_pass_as_had_the_precision():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(200):
        n = rng.integers(1, 30)
        p, y, w, z = rng.integers(0, 5, n) / 4.0, rng.integers(0, 2, n).astype(float), rng.integers(1, 4, n).astype(float), rng.normal(size=n).round(1)
        selected = pii._selected(p, y, w)
        best = max((w[p >= c].sum() for c in p if (w * y)[p >= c].sum() >= pii.PRECISION * w[p >= c].sum()), default=0.0)
        assert selected == best
        if selected:
            cut = pii._reaching(z, w, selected)
            assert w[z >= cut].sum() >= selected > w[z > cut + 1e-6].sum()


# main texts: tree scoring on every page

STORY = "Word after word, and more of it, makes a paragraph that is long enough to count as a part of a real story, which goes on."
P = f"<p>{STORY}</p>"
LAYOUTS = {
    "teaser cards beside the text": (f"<body><div id=content>{P}{P}</div><article><p>Teaser one, short.</p></article><article><p>Teaser two, short.</p></article>", f"{STORY}\n{STORY}"),
    "a main of one line": (f"<body><main><p>Welcome.</p></main><div class=story>{P}{P}{P}</div>", f"{STORY}\n{STORY}\n{STORY}"),
    "a page in a form": (f"<body><form action=x><input name=a><label>Find it</label><div id=c><h1>Title</h1>{P}{P}</div><button>Go</button></form>", f"Title\n{STORY}\n{STORY}"),
    "a form named for search": (f"<body><form class=search><div>{P}{P}</div></form>", f"{STORY}\n{STORY}"),
    "a form beside the text": (f"<body><div>{P}{P}</div><form><p>{STORY}</p><input></form>", f"{STORY}\n{STORY}"),
    "nothing but a form": ("<body><form><p>Please log in here with your name and word.</p><input></form>", ""),
    "a standfirst": (f"<body><article><header><h1>T</h1><p>by me</p>{P}</header>{P}</article>", f"T\n{STORY}\n{STORY}"),
    "an introduction in main": (f"<body><main><h1>T</h1><div>{STORY}</div><article>{P}{P}</article><section><a href=a>More</a> <a href=b>Stories</a></section></main>", f"T\n{STORY}\n{STORY}\n{STORY}"),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_scores_decide(name):
    assert html_text.extract(LAYOUTS[name][0]) == LAYOUTS[name][1]


def test_scores_decided_every_page(spark, monkeypatch):
    """Each given page has a best container by score, and the text is that of the article it lies in."""
    found, best = [], html_text._best

    def watched(nodes, alive):
        found.append(best(nodes, alive))
        return found[-1]

    monkeypatch.setattr(html_text, "_best", watched)
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    for p in pages:
        text, root = html_text.extract(p.html), html_text.parse(p.html)
        article = next(n for n in html_text._order(root) if n.tag == "article")
        assert text == "\n".join(html_text._blocks([article], set(), True))
    assert len(found) == len(pages) and all(n is not None and n.score > 0 for n in found)


# bounds: blocks by bytes, lexicons by tests alone, parts that have not seen their texts


def test_long_vectors_make_small_blocks(spark, monkeypatch):
    """2,048 dimensions: no group of queries or candidates is beyond the bytes of a block, and the result is the same."""
    monkeypatch.setattr(topk, "BLOCK_BYTES", 8 * 2048 * 16)
    rng = random.Random(1)
    rows = [(k, [rng.uniform(-1, 1) for _ in range(2048)]) for k in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    done = topk.top_k(df, F.expr("id % 10 = 0"), 3)
    whole = {k: [math.floor(256 * x) for x in v] for k, v in rows}
    want = Counter()
    for q in range(0, 120, 10):
        scored = sorted((-sum(map(int.__mul__, whole[q], v)), k) for k, v in whole.items() if k != q)[:3]
        want.update((q, rank, k, -s) for rank, (s, k) in enumerate(scored, 1))
    assert Counter(tuple(r) for r in done.select("query_id", "rank", "vec_id", "score").collect()) == want
    plan = done._jdf.queryExecution().analyzed().toString()
    assert re.search(r"pmod\(xxhash64\([^)]*\), (?:cast\()?8\b", plan), plan  # 120 candidates by 16


def test_runs_of_letters_of_any_length():
    long = "kakorrhaphiophobia"
    codes = toxicity._Codes(frozenset({long, "abcd*"}))
    assert codes.spelled("xx" + long + "yy") and codes.spelled("stupidyou") and not codes.spelled("abcde") and not codes.spelled(long[:-1])
    assert toxicity.features(" ".join(long), codes)[toxicity.FEATURES.index("spelled_out")] > 0


def test_calibration_has_not_seen_its_texts(spark):
    """Words that tell label 1 by chance, each in the copies of one text: clean parts give them no weight, so no score is far from the rate of label 1."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("bcdfghklmnprst") + rng.choice("aeiou") for _ in range(4))
    rows = []
    for k in range(60):
        text = " ".join(word() for _ in range(12))
        rows += [(20 * k + c, text, k % 2) for c in range(8)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], 0, r[2]) for r in rows], "doc_id long, quality int, toxic int")
    words, trees, knots = toxicity.learn(docs, labels)
    scores = {r.doc_id: r.score for r in toxicity.classify(docs, (words, trees, knots)).collect()}
    assert all(0.05 <= s <= 0.95 for s in scores.values())
