"""Queries over typesetting, tables, formulas, exports, prompts, layouts, retries and model calls, with their SQL."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from foliant.functions import ledger as L
from foliant.functions import models as M
from foliant.functions import text as T
from foliant.operators import assets as AS
from foliant.operators import export as EX
from foliant.operators import geometry as G
from foliant.operators import intervals as I
from foliant.operators import prompts as PR
from foliant.operators import render as H
from foliant.operators import sequence as S
from foliant.operators import tables as TB
from foliant.operators import validate as VA
from foliant.plans.document_queries import BOXES, _split_boxes
from foliant.plans.text_queries import _MATH
from foliant.session import scratch, table
from foliant.sources import layout as LA
from foliant.sources import views as V
from foliant.streaming import retries as RT


# typesetting


def _typeset(s, d):
    """Blocks and what a model might have made of them: sound, without mathematics, halved, misspelt, renumbered, all of it a formula."""
    b, k = V.blocks(s, d), F.col("ord") % 6
    before = F.concat("en", F.lit(" (7)"))
    half = F.substring("en", F.lit(1), F.floor(F.length("en") / 2).cast("int"))
    inner = F.when(k == 0, F.concat(F.lit(r"\(x\) "), "en")).when(k == 1, F.col("en")).when(k == 2, F.concat(F.lit(r"\(x\) "), half)).when(k == 3, F.concat(F.lit(r"\(x\) "), F.regexp_replace("en", "[aeiou]", "o"))).when(k == 4, F.concat(F.lit(r"\(x\) "), "en")).otherwise(F.concat(F.lit(r"\("), "en", F.lit(r"\)")))
    after = F.concat(inner, F.when(k == 4, F.lit(" (8)")).otherwise(F.lit(" (7)")))
    return b.select("paper_id", "ord", before.alias("before"), after.alias("after"))


def latex_fidelity(s, d):
    before, after = F.col("before"), F.col("after")
    rows = _typeset(s, d).withColumn("w", VA.lost_words(before, after))
    return rows.select("paper_id", "ord", F.array_join(VA.latex_problems(before, after, words=F.col("w")), ",").alias("problems"), F.array_join("w.lost", ",").alias("lost"))


def chunk_numbers(s, d):
    """Equation numbers are compared for ten blocks together."""
    rows = _typeset(s, d).withColumn("chunk", F.floor(F.col("ord") / 10))
    return VA.numbers_moved(rows, ["paper_id", "chunk"]).select("paper_id", "chunk", F.size("before").cast("long").alias("n"))


def _typesetter(texts):
    """Sound for two texts of three; one of three has no mathematics."""
    return [(t if len(t) % 3 == 1 else f"\\(x\\) {t}", len(t) // 4 + 1) for t in texts]


def latexized(s, d):
    b = V.blocks(s, d).where("ord % 4 = 0").withColumn("type", F.lit("eq"))
    done = M.latexized(b.select("paper_id", "ord", "type", "en"), _typesetter)
    return done.select("paper_id", "ord", F.md5("en").alias("en"), "state", "tokens", F.col("tries").cast("long").alias("tries"))


# tables


def _proposals(s, d):
    """Lines 2 to 4 of each page as a table of halves, with a fault by page; every eighth page has two tables that want one line."""
    b = V.blocks(s, d).where("ord % 10 between 2 and 5")
    cut = F.floor(F.length("en") / 2).cast("int")
    halves = F.array(F.substring("en", F.lit(1), cut), F.substring(F.col("en"), cut + 1, F.length("en")))
    held = F.array_sort(F.collect_list(F.struct("ord", "id", halves.alias("h"))))
    pages = b.groupBy("paper_id", "page").agg(held.alias("l")).where("size(l) >= 3").withColumn("k", (F.col("paper_id") + F.col("page")) % 8)
    three = F.slice("l", 1, 3)
    ids = F.transform(three, lambda x: x["id"])
    rows = F.transform(three, lambda x: x["h"])
    ids = F.when(F.col("k") == 4, F.concat(F.slice(ids, 1, 2), F.array(F.lit("b-9999999")))).when(F.col("k") == 5, F.slice(ids, 1, 1)).otherwise(ids)
    first = F.transform(rows, lambda r, i: F.when(i == 0, F.when(F.col("k") == 1, F.slice(r, 1, 1)).when(F.col("k") == 2, F.array(r[0], F.lit("xyzzy"))).otherwise(r)).otherwise(r))
    shaped = F.when(F.col("k") == 3, F.transform(rows, lambda r: F.array(r[0], F.lit("")))).when(F.col("k") == 6, F.slice(rows, 1, 1)).otherwise(first)
    one = pages.select("paper_id", (F.col("page") * 2).cast("long").alias("table_id"), ids.alias("ids"), shaped.alias("rows"), F.lit(None).cast("string").alias("caption"))
    last = F.slice("l", 3, 2)
    two = pages.where("k = 7 and size(l) = 4").select("paper_id", (F.col("page") * 2 + 1).cast("long").alias("table_id"), F.transform(last, lambda x: x["id"]).alias("ids"), F.transform(last, lambda x: x["h"]).alias("rows"), F.lit(None).cast("string").alias("caption"))
    return one.unionByName(two)


def table_verdicts(s, d):
    return TB.settled(_proposals(s, d), V.blocks(s, d)).select("paper_id", "table_id", "verdict", F.array_join("detail", "|").alias("detail"))


def table_blocks(s, d):
    blocks = V.blocks(s, d)
    return TB.tabled(TB.settled(_proposals(s, d), blocks), blocks)


def _grid_model(prompts):
    """By the caption: a whole grid, rows a cell too short, one row too many, no JSON at all."""
    out = []
    for p in prompts:
        given = json.loads(p)
        kind, rows = int(given["caption"]), [[f"译{c}" for c in r] for r in given["rows"]]
        rows = rows if kind == 0 else [r[:-1] for r in rows] if kind == 1 else [*rows, rows[0]]
        out.append(("no grid" if kind == 3 else f"Here: {json.dumps({'caption': ' 标题 ', 'rows': rows})}", len(p)))
    return out


def tables_translated(s, d):
    tables = _proposals(s, d).where("table_id % 2 = 0").select("paper_id", "table_id", "rows", (F.col("table_id") / 2 % 4).cast("int").cast("string").alias("caption"))
    done = PR.grids_translated(tables, _grid_model)
    shown = F.array_join(F.transform("rows_zh", lambda r: F.array_join(r, "|")), "/")
    return done.select("paper_id", "table_id", shown.alias("rows_zh"), "caption_zh", "state", F.col("tries").cast("long").alias("tries"))


# formulas, exports, prompts


def marks_on_formulas(s, d):
    b = V.blocks(s, d)
    text = F.concat(F.substring("en", 1, 20), F.lit(r"\(a+b\)"), F.substring(F.col("en"), F.lit(21), F.length("en")), F.lit(r"\[z\]"))
    units = I.units_of(b.select("paper_id", "ord", text.alias("t")), ["paper_id", "ord"], "t")
    start = (F.col("ord") * 7 + F.col("j") * 11) % 40
    marks = b.select("paper_id", "ord", F.explode(F.array(F.lit(0), F.lit(1))).alias("j")).select("paper_id", "ord", (F.col("ord") * 2 + F.col("j")).alias("id"), start.alias("start"), (start + 6).alias("end"))
    return I.clip_atomic(marks, units, ["paper_id", "ord"])


def _exported(s, d):
    b = V.blocks(s, d)
    name = F.concat(F.when(F.col("ord") % 4 == 1, ".").otherwise(""), F.lit("f"), F.col("ord").cast("string"), F.when(F.col("ord") % 3 == 0, ".jpg").otherwise(".png"))
    figures = b.where("ord % 7 = 5").withColumn("name", name)
    html = F.when(F.col("ord") % 7 == 5, F.concat(F.lit('<img src="assets/'), name, F.lit('">'))).otherwise(F.concat(F.lit("<p>"), "en", F.lit("</p>")))
    docs = b.groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", html.alias("h")))), lambda x: x["h"]), "\n").alias("html"))
    content = F.col("en").cast("binary")
    return docs, figures.where("ord % 5 <> 0").select("paper_id", "name", content.alias("content"), F.length(content).cast("long").alias("size"))


def export_pieces(s, d):
    """Pieces of at most 96 bytes, put together again for comparison."""
    docs, assets = _exported(s, d)
    parts = EX.pieces(docs, assets, 96).withColumn("fits", F.octet_length("piece") <= 96)
    whole = parts.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("place", "part", "piece"))).alias("p"), F.bool_and("fits").alias("fits"))
    return whole.join(EX.inlined_bytes(docs, assets), "paper_id").select("paper_id", F.sha2(F.array_join(F.transform("p", lambda x: x["piece"]), ""), 256).alias("sha"), "fits", "bytes")


def _glossary(s, d):
    """The first word of a document, its first two, and its third, each as a term."""
    w = F.split("text", "[ \n]+")
    word = lambda k: F.coalesce(F.get(w, F.lit(k)), F.lit(""))
    terms = F.array(*[F.struct(en.alias("en"), F.lit(zh).alias("zh")) for en, zh in ((word(0), "T1"), (F.concat(word(0), F.lit(" "), word(1)), "T2"), (word(2), "T3"))])
    return table(s, d, "documents").select(F.col("doc_id").alias("paper_id"), terms.alias("terms"))


def _flowing(s, d):
    return V.blocks(s, d, dealt=True).withColumn("en", F.when(F.col("ord") % 3 == 0, F.regexp_replace("en", "[.!?:]+$", " and")).otherwise(F.lower("en")))


def chunk_prompts(s, d):
    done = PR.prompts(_flowing(s, d), _glossary(s, d), 2, 4, 600)
    return done.select("paper_id", F.col("chunk").cast("long").alias("chunk"), F.size("ids").cast("long").alias("n"), F.md5("prompt").alias("prompt"))


# layouts, retries, calls


def layout_pages(s, d):
    """Documents as layout files, read again from the second page on."""
    b = V.blocks(s, d)
    span = F.struct(F.col("en").alias("text"), F.lit(9.5).alias("size"), F.lit(0.0).alias("x0"), (F.col("ord") * 12.0).alias("y0"), F.lit(500.0).alias("x1"), (F.col("ord") * 12.0 + 10).alias("y1"))
    rule = F.struct(F.lit("l").alias("kind"), F.lit(0.0).alias("x0"), (F.col("ord") * 12.0).alias("y0"), F.lit(500.0).alias("x1"), (F.col("ord") * 12.0 + F.col("ord") % 3 * 1.5).alias("y1"))
    own = b.groupBy("paper_id", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", span.alias("s"), rule.alias("r")))), lambda x: x).alias("l"))
    pages = own.select(F.col("paper_id").cast("string").alias("document"), F.col("page").cast("int").alias("page"), F.transform("l", lambda x: x["s"]).alias("spans"), F.transform("l", lambda x: x["r"]).alias("drawings"))
    path = f"{scratch(s)}/foliant/layouts-{uuid.uuid4().hex}"
    LA.write_layouts(pages, path)
    wanted = "document string, page int, spans array<struct<text: string>>, drawings array<struct<x0: double, y0: double, x1: double, y1: double>>, error string"
    read = LA.read_layouts(s, path, wanted, splitBytes=str(4 << 20)).where("page >= 2 and error is null")
    own = read.select("document", "page", F.col("spans.text").alias("texts"), LA.thin_count(F.col("drawings")).alias("rules"))
    text = F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("page", "texts"))), lambda x: x["texts"])), "\n")
    whole = own.groupBy("document").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.size("texts")).alias("spans"), F.sha2(text, 256).alias("sha"), F.sum("rules").alias("rules"))
    return whole.select(F.col("document").cast("long").alias("paper_id"), "pages", "spans", "sha", F.col("rules").cast("long").alias("rules"))


def retry_deliveries(s, d):
    """The events of users as a queue's log, 3,600 times as fast."""
    kind = F.when(F.col("event_type") == "view", "enqueue").when(F.col("event_type") == "purchase", "done").otherwise("fail")
    ms = F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 3600)
    log = table(s, d, "events").select(F.col("user_id").alias("paper_id"), F.timestamp_millis(ms).alias("ts"), F.col("event_id").alias("seq"), kind.alias("event"))
    return RT.deliveries(log).select("paper_id", F.col("try").cast("long").alias("try"), F.unix_millis("due").alias("due_ms"), "outcome")


def model_ledger(s, d):
    """Half of the blocks are answered first, then all: a block's call is charged once."""
    b = V.blocks(s, d).select(F.concat_ws("/", F.col("paper_id").cast("string"), "id").alias("key"), "ord", "en")
    path = f"{scratch(s)}/foliant/ledger-{uuid.uuid4().hex}"
    L.answered(b.where("ord % 2 = 0"), "key", "en", M.stub, path).count()
    L.answered(b, "key", "en", M.stub, path).write.format("noop").mode("overwrite").save()
    return L.spent(s, path).select(F.col("try").cast("long").alias("try"), "calls", "tokens")


def page_sections(s, d):
    pages = V.blocks(s, d).withColumn("page", F.floor(F.col("ord") / 3) % 4)
    return H.page_sections(S.page_groups(pages)).select("paper_id", "first", "page", "n", "label")


def math_units(s, d):
    """The parts of each block once a formula was put behind its third word."""
    text = F.regexp_replace("en", "^((?:[^ ]+ ){3})", r"$1\\(a_1\\) ")
    units = I.units_of(V.blocks(s, d).select("paper_id", "ord", text.alias("t")), ["paper_id", "ord"], "t")
    return units.select("paper_id", "ord", F.col("unit").cast("long").alias("unit"), F.col("u_start").cast("long").alias("start"), F.col("u_end").cast("long").alias("end"), "atomic")


# assets, boxes, marks of publishers


def _assets(s, d):
    """Assets named by blocks, what was recorded of them, and the files that lie there: some changed, some gone, some never recorded."""
    b = V.blocks(s, d).where("ord % 6 = 2")
    name, n = F.concat(F.lit("f"), F.col("ord").cast("string"), F.lit(".png")), F.length("en")
    wanted = b.select("paper_id", name.alias("name"))
    folder = F.concat(F.lit("p"), (F.col("paper_id") % 50).cast("string"), F.lit("/"), F.col("paper_id").cast("string"))
    recorded = b.where(n % 7 != 3).select("paper_id", folder.alias("folder"), name.alias("name"), F.sha2("en", 256).alias("digest"))
    files = b.where(n % 11 != 4).select(folder.alias("folder"), name.alias("name"), F.when(n % 5 == 1, F.upper("en")).otherwise(F.col("en")).cast("binary").alias("content"))
    return wanted, recorded, files


def assets_verified(s, d):
    return AS.verified(*_assets(s, d)).select("paper_id", "name", "status")


def assets_reusable(s, d):
    return AS.reusable(AS.verified(*_assets(s, d)))


def assets_copied(s, d):
    return AS.copies(AS.verified(*_assets(s, d)))


def reextracted(s, d):
    """How many rows are left of each table once every ninth paper is extracted anew."""
    papers = table(s, d, "documents").select(F.col("doc_id").alias("paper_id"), F.sha2("text", 256).alias("fingerprint"))
    marks = V.marks(s, d).select(F.col("block_id").alias("paper_id"), "id", "lang")
    left = AS.reextracted(papers.where("paper_id % 9 = 4"), papers, marks.where("lang = 'en'"), marks.where("lang = 'zh'"))
    rows = [df.select("paper_id", F.lit(k).alias("kind")) for df, k in zip(left, ("cache", "notes", "marks"), strict=True)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("paper_id", "kind").agg(F.count(F.lit(1)).alias("n"))


def boxes_overlapping(s, d):
    a, b = _split_boxes(s, d)
    return G.overlapping(a, b, 12.0)


def watermarks(s, d):
    """Lines with a publisher's mark before some of them."""
    n = F.col("ord") % 8
    lead = F.when(n == 0, "Authorized licensed use limited to: ").when(n == 1, "DOWNLOADED ON May 1 from IEEE Xplore. ").when(n == 2, "2020  IEEE. Personal use is permitted ").when(n == 3, "x Restrictions apply ").when(n == 4, "restrictions apply").otherwise("")
    return V.blocks(s, d).select("paper_id", "ord", T.watermark(F.concat(lead, F.col("en"))).alias("mark"))


QUERIES = {f.__name__: f for f in (latex_fidelity, chunk_numbers, latexized, table_verdicts, table_blocks, tables_translated, marks_on_formulas, export_pieces, chunk_prompts, layout_pages, retry_deliveries, model_ledger, page_sections, math_units, assets_verified, assets_reusable, assets_copied, reextracted, boxes_overlapping, watermarks)}


def _words(x: str) -> str:
    for _ in range(3):
        x = f"regexp_replace({x}, '([A-Za-z])-[ \\t\\n\\r­]+([a-z])', '\\1\\2', 'g')"
    return f"list_transform(regexp_extract_all(regexp_replace(regexp_replace({x}, '{_MATH}', ' ', 'g'), '<(/?)([a-zA-Z][a-zA-Z0-9_-]*)([^>]*)>', ' ', 'g'), '[A-Za-z]{{4,}}'), lambda w: lower(w))"


_NUMBERS = lambda x: f"regexp_extract_all({x}, '\\(\\s*([0-9]{{1,2}})\\s*\\)', 1)"
_JUDGED = f"""words AS (SELECT *, {_words('before')} AS was, {_words('after')} AS now, regexp_replace(lower(regexp_replace(after, '([A-Za-z])-[ \\t\\n\\r­]+([a-z])', '\\1\\2', 'g')), '[^a-z]', '', 'g') AS run FROM typeset),
lost AS (SELECT *, list_sort(list_filter(list_distinct(was), lambda w: len(list_filter(was, lambda x: x = w)) > len(list_filter(now, lambda x: x = w)))) AS lost FROM words),
judged AS (SELECT *, len(list_filter(lost, lambda w: length(w) >= 7 AND NOT contains(run, substr(w, 1, 6)))) > 0 OR (len(was) > 0 AND len(lost) > len(was) * 0.35) AS rewritten FROM lost)"""
_TYPESET = r"""typeset AS (SELECT paper_id, ord, en || ' (7)' AS before,
  CASE ord % 6 WHEN 0 THEN '\(x\) ' || en WHEN 1 THEN en WHEN 2 THEN '\(x\) ' || substr(en, 1, length(en) // 2) WHEN 3 THEN '\(x\) ' || regexp_replace(en, '[aeiou]', 'o', 'g') WHEN 4 THEN '\(x\) ' || en ELSE '\(' || en || '\)' END
  || CASE WHEN ord % 6 = 4 THEN ' (8)' ELSE ' (7)' END AS after FROM blocks)"""
_MADE = r"""typeset AS (SELECT paper_id, ord, en AS before, CASE WHEN length(en) % 3 = 1 THEN en ELSE '\(x\) ' || en END AS after FROM blocks WHERE ord % 4 = 0)"""

_HALVES = "[substr(en, 1, length(en) // 2), substr(en, length(en) // 2 + 1)]"
_PROPOSALS = f"""pages AS (SELECT paper_id, page, (paper_id + page) % 8 AS k, list({{'ord': ord, 'id': id, 'h': {_HALVES}}} ORDER BY ord) AS l FROM blocks WHERE ord % 10 BETWEEN 2 AND 5 GROUP BY paper_id, page HAVING count(*) >= 3),
proposals AS (
  SELECT paper_id, page * 2 AS table_id, CASE k WHEN 4 THEN [l[1].id, l[2].id, 'b-9999999'] WHEN 5 THEN [l[1].id] ELSE [l[1].id, l[2].id, l[3].id] END AS ids,
    CASE k WHEN 1 THEN [l[1].h[1:1], l[2].h, l[3].h] WHEN 2 THEN [[l[1].h[1], 'xyzzy'], l[2].h, l[3].h] WHEN 3 THEN [[l[1].h[1], ''], [l[2].h[1], ''], [l[3].h[1], '']] WHEN 6 THEN [l[1].h] ELSE [l[1].h, l[2].h, l[3].h] END AS rows FROM pages
  UNION ALL SELECT paper_id, page * 2 + 1, [l[3].id, l[4].id], [l[3].h, l[4].h] FROM pages WHERE k = 7 AND len(l) = 4
)"""
_BARE = lambda x: f"regexp_replace({x}, '[\\s{TB.HYPHENS}]+', '', 'g')"
_COVER = f"list_sort(list_transform(list_filter(list_transform(cells, lambda c: {_BARE('c')}), lambda c: length(c) > 1), lambda c: {{'n': -length(c), 'p': c}}))"
_COMMON = ", ".join(repr(w) for w in TB.COMMON)
_VERDICTS = f"""own AS (SELECT p.paper_id, p.table_id, string_agg(b.en, chr(10) ORDER BY k) AS source, count(b.id) AS found, count(DISTINCT b.page) AS n_pages, bool_or(b.type IN ('figure', 'table')) AS other
  FROM (SELECT paper_id, table_id, unnest(ids) AS id, unnest(range(len(ids))) AS k FROM proposals) p LEFT JOIN blocks b ON b.paper_id = p.paper_id AND b.id = p.id GROUP BY ALL),
trimmed AS (SELECT p.paper_id, p.table_id, ids, list_transform(rows, lambda r: list_transform(r, lambda c: trim(c))) AS rows, source, found, n_pages, other FROM proposals p JOIN own o ON p.paper_id = o.paper_id AND p.table_id = o.table_id),
filled AS (SELECT *, list_filter(flatten(rows), lambda c: c <> '') AS cells FROM trimmed),
covered AS (SELECT *, list_filter(cells, lambda c: NOT contains({_BARE('source')}, {_BARE('c')})) AS missing,
  list_reduce(list_prepend(regexp_replace(regexp_replace(source, '\\s+', ' ', 'g'), '([A-Za-z])-\\s+([a-z])', '\\1\\2', 'g'), list_transform({_COVER}, lambda x: array_to_string(list_transform(regexp_extract_all(x.p, '.'), lambda c: '\\Q' || c || '\\E'), '[\\s{TB.HYPHENS}]*'))), lambda a, p: regexp_replace(a, p, ' ', 'g')) AS rest FROM filled),
judged AS (SELECT *, list_filter(regexp_extract_all(rest, '[A-Za-z][A-Za-z''s-]{{3,}}'), lambda w: lower(w) NOT IN ({_COMMON})) AS unplaced FROM covered),
sound AS (SELECT *, CASE WHEN len(ids) < 2 THEN 'few blocks' WHEN found < len(ids) THEN 'no such block' WHEN n_pages > 1 THEN 'several pages' WHEN other THEN 'no text block'
    WHEN len(list_filter(rows, lambda r: len(r) = len(rows[1]))) < len(rows) THEN 'ragged' WHEN len(rows) < 2 OR len(rows[1]) < 2 THEN 'too small' WHEN len(cells) = 0 THEN 'empty'
    WHEN len(missing) > 0 THEN 'not in the source' WHEN len(unplaced) >= 4 THEN 'text left out' ELSE '' END AS verdict FROM judged),
settled AS (SELECT s.paper_id, s.table_id, ids, rows, CASE WHEN verdict = '' AND table_id % 2 = 1 AND EXISTS (FROM sound e WHERE e.paper_id = s.paper_id AND e.table_id = s.table_id - 1 AND e.verdict = '') THEN 'taken' ELSE verdict END AS verdict, missing, unplaced FROM sound s)"""

_CUT_TEXT = r"""cut AS (SELECT paper_id, ord, length(en) AS n, least(20, length(en)) AS p FROM blocks),
units AS (SELECT paper_id, ord, u.unit AS unit, u.s, u.e, u.m FROM (SELECT paper_id, ord, unnest(list_filter([{'unit': 0, 's': 0, 'e': p, 'm': false}, {'unit': 0, 's': p, 'e': p + 7, 'm': true}, {'unit': 0, 's': p + 7, 'e': n + 7, 'm': false}, {'unit': 0, 's': n + 7, 'e': n + 12, 'm': true}], lambda x: x.e > x.s)) AS u FROM cut)),
numbered AS (SELECT paper_id, ord, row_number() OVER (PARTITION BY paper_id, ord ORDER BY s) - 1 AS unit, s, e, m FROM units),
marks2 AS (SELECT paper_id, ord, ord * 2 + j AS id, (ord * 7 + j * 11) % 40 AS a, (ord * 7 + j * 11) % 40 + 6 AS z FROM blocks, range(2) t(j)),
hit AS (SELECT m.paper_id, m.ord, id, unit, a, z, s, e, u.m, row_number() OVER (PARTITION BY m.paper_id, m.ord, unit ORDER BY a, id) AS k FROM marks2 m JOIN numbered u ON m.paper_id = u.paper_id AND m.ord = u.ord AND a < e AND z > s)"""

_NAME = "CASE WHEN ord % 4 = 1 THEN '.' ELSE '' END || 'f' || ord || CASE WHEN ord % 3 = 0 THEN '.jpg' ELSE '.png' END"
_EXPORTED = f"""parts AS (SELECT paper_id, ord, CASE WHEN ord % 7 <> 5 THEN '<p>' || en || '</p>' WHEN ord % 4 = 1 OR ord % 5 = 0 THEN '<img src="assets/' || {_NAME} || '">'
  ELSE '<img src="data:image/' || CASE WHEN ord % 3 = 0 THEN 'jpeg' ELSE 'png' END || ';base64,' || base64(encode(en)) || '">' END AS h, CASE WHEN ord % 7 = 5 AND ord % 4 <> 1 AND ord % 5 <> 0 THEN octet_length(encode(en)) ELSE 0 END AS size FROM blocks)"""

_FLOW = """flowing AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY ord) - 1 AS i FROM (SELECT paper_id, ord, id, type, CASE WHEN ord % 3 = 0 THEN regexp_replace(en, '[.!?:]+$', ' and') ELSE lower(en) END AS en FROM blocks WHERE type <> 'deco')),
seamed AS (SELECT *, coalesce(type = 'p' AND next_type = 'p' AND len(regexp_extract_all(en, '[^\\s]+')) >= 6 AND len(regexp_extract_all(next_en, '[^\\s]+')) >= 3 AND NOT regexp_matches(en, '[.!?:;)\\]"''”’。！？]\\s*$') AND regexp_matches(next_en, '^[a-z(]'), false) AS seam
  FROM (SELECT *, lead(type) OVER w AS next_type, lead(en) OVER w AS next_en, lead(id) OVER w AS next_id FROM flowing WINDOW w AS (PARTITION BY paper_id ORDER BY i))),
chunked(paper_id, i, chunk, n, chars, open) AS (
  SELECT paper_id, i, CAST(0 AS BIGINT), CAST(1 AS BIGINT), CAST(length(en) AS BIGINT), seam FROM seamed WHERE i = 0
  UNION ALL SELECT b.paper_id, b.i, c.chunk + cut, CASE WHEN cut = 1 THEN 1 ELSE c.n + 1 END, CASE WHEN cut = 1 THEN length(b.en) ELSE c.chars + length(b.en) END, b.seam
  FROM chunked c JOIN seamed b ON b.paper_id = c.paper_id AND b.i = c.i + 1, LATERAL (SELECT CASE WHEN NOT c.open AND (c.n >= 4 OR c.chars + length(b.en) > 600) THEN 1 ELSE 0 END AS cut)),
spans AS (SELECT paper_id, chunk, min(i) AS f, max(i) AS t, count(*) AS n FROM chunked GROUP BY ALL),
words AS (SELECT doc_id AS paper_id, regexp_split_to_array(text, '[ \\n]+') AS w FROM documents),
terms AS (SELECT paper_id, list_sort([{'n': -length(coalesce(w[1], '')), 'en': coalesce(w[1], ''), 'zh': 'T1'}, {'n': -length(coalesce(w[1], '') || ' ' || coalesce(w[2], '')), 'en': coalesce(w[1], '') || ' ' || coalesce(w[2], ''), 'zh': 'T2'}, {'n': -length(coalesce(w[3], '')), 'en': coalesce(w[3], ''), 'zh': 'T3'}]) AS g FROM words),
bodies AS (SELECT s.paper_id, chunk, f, t, n, g, lower(string_agg(en, chr(10) ORDER BY i)) AS r1, string_agg(id || ': ' || en, chr(10) ORDER BY i) AS body FROM spans s JOIN seamed b ON b.paper_id = s.paper_id AND i BETWEEN f AND t LEFT JOIN terms x ON x.paper_id = s.paper_id GROUP BY ALL),
u1 AS (SELECT *, g[1].en <> '' AND contains(r1, lower(g[1].en)) AS h1, CASE WHEN g[1].en <> '' THEN replace(r1, lower(g[1].en), chr(1)) ELSE r1 END AS r2 FROM bodies),
u2 AS (SELECT *, g[2].en <> '' AND contains(r2, lower(g[2].en)) AS h2, CASE WHEN g[2].en <> '' THEN replace(r2, lower(g[2].en), chr(1)) ELSE r2 END AS r3 FROM u1),
u3 AS (SELECT *, g[3].en <> '' AND contains(r3, lower(g[3].en)) AS h3 FROM u2),
sections AS (SELECT u.paper_id, chunk, n, body,
  nullif(concat_ws(chr(10), CASE WHEN h1 THEN g[1].en || ' = ' || g[1].zh END, CASE WHEN h2 THEN g[2].en || ' = ' || g[2].zh END, CASE WHEN h3 THEN g[3].en || ' = ' || g[3].zh END), '') AS used,
  (SELECT string_agg(id || ': ' || en, chr(10) ORDER BY i) FROM seamed b WHERE b.paper_id = u.paper_id AND i BETWEEN f - 2 AND f - 1) AS before,
  (SELECT string_agg(id || ': ' || en, chr(10) ORDER BY i) FROM seamed b WHERE b.paper_id = u.paper_id AND i BETWEEN t + 1 AND t + 2) AS behind,
  (SELECT string_agg(id || ' goes on in ' || next_id || ': …' || right(en, 40) || ' | ' || left(next_en, 40) || '…', chr(10) ORDER BY i) FROM seamed b WHERE b.paper_id = u.paper_id AND seam AND i BETWEEN f - 1 AND t) AS cuts FROM u3 u)"""

_LOG = """log AS (SELECT user_id AS paper_id, epoch_us(ts) // 3600000 AS ms, event_id AS seq, CASE event_type WHEN 'view' THEN 'enqueue' WHEN 'purchase' THEN 'done' ELSE 'fail' END AS event FROM events),
placed AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY ms, seq) AS i FROM log),
ends AS (SELECT paper_id, ms, event, i FROM placed UNION ALL SELECT paper_id, 4611686018427387904, '', max(i) + 1 FROM placed GROUP BY paper_id),
walk(paper_id, i, phase, tries, due, late, late_due, outcome, at_) AS (
  SELECT DISTINCT paper_id, CAST(0 AS BIGINT), 'none', 0, CAST(0 AS BIGINT), CAST(NULL AS INTEGER), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT) FROM log
  UNION ALL
  SELECT paper_id, i, CASE WHEN event = 'enqueue' AND p <> 'doing' THEN 'doing' WHEN event = 'done' AND p = 'doing' THEN 'done' WHEN event = 'fail' AND p = 'doing' THEN CASE WHEN n >= 3 THEN 'failed' ELSE 'waiting' END ELSE p END,
    CASE WHEN event = 'enqueue' AND p <> 'doing' THEN 1 ELSE n END, CASE WHEN event = 'fail' AND p = 'doing' AND n < 3 THEN ms + CAST(least(2 ** n, 30) AS BIGINT) * 1000 WHEN p = 'waiting' THEN due ELSE 0 END,
    CASE WHEN late THEN n END, CASE WHEN late THEN due END,
    CASE WHEN event = 'enqueue' AND p <> 'doing' THEN 'delivered' WHEN event = 'done' AND p = 'doing' THEN 'done' WHEN event = 'fail' AND p = 'doing' AND n >= 3 THEN 'failed' END, ms
  FROM (SELECT e.*, w.due, w.phase = 'waiting' AND w.due <= e.ms AS late, CASE WHEN w.phase = 'waiting' AND w.due <= e.ms THEN 'doing' ELSE w.phase END AS p, w.tries + CASE WHEN w.phase = 'waiting' AND w.due <= e.ms THEN 1 ELSE 0 END AS n
    FROM walk w JOIN ends e ON e.paper_id = w.paper_id AND e.i = w.i + 1)
)"""

_ASSETS = """named AS (SELECT paper_id, 'f' || ord || '.png' AS name, 'p' || (paper_id % 50) || '/' || paper_id AS folder, length(en) AS n, en FROM blocks WHERE ord % 6 = 2),
verified AS (SELECT paper_id, name, CASE WHEN n % 7 <> 3 THEN folder END AS folder, CASE WHEN n % 7 = 3 THEN 'unrecorded' WHEN n % 11 = 4 THEN 'missing' WHEN n % 5 = 1 AND upper(en) <> en THEN 'refused' ELSE 'verified' END AS status FROM named),
reusable AS (SELECT paper_id, count(*) FILTER (status <> 'verified') = 0 AS usable, count(*) AS n, coalesce(string_agg(name || ': ' || status, ', ' ORDER BY name || ': ' || status) FILTER (status <> 'verified'), '') AS why FROM verified GROUP BY paper_id)"""

ORACLES = {
    "latex_fidelity": V.with_(V.BLOCKS, _TYPESET, _JUDGED) + f"""SELECT paper_id, ord, concat_ws(',', CASE WHEN NOT regexp_matches(after, '\\\\\\(|\\\\\\[') THEN 'no_math' END, CASE WHEN {_NUMBERS('before')} <> {_NUMBERS('after')} THEN 'numbers' END,
      CASE WHEN rewritten THEN 'words' END, CASE WHEN length(after) < length(before) * 0.7 THEN 'shrunk' END) AS problems, array_to_string(lost, ',') AS lost FROM judged""",
    "chunk_numbers": V.with_(V.BLOCKS, _TYPESET) + f"""SELECT paper_id, chunk, CAST(len(b) AS BIGINT) AS n FROM (SELECT paper_id, ord // 10 AS chunk, {_NUMBERS("string_agg(before, ' ' ORDER BY ord)")} AS b, {_NUMBERS("string_agg(after, ' ' ORDER BY ord)")} AS a FROM typeset GROUP BY ALL) WHERE a <> b""",
    "latexized": V.with_(V.BLOCKS, _MADE, _JUDGED) + """, said AS (SELECT *, regexp_matches(after, '\\\\\\(') AND NOT rewritten AS good FROM judged)
      SELECT paper_id, ord, md5(CASE WHEN good THEN trim(after) ELSE before END) AS en, CASE WHEN good THEN 'latexized' ELSE 'needs_review' END AS state,
        CAST((length(before) // 4 + 1) * CASE WHEN good THEN 1 ELSE 2 END AS BIGINT) AS tokens, CAST(CASE WHEN good THEN 1 ELSE 2 END AS BIGINT) AS tries FROM said""",
    "table_verdicts": V.with_(V.BLOCKS, _PROPOSALS, _VERDICTS) + "SELECT paper_id, table_id, verdict, CASE verdict WHEN 'not in the source' THEN array_to_string(missing, '|') WHEN 'text left out' THEN array_to_string(unplaced, '|') ELSE '' END AS detail FROM settled",
    "table_blocks": V.with_(V.BLOCKS, _PROPOSALS, _VERDICTS) + """, won AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY table_id) AS k FROM settled WHERE verdict = ''),
      gone AS (SELECT paper_id, unnest(ids) AS id FROM won), top AS (SELECT paper_id, max(ord) + 1 AS top FROM blocks GROUP BY paper_id)
      SELECT paper_id, ord, id, page, type, en FROM blocks b ANTI JOIN gone g USING (paper_id, id)
      UNION ALL SELECT w.paper_id, b.ord, printf('b-%04d', top + k), b.page, 'table', array_to_string(list_transform(rows, lambda r: array_to_string(r, ' | ')), chr(10)) FROM won w JOIN blocks b ON b.paper_id = w.paper_id AND b.id = w.ids[1] JOIN top t ON t.paper_id = w.paper_id""",
    "tables_translated": V.with_(V.BLOCKS, _PROPOSALS) + """SELECT paper_id, table_id, CASE WHEN table_id // 2 % 4 = 0 AND even THEN array_to_string(list_transform(rows, lambda r: array_to_string(list_transform(r, lambda c: '译' || c), '|')), '/')
        WHEN table_id // 2 % 4 = 1 AND even THEN array_to_string(list_transform(rows, lambda r: array_to_string(list_transform(r[:-2], lambda c: '译' || c), '|') || '|'), '/') END AS rows_zh,
      CASE WHEN table_id // 2 % 4 < 2 AND even THEN '标题' END AS caption_zh, CASE WHEN table_id // 2 % 4 < 2 AND even THEN 'mt' ELSE 'needs_review' END AS state, CAST(CASE WHEN table_id // 2 % 4 < 2 AND even THEN 1 ELSE 2 END AS BIGINT) AS tries
      FROM (SELECT *, len(list_filter(rows, lambda r: len(r) = len(rows[1]))) = len(rows) AS even FROM proposals WHERE table_id % 2 = 0)""",
    "marks_on_formulas": V.with_(V.BLOCKS, _CUT_TEXT) + """SELECT paper_id, ord, id, unit, CASE WHEN m THEN s ELSE greatest(a, s) END AS start, CASE WHEN m THEN e ELSE least(z, e) END AS "end" FROM hit WHERE NOT m OR k = 1""",
    "export_pieces": V.with_(V.BLOCKS, _EXPORTED) + "SELECT paper_id, sha256(string_agg(h, chr(10) ORDER BY ord)) AS sha, true AS fits, CAST(sum(size) AS BIGINT) AS bytes FROM parts GROUP BY paper_id HAVING count(*) FILTER (ord % 7 = 5 AND ord % 4 <> 1) > 0",
    "chunk_prompts": V.with_(V.BLOCKS, _FLOW, recursive=True) + """SELECT paper_id, chunk, n, md5(concat_ws(chr(10) || chr(10), 'Terms' || chr(10) || used, 'Before, not to be translated' || chr(10) || before, 'Sentences cut in two' || chr(10) || cuts,
      'To be translated' || chr(10) || body, 'After, not to be translated' || chr(10) || behind)) AS prompt FROM sections""",
    "layout_pages": V.with_(V.BLOCKS) + """SELECT paper_id, count(DISTINCT page) AS pages, count(*) AS spans, sha256(string_agg(en, chr(10) ORDER BY ord)) AS sha, count(*) FILTER (ord % 3 < 2) AS rules FROM blocks WHERE page >= 2 GROUP BY paper_id""",
    "retry_deliveries": V.with_(_LOG, recursive=True) + """SELECT paper_id, CAST(late AS BIGINT) AS "try", late_due AS due_ms, 'delivered' AS outcome FROM walk WHERE late IS NOT NULL
      UNION ALL SELECT paper_id, CAST(tries AS BIGINT), at_, outcome FROM walk WHERE outcome IS NOT NULL""",
    "model_ledger": V.with_(V.BLOCKS) + """SELECT CAST(1 AS BIGINT) AS "try", count(*) AS calls, CAST(sum(length(en) // 4 + 1) AS BIGINT) AS tokens FROM blocks""",
    "page_sections": V.with_(V.BLOCKS) + """SELECT paper_id, first, page, n, CASE WHEN page > 0 THEN 'page ' || page || ' / ' || max(page) OVER (PARTITION BY paper_id) ELSE '' END AS label FROM (
      SELECT paper_id, any_value(page) AS page, min(ord) AS first, count(*) AS n FROM (SELECT *, sum(CASE WHEN page = before THEN 0 ELSE 1 END) OVER (PARTITION BY paper_id ORDER BY ord) AS island FROM (
        SELECT paper_id, ord, ord // 3 % 4 AS page, lag(ord // 3 % 4) OVER (PARTITION BY paper_id ORDER BY ord) AS before FROM blocks)) GROUP BY paper_id, island)""",
    "math_units": V.with_(V.BLOCKS, """led AS (SELECT paper_id, ord, length(en) AS n, length(regexp_extract(en, '^((?:[^ ]+ ){3})', 1)) AS p FROM blocks),
      parts AS (SELECT paper_id, ord, unnest(CASE WHEN p = 0 THEN [{'s': 0, 'e': n, 'm': false}] ELSE [{'s': 0, 'e': p, 'm': false}, {'s': p, 'e': p + 7, 'm': true}, {'s': p + 7, 'e': n + 8, 'm': false}] END) AS u FROM led WHERE n > 0)""")
      + """SELECT paper_id, ord, row_number() OVER (PARTITION BY paper_id, ord ORDER BY u.s) - 1 AS unit, u.s AS start, u.e AS "end", u.m AS atomic FROM parts""",
    "assets_verified": V.with_(V.BLOCKS, _ASSETS) + "SELECT paper_id, name, status FROM verified",
    "assets_reusable": V.with_(V.BLOCKS, _ASSETS) + "SELECT * FROM reusable",
    "assets_copied": V.with_(V.BLOCKS, _ASSETS) + "SELECT paper_id, name, folder FROM verified SEMI JOIN (SELECT paper_id FROM reusable WHERE usable) USING (paper_id)",
    "reextracted": V.with_(V.MARKS, "gone AS (SELECT doc_id AS paper_id, text FROM documents WHERE doc_id % 9 = 4)") + """SELECT doc_id AS paper_id, 'cache' AS kind, count(*) AS n FROM documents d WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.text = d.text) GROUP BY doc_id
      UNION ALL SELECT block_id, CASE lang WHEN 'en' THEN 'notes' ELSE 'marks' END, count(*) FROM marks WHERE block_id NOT IN (SELECT paper_id FROM gone) GROUP BY ALL""",
    "boxes_overlapping": f"WITH {BOXES}" + """ SELECT a.paper_id, a.page, a.id AS a, b.id AS b, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS area FROM boxes a JOIN boxes b ON a.paper_id = b.paper_id AND a.page = b.page AND a.id % 3 <> 0 AND b.id % 3 = 0
      WHERE a.x0 < b.x1 - 12 AND b.x0 < a.x1 - 12 AND a.y0 < b.y1 - 12 AND b.y0 < a.y1 - 12""",
    "watermarks": V.with_(V.BLOCKS) + "SELECT paper_id, ord, ord % 8 IN (0, 1, 2, 4) AS mark FROM blocks",
}
