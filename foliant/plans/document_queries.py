"""Queries over blocks, marks, fragments, boxes and logs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import geometry as G
from foliant.operators import intervals as I
from foliant.operators import render as H
from foliant.operators import sequence as S
from foliant.operators import stateful as ST
from foliant.operators import validate as VA
from foliant.session import table
from foliant.sources import views as V


def _en(s, d):
    return V.blocks(s, d).select("paper_id", F.col("ord").alias("n"), "id", "type", F.col("en").alias("text"))


def _zh(s, d):
    """The translated fragment: markers dropped, repeated, added and moved at fixed places."""
    base = _en(s, d)
    text = F.when(F.col("n") % 5 == 0, "").when(F.col("n") % 5 == 1, F.col("text")).otherwise(F.concat(F.lit("中"), F.regexp_replace("text", "[0-9]", "")))
    place = F.when(F.col("n") % 29 == 11, F.col("n") * 10 + 15).otherwise(F.col("n") * 10)
    own = base.where("n % 17 <> 3").select("paper_id", place.alias("n"), "id", text.alias("text"))
    again = base.where("n % 17 <> 3 and n % 19 = 5").select("paper_id", (F.col("n") * 10 + 2).alias("n"), "id", text.alias("text"))
    added = base.where("n % 23 = 7").select("paper_id", (F.col("n") * 10 + 3).alias("n"), F.concat(F.lit("x-"), "id").alias("id"), text.alias("text"))
    return own.unionByName(again).unionByName(added)


def _with_zh(s, d):
    b = V.blocks(s, d)
    zh = F.when(F.col("ord") % 5 == 0, "").otherwise(F.concat(F.lit("中"), "en"))
    source = F.when(F.col("ord") % 7 == 0, "human").when(F.col("ord") % 7 == 1, "needs_review").otherwise("mt")
    return b.withColumns({"zh": zh, "zh_source": source})


def _boxes(s, d):
    """Boxes from line items: an order is a page."""
    l = table(s, d, "lineitem")
    x0, y0 = (F.col("l_partkey") % 300).cast("double"), (F.col("l_suppkey") % 700).cast("double")
    return l.select((F.col("l_orderkey") % 100).alias("paper_id"), F.col("l_orderkey").alias("page"), F.col("l_linenumber").cast("long").alias("id"), x0.alias("x0"), y0.alias("y0"), (x0 + F.col("l_quantity").cast("double") * 9 + 20).alias("x1"), (y0 + F.col("l_linenumber") * 6 + 8).cast("double").alias("y1"))


BOXES = """boxes AS (SELECT l_orderkey % 100 AS paper_id, l_orderkey AS page, CAST(l_linenumber AS BIGINT) AS id, x0, y0, x0 + CAST(l_quantity AS DOUBLE) * 9 + 20 AS x1, CAST(y0 + l_linenumber * 6 + 8 AS DOUBLE) AS y1
  FROM (SELECT *, CAST(l_partkey % 300 AS DOUBLE) AS x0, CAST(l_suppkey % 700 AS DOUBLE) AS y0 FROM lineitem))"""


def _split_boxes(s, d):
    b = _boxes(s, d)
    return b.where("id % 3 <> 0"), b.where("id % 3 = 0")


def marks_clipped(s, d):
    units = V.blocks(s, d).select(F.col("paper_id").alias("block_id"), F.col("ord").alias("unit"), (F.col("ord") * 120).alias("u_start"), (F.col("ord") * 120 + 100).alias("u_end"))
    return I.clip(V.marks(s, d), units, ["block_id"])


def remap_span(s, d):
    docs = table(s, d, "documents")
    old, n = F.col("text"), F.col("doc_id")
    rest = lambda at: F.substring(old, F.lit(at), F.length(old))
    new = F.concat(F.substring(old, 1, 30), F.when(n % 2 == 0, F.lit(" inserted ")).otherwise(F.lit("")), F.when(n % 3 == 0, rest(51)).otherwise(rest(31)))
    to = I.remap(F.col("old"), F.col("new"), F.col("start"), F.col("end"))
    held = lambda at: F.least(at, F.length(old).cast("long"))
    rows = docs.select("doc_id", old.alias("old"), new.alias("new"), F.when(old.isNotNull(), held(n % 90)).alias("start"), F.when(old.isNotNull(), held(n % 90 + 12)).alias("end"))
    return rows.select("doc_id", to.alias("to")).select("doc_id", F.col("to.s").alias("start"), F.col("to.e").alias("end"))


def exact_range_lookup(s, d):
    m = V.marks(s, d)
    wanted = m.select("block_id", "lang", "start", (F.col("end") + F.when(F.col("id") % 2 == 0, 0).otherwise(1)).alias("end")).distinct()
    return I.exact_range(m, wanted, ["block_id", "lang"])


def anchor_ledger(s, d):
    edits = table(s, d, "documents").select(F.col("doc_id").alias("block_id"), F.col("text").alias("old"), F.concat(F.substring("text", 1, 20), F.substring(F.col("text"), F.lit(41), F.length("text"))).alias("new"))
    return I.ledger(V.marks(s, d), edits, ["block_id"])


def remap_ws(s, d):
    docs = table(s, d, "documents").select("doc_id", F.col("text").alias("old"), (F.col("doc_id") % 50).alias("start"), (F.col("doc_id") % 50 + 20).alias("end"))
    to = I.remap_blank(F.col("old"), F.regexp_replace("old", " ", "\n "), F.col("start"), F.col("end"))
    return docs.select("doc_id", to.alias("to")).select("doc_id", F.col("to.s").alias("start"), F.col("to.e").alias("end"))


def weighted_median_size(s, d):
    sizes = V.blocks(s, d).select("paper_id", (F.length("en") % 12).cast("double").alias("size"), F.length("en").cast("long").alias("w"))
    return S.weighted_median(sizes, "size", "w", 10.0)


def grid_text(s, d):
    rows = F.transform(F.split("text", "\n"), lambda line: F.split(line, " "))
    grid = table(s, d, "documents").select("doc_id", "source", rows.alias("g"))
    return grid.select("doc_id", VA.grid_text(F.col("g"), F.col("source")).alias("text"), VA.grid_shape(F.col("g")).isNotNull().alias("regular"))


def grid_pad(s, d):
    rows = F.transform(F.split("text", "\n"), lambda line: F.split(line, " "))
    fitted = VA.fit_grid(F.col("g"), F.size("g"), F.when(F.col("doc_id") % 4 == 0, 60).otherwise(F.array_max(F.transform("g", F.size))))
    return table(s, d, "documents").select("doc_id", rows.alias("g")).select("doc_id", F.coalesce(F.array_join(F.transform(fitted, lambda r: F.array_join(r, "|")), "/"), F.lit("none")).alias("grid"))


def upsert_latest(s, d):
    e = table(s, d, "events").select(F.col("event_id"), F.col("user_id").alias("key"), F.col("ts").alias("version"), "event_type")
    once = lambda df: ST.upsert(df.limit(0), df, "key", "stamp")
    stamped = e.withColumn("stamp", F.struct("version", "event_id"))
    old, new = once(stamped.where("event_id % 2 = 0")), once(stamped.where("event_id % 2 = 1"))
    return ST.upsert(old, new, "key", "stamp").select("key", "event_id", "event_type")


def sparse_merge(s, d):
    old = table(s, d, "customer").select(F.col("c_custkey").alias("key"), F.when(F.col("c_custkey") % 3 == 0, F.lit(" ")).otherwise(F.col("c_name")).alias("title"), F.when(F.col("c_custkey") % 4 == 0, F.lit(None)).otherwise(F.col("c_mktsegment")).alias("venue"))
    patch = table(s, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("key"), F.concat(F.lit("new "), "c_name").alias("title"), F.lit("venue").alias("venue"))
    return ST.sparse_merge(old, patch, "key", ["title", "venue"])


def cascade_delete(s, d):
    orders = table(s, d, "orders").select(F.col("o_orderkey").alias("key"), "o_custkey")
    items = table(s, d, "lineitem").select(F.col("l_orderkey").alias("key"), "l_linenumber")
    gone = orders.where("o_custkey % 10 = 3").select("key")
    parents, children = ST.cascade_delete(orders, items, gone, "key")
    return parents.join(children.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key", "left").select("key", F.coalesce("n", F.lit(0)).alias("n"))


def claim_first(s, d):
    e = table(s, d, "events").select(F.col("user_id").alias("paper_id"), "ts", F.col("event_id").alias("seq"))
    return ST.claims(e, "paper_id").where("claimed").select("paper_id", "seq")


def recover_stuck(s, d):
    return ST.recovered(V.papers(s, d)).groupBy("conv_state").agg(F.count(F.lit(1)).alias("n"))


def reading_order(s, d):
    return G.reading_order(_boxes(s, d), F.lit(306.0)).select("page", "id", F.col("place").cast("long").alias("place"))


QUERIES = {
    "section_forward_fill": lambda s, d: S.with_sections(V.blocks(s, d)).select("paper_id", "ord", "section"),
    "page_groups": lambda s, d: S.page_groups(V.blocks(s, d).withColumn("page", F.floor(F.col("ord") / 3) % 4)).select("paper_id", "island", "page", "first", "n"),
    "merge_runs": lambda s, d: S.merge_runs(V.blocks(s, d), F.length("en") < 40, F.col("en").contains("."), 2),
    "paragraph_index": lambda s, d: S.paragraph_index(V.blocks(s, d)).select("paper_id", "ord", "para"),
    "outline": lambda s, d: S.outline(V.blocks(s, d)).select("paper_id", "ord", "level", "number"),
    "seam_pairs": lambda s, d: S.seam_pairs(V.blocks(s, d).withColumn("en", F.when(F.col("ord") % 3 == 0, F.regexp_replace("en", "[.!?:]+$", " and")).otherwise(F.lower("en")))),
    "context_window": lambda s, d: S.context(V.blocks(s, d)),
    "head_prefix": lambda s, d: S.head_prefix(V.blocks(s, d)),
    "reference_tail": lambda s, d: S.reference_tail(V.blocks(s, d).withColumn("en", F.when((F.col("ord") % 9 == 6) & (F.col("paper_id") % 2 == 0), "References").when((F.col("ord") % 9 == 7) & (F.col("paper_id") % 3 == 0), F.concat(F.lit("[4] "), "en")).otherwise(F.col("en")))),
    "renumber_blocks": lambda s, d: S.renumber(V.blocks(s, d).where("ord % 4 <> 1")).select("paper_id", "ord", "id"),
    "weighted_median_size": weighted_median_size,
    "interval_union_extent": lambda s, d: S.interval_union(V.marks(s, d), "block_id", "start", "end"),
    "greedy_chunks": lambda s, d: S.greedy_chunks(V.blocks(s, d)),
    "caption_before": lambda s, d: S.caption_before(V.blocks(s, d)),
    "join_fragments": lambda s, d: S.joined_fragments(V.blocks(s, d)).select("paper_id", F.sha2("text", 256).alias("sha")),
    "highlight_overlay": lambda s, d: I.overlay(V.marks(s, d), ["block_id", "lang"]),
    "marks_clipped_to_units": marks_clipped,
    "exact_range_lookup": exact_range_lookup,
    "remap_span": remap_span,
    "remap_ws": remap_ws,
    "anchor_ledger": anchor_ledger,
    "marker_missing": lambda s, d: VA.missing(_en(s, d), _zh(s, d)),
    "marker_extra": lambda s, d: VA.missing(_zh(s, d), _en(s, d)),
    "marker_duplicated": lambda s, d: VA.duplicated(_zh(s, d)),
    "marker_first_misorder": lambda s, d: VA.first_misorder(_en(s, d), _zh(s, d)),
    "untranslated_blocks": lambda s, d: VA.untranslated(_en(s, d), _zh(s, d)),
    "digit_mismatch": lambda s, d: VA.digit_mismatch(_en(s, d), _zh(s, d)),
    "validation_summary": lambda s, d: VA.summary(_en(s, d), _zh(s, d)),
    "blocks_to_retry": lambda s, d: VA.to_retry(_en(s, d), _zh(s, d)),
    "grid_text": grid_text,
    "grid_pad": grid_pad,
    "render_blocks": lambda s, d: H.rendered(V.blocks(s, d)).select("paper_id", "ord", "html"),
    "render_document": lambda s, d: H.document(V.blocks(s, d)).select("paper_id", F.sha2("html", 256).alias("sha")),
    "dual_rows": lambda s, d: H.dual_rows(_with_zh(s, d)).select("paper_id", "ord", "row"),
    "reader_stats": lambda s, d: H.reader_stats(_with_zh(s, d)),
    "edge_band": lambda s, d: _boxes(s, d).select("page", "id", G.edge_band().alias("band"), G.marginal(F.lit(306.0)).alias("marginal")),
    "columns": lambda s, d: _boxes(s, d).select("page", "id", G.side(F.lit(306.0)).alias("side")),
    "reading_order": reading_order,
    "rule_nearest": lambda s, d: (lambda b, r: G.nearest_rule(b, r))(*_split_boxes(s, d)).select("page", "rule", "id", "gap"),
    "shade_cover": lambda s, d: (lambda b, r: G.shade_cover(b, r, 0.2))(*_split_boxes(s, d)).select("page", "id", "shade"),
    "hrule_stitch": lambda s, d: G.stitched_rules(_boxes(s, d).withColumn("y0", F.floor(F.col("y0") / 100) * 1.0), gap=40.0).select("page", "row", "x0", "x1", "n"),
    "gutter": lambda s, d: G.gutters(_boxes(s, d).withColumn("x1", F.least(F.col("x1"), F.col("x0") + 120))),
    "cluster_rects": lambda s, d: G.clusters(_boxes(s, d)),
    "caption_match": lambda s, d: (lambda b, r: G.caption_pairs(r, b))(*_split_boxes(s, d)),
    "progress_running_max": lambda s, d: ST.progress(V.progress_log(s, d)).select("paper_id", "seq", "progress"),
    "first_scroll_flip": lambda s, d: ST.first_scrolls(V.progress_log(s, d)),
    "claim_first": claim_first,
    "throttle": lambda s, d: ST.throttled(V.progress_log(s, d)),
    "upsert_latest": upsert_latest,
    "sparse_merge": sparse_merge,
    "cascade_delete": cascade_delete,
    "recover_stuck": recover_stuck,
}

_B = V.with_(V.BLOCKS)
_EN = "en AS (SELECT paper_id, ord AS n, id, type, en AS text FROM blocks)"
_ZTEXT = "CASE WHEN n % 5 = 0 THEN '' WHEN n % 5 = 1 THEN text ELSE '中' || regexp_replace(text, '[0-9]', '', 'g') END"
_ZH = f"""zh AS (SELECT paper_id, CASE WHEN n % 29 = 11 THEN n * 10 + 15 ELSE n * 10 END AS n, id, {_ZTEXT} AS text FROM en WHERE n % 17 <> 3
  UNION ALL SELECT paper_id, n * 10 + 2, id, {_ZTEXT} FROM en WHERE n % 17 <> 3 AND n % 19 = 5 UNION ALL SELECT paper_id, n * 10 + 3, 'x-' || id, {_ZTEXT} FROM en WHERE n % 23 = 7)"""
_MISSING = "missing AS (SELECT paper_id, n, id FROM en WHERE (paper_id, id) NOT IN (SELECT paper_id, id FROM zh))"
_EXTRA = "extra AS (SELECT paper_id, n, id FROM zh WHERE (paper_id, id) NOT IN (SELECT paper_id, id FROM en))"
_DUP = "dup AS (SELECT paper_id, n, id FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, id ORDER BY n) AS k FROM zh) WHERE k = 2)"
_MIS = """mis AS (SELECT paper_id, arg_min(other, k) AS id FROM
  (SELECT a.paper_id, a.k, a.id, b.id AS other FROM
    (SELECT paper_id, id, row_number() OVER (PARTITION BY paper_id ORDER BY n) AS k FROM en WHERE (paper_id, id) IN (SELECT paper_id, id FROM zh)) a
    JOIN (SELECT paper_id, id, row_number() OVER (PARTITION BY paper_id ORDER BY n) AS k FROM zh WHERE (paper_id, id) IN (SELECT paper_id, id FROM en) AND (paper_id, id) NOT IN (SELECT paper_id, id FROM dup)) b
    ON a.paper_id = b.paper_id AND a.k = b.k) WHERE id <> other GROUP BY paper_id)"""
_EXPECTED = "(type <> 'deco' AND len(list_filter(list_transform(regexp_extract_all(regexp_replace(regexp_replace(text, '([A-Za-z])-[ \\t\\n\\r­]+([a-z])', '\\1\\2', 'g'), '<(/?)([a-zA-Z][a-zA-Z0-9_-]*)([^>]*)>', ' ', 'g'), '[A-Za-z]{3,}'), lambda w: lower(w)), lambda w: w NOT IN (" + ", ".join(repr(w) for w in T.MATH_WORDS) + "))) >= 1)"
_PAIRS = "pairs AS (SELECT en.*, z.zh FROM en JOIN (SELECT paper_id, id, arg_max(text, n) AS zh FROM zh GROUP BY paper_id, id) z ON en.paper_id = z.paper_id AND en.id = z.id)"
_TRIMMED = "regexp_replace(regexp_replace(text, '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g'), '^ | $', '', 'g')"
_UNTRANSLATED = f"untranslated AS (SELECT paper_id, id FROM pairs WHERE {_EXPECTED} AND (NOT regexp_matches(zh, '\\S') OR (length({_TRIMMED}) > 40 AND NOT regexp_matches(zh, '[㐀-䶿一-鿿豈-﫿]'))))"
_DIGITS = f"digits AS (SELECT paper_id, id FROM pairs WHERE {_EXPECTED} AND regexp_matches(zh, '\\S') AND regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?') <> regexp_extract_all(zh, '[0-9]+(?:\\.[0-9]+)?'))"
_ALL = V.with_(V.BLOCKS, _EN, _ZH, _MISSING, _EXTRA, _DUP, _MIS, _PAIRS, _UNTRANSLATED, _DIGITS)
_WZ = "wz AS (SELECT *, CASE WHEN ord % 5 = 0 THEN '' ELSE '中' || en END AS zh, CASE ord % 7 WHEN 0 THEN 'human' WHEN 1 THEN 'needs_review' ELSE 'mt' END AS zh_source FROM blocks)"


def _esc(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


_HTML = f"""CASE WHEN type IN ('figure', 'deco') THEN '<figure data-b="' || id || '"' || CASE WHEN type = 'deco' THEN ' data-nt="1"' ELSE '' END || '><figcaption>' || {_esc('en')} || '</figcaption></figure>'
  WHEN type = 'h2' THEN '<h2 data-b="' || id || '">' || {_esc('en')} || '</h2>' ELSE '<p data-b="' || id || '">' || {_esc('en')} || '</p>' END"""

def _moved(rows: str, columns: str) -> str:
    """Ranges (start, end) of rows with old and new texts, moved a seam at a time: s and e, null where nothing is left."""
    same = lambda x, y: f"coalesce(list_position(list_transform(list_zip({x}, {y}, true), lambda z: z[1] = z[2]), false) - 1, least(len({x}), len({y})))"
    return f"""signs AS (SELECT *, string_split(old, '') AS a, string_split(new, '') AS b FROM ({rows})), head AS (SELECT *, {same("a", "b")} AS p FROM signs),
  tail AS (SELECT *, length(old) - {same("list_reverse(a[p + 1:])", "list_reverse(b[p + 1:])")} AS last, length(new) - length(old) AS delta FROM head),
  ends AS (SELECT {columns}, old, new, "start" AS s0, "end" AS e0, CASE WHEN old = new OR "start" < p THEN "start" WHEN "start" >= last THEN "start" + delta ELSE p END AS s1,
    CASE WHEN old = new OR "end" < p OR ("end" = p AND p = last) THEN "end" WHEN "end" >= last THEN "end" + delta ELSE p END AS e1 FROM tail),
  held AS (SELECT *, CASE WHEN old = new THEN s1 ELSE greatest(0, least(s1, length(new))) END AS s2, CASE WHEN old = new THEN e1 ELSE greatest(0, least(e1, length(new))) END AS e2 FROM ends),
  moved AS (SELECT *, CASE WHEN s0 < e0 AND s2 < e2 THEN s2 END AS s, CASE WHEN s0 < e0 AND s2 < e2 THEN e2 END AS e FROM held)"""


_EDITED = """SELECT doc_id, text AS old, substr(text, 1, 30) || CASE WHEN doc_id % 2 = 0 THEN ' inserted ' ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN substr(text, 51) ELSE substr(text, 31) END AS new,
  CASE WHEN text IS NOT NULL THEN least(doc_id % 90, length(text)) END AS "start", CASE WHEN text IS NOT NULL THEN least(doc_id % 90 + 12, length(text)) END AS "end" FROM documents"""
_CUT = """SELECT m.id, m.block_id, m.start AS "start", m."end" AS "end", text AS old, substr(text, 1, 20) || substr(text, 41) AS new FROM marks m LEFT JOIN documents d ON d.doc_id = m.block_id"""

ORACLES = {
    "remap_span": f"""WITH {_moved(_EDITED, 'doc_id')} SELECT doc_id, s AS start, e AS "end" FROM moved""",
    "anchor_ledger": V.with_(V.MARKS, _moved(_CUT, "id, block_id")) + """SELECT block_id, id, CASE WHEN old IS NULL THEN 'kept' WHEN s IS NULL THEN 'dropped' ELSE 'moved' END AS fate, CASE WHEN old IS NULL THEN s0 ELSE s END AS start, CASE WHEN old IS NULL THEN e0 ELSE e END AS "end",
      CASE WHEN old IS NOT NULL AND s IS NULL THEN substr(old, CAST(s0 + 1 AS INTEGER), CAST(e0 - s0 AS INTEGER)) END AS quote FROM moved""",
    "remap_ws": r"""WITH d AS (SELECT doc_id, text AS old, replace(text, ' ', chr(10) || ' ') AS new, doc_id % 50 AS s, doc_id % 50 + 20 AS e FROM documents),
      k AS (SELECT *, length(regexp_replace(substr(old, 1, s), '\s', '', 'g')) AS first, length(regexp_replace(substr(old, 1, e), '\s', '', 'g')) AS last, string_split(new, '') AS signs FROM d),
      p AS (SELECT *, list_filter(range(0, len(signs)), lambda i: regexp_matches(signs[i + 1], '\S')) AS kept FROM k)
      SELECT doc_id, CASE WHEN first < last THEN kept[first + 1] END AS start, CASE WHEN first < last THEN kept[last] + 1 END AS "end" FROM p""",
    "section_forward_fill": _B + "SELECT paper_id, ord, last_value(CASE WHEN type = 'h2' THEN en END IGNORE NULLS) OVER (PARTITION BY paper_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS section FROM blocks",
    "page_groups": _B + """SELECT paper_id, CAST(island AS BIGINT) AS island, any_value(page) AS page, min(ord) AS first, count(*) AS n FROM (SELECT *, sum(CASE WHEN page = before THEN 0 ELSE 1 END) OVER (PARTITION BY paper_id ORDER BY ord) AS island FROM
      (SELECT *, lag(page) OVER (PARTITION BY paper_id ORDER BY ord) AS before FROM (SELECT paper_id, ord, ord // 3 % 4 AS page FROM blocks))) GROUP BY paper_id, island""",
    "merge_runs": _B + """SELECT paper_id, min(ord) AS head, count(*) AS n, string_agg(en, ' ' ORDER BY ord) AS text FROM (SELECT *, ord - row_number() OVER (PARTITION BY paper_id, length(en) < 40 ORDER BY ord) AS run FROM blocks)
      WHERE length(en) < 40 GROUP BY paper_id, run HAVING count(*) >= 2 AND bool_or(contains(en, '.'))""",
    "paragraph_index": _B + "SELECT paper_id, ord, CASE WHEN type = 'p' THEN CAST(count(*) FILTER (WHERE type = 'p') OVER (PARTITION BY paper_id ORDER BY ord) AS BIGINT) END AS para FROM blocks",
    "outline": _B + "SELECT paper_id, ord, 2 AS level, coalesce(nullif(regexp_extract(en, '^((?:[IVX]{1,6}|[A-Z]|[0-9]+(?:\\.[0-9]+)*)\\.?) ', 1), ''), '·') AS number FROM blocks WHERE type = 'h2'",
    "seam_pairs": _B + """SELECT paper_id, ord AS first, next AS second FROM (SELECT *, lead(ord) OVER w AS next, lead(type) OVER w AS next_type, lead(en) OVER w AS next_en FROM
      (SELECT paper_id, ord, type, CASE WHEN ord % 3 = 0 THEN regexp_replace(en, '[.!?:]+$', ' and') ELSE lower(en) END AS en FROM blocks WHERE type <> 'deco') WINDOW w AS (PARTITION BY paper_id ORDER BY ord))
      WHERE type = 'p' AND next_type = 'p' AND len(regexp_extract_all(en, '[^\\s]+')) >= 6 AND len(regexp_extract_all(next_en, '[^\\s]+')) >= 3 AND NOT regexp_matches(en, '[.!?:;)\\]"''”’。！？]\\s*$') AND regexp_matches(next_en, '^[a-z(]')""",
    "context_window": _B + """SELECT paper_id, ord, coalesce(array_to_string(list(ord) OVER (PARTITION BY paper_id ORDER BY ord ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), ','), '') AS before,
      coalesce(array_to_string(list(ord) OVER (PARTITION BY paper_id ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), ','), '') AS after FROM blocks WHERE type <> 'deco'""",
    "head_prefix": _B + """SELECT paper_id, ord, chars FROM (SELECT *, max(CASE WHEN chars > 4000 OR n > 14 THEN 1 ELSE 0 END) OVER (PARTITION BY paper_id ORDER BY ord) AS over FROM
      (SELECT paper_id, ord, CAST(sum(length(en)) OVER (PARTITION BY paper_id ORDER BY ord) AS BIGINT) AS chars, row_number() OVER (PARTITION BY paper_id ORDER BY ord) AS n FROM blocks WHERE type NOT IN ('figure', 'deco') AND regexp_matches(en, '[^ \\t\\n\\r]'))) WHERE over = 0""".replace(" AS over", " AS past").replace("WHERE over", "WHERE past"),
    "reference_tail": _B + """SELECT paper_id, ord FROM (SELECT *, coalesce(max(CASE WHEN named AND place >= floor(total * 0.35) THEN ord END) OVER (PARTITION BY paper_id), max(CASE WHEN entry THEN ord END) OVER (PARTITION BY paper_id) - 1) AS start FROM
      (SELECT paper_id, ord, type, count(*) OVER (PARTITION BY paper_id) AS total, row_number() OVER (PARTITION BY paper_id ORDER BY ord) - 1 AS place, regexp_matches(upper(regexp_replace(e, '\\s+', '', 'g')), '^(REFERENCES|BIBLIOGRAPHY)') AND length(e) < 40 AS named, regexp_matches(e, '^\\s*\\[[0-9]{1,3}\\]') AS entry FROM
        (SELECT *, CASE WHEN ord % 9 = 6 AND paper_id % 2 = 0 THEN 'References' WHEN ord % 9 = 7 AND paper_id % 3 = 0 THEN '[4] ' || en ELSE en END AS e FROM blocks))) WHERE ord > start AND type = 'p'""",
    "renumber_blocks": _B + "SELECT paper_id, ord, printf('b-%04d', row_number() OVER (PARTITION BY paper_id ORDER BY ord)) AS id FROM blocks WHERE ord % 4 <> 1",
    "weighted_median_size": _B + """SELECT paper_id, coalesce(min(CASE WHEN cum * 2 >= total THEN size END), 10.0) AS median FROM (SELECT *, sum(w) OVER (PARTITION BY paper_id ORDER BY size) AS cum, sum(w) OVER (PARTITION BY paper_id) AS total FROM
      (SELECT paper_id, CAST(length(en) % 12 AS DOUBLE) AS size, sum(length(en)) AS w FROM blocks GROUP BY ALL)) GROUP BY paper_id""",
    "interval_union_extent": V.with_(V.MARKS) + """SELECT block_id, CAST(count(DISTINCT x) AS BIGINT) AS extent FROM (SELECT block_id, unnest(range(start, "end")) AS x FROM marks) GROUP BY block_id""",
    "greedy_chunks": V.with_(V.BLOCKS, """c AS (SELECT paper_id, ord, CAST(0 AS BIGINT) AS chunk, CAST(1 AS BIGINT) AS n, CAST(length(en) AS BIGINT) AS chars FROM blocks WHERE ord = 0
      UNION ALL SELECT b.paper_id, b.ord, c.chunk + cut, CASE WHEN cut = 1 THEN 1 ELSE c.n + 1 END, CASE WHEN cut = 1 THEN length(b.en) ELSE c.chars + length(b.en) END
      FROM c JOIN blocks b ON b.paper_id = c.paper_id AND b.ord = c.ord + 1, LATERAL (SELECT CASE WHEN c.n >= 12 OR c.chars + length(b.en) > 6000 THEN 1 ELSE 0 END AS cut))""", recursive=True) + "SELECT paper_id, chunk, ord FROM c",
    "caption_before": _B + """SELECT paper_id, ord, caption FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, caption ORDER BY ord) AS k FROM (SELECT * FROM
      (SELECT paper_id, ord, type, max(CASE WHEN type = 'p' THEN ord END) OVER (PARTITION BY paper_id ORDER BY ord ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS caption FROM blocks) WHERE type = 'figure' AND caption IS NOT NULL)) WHERE k = 1""",
    "join_fragments": V.with_(V.BLOCKS, """j AS (SELECT paper_id, ord, en AS text FROM blocks WHERE ord = 0 UNION ALL SELECT b.paper_id, b.ord, j.text || CASE WHEN j.text = '' OR (suffix(j.text, '-') AND regexp_matches(b.en, '^[A-Za-z]')) OR regexp_matches(j.text, '\\s$') OR regexp_matches(b.en, '^\\s') THEN '' ELSE ' ' END || b.en
      FROM j JOIN blocks b ON b.paper_id = j.paper_id AND b.ord = j.ord + 1)""", recursive=True) + "SELECT paper_id, sha256(arg_max(text, ord)) AS sha FROM j GROUP BY paper_id",
    "highlight_overlay": V.with_(V.MARKS, """seg AS (SELECT block_id, lang, s, lead(s) OVER (PARTITION BY block_id, lang ORDER BY s) AS e FROM (SELECT block_id, lang, start AS s FROM marks UNION SELECT block_id, lang, "end" FROM marks))""",
      """own AS (SELECT block_id, lang, s, e, id, color FROM (SELECT seg.*, m.id, m.color, row_number() OVER (PARTITION BY seg.block_id, seg.lang, s ORDER BY m.ts DESC, m.id DESC) AS k FROM seg JOIN marks m ON m.block_id = seg.block_id AND m.lang = seg.lang AND m.start <= s AND m."end" >= e WHERE e IS NOT NULL) WHERE k = 1)""")
      + """SELECT block_id, lang, min(s) AS start, max(e) AS "end", id, any_value(color) AS color FROM (SELECT *, sum(CASE WHEN id = pid AND s = pe THEN 0 ELSE 1 END) OVER (PARTITION BY block_id, lang ORDER BY s) AS run FROM
      (SELECT *, lag(id) OVER w AS pid, lag(e) OVER w AS pe FROM own WINDOW w AS (PARTITION BY block_id, lang ORDER BY s))) GROUP BY block_id, lang, run, id""",
    "marks_clipped_to_units": V.with_(V.MARKS, V.BLOCKS) + """SELECT m.block_id, m.id, b.ord AS unit, greatest(m.start, b.ord * 120) - b.ord * 120 AS start, least(m."end", b.ord * 120 + 100) - b.ord * 120 AS "end" FROM marks m JOIN blocks b ON b.paper_id = m.block_id
      WHERE m.start < b.ord * 120 + 100 AND m."end" > b.ord * 120""",
    "exact_range_lookup": V.with_(V.MARKS) + """SELECT w.*, m.mark FROM (SELECT DISTINCT block_id, lang, start, "end" + CASE WHEN id % 2 = 0 THEN 0 ELSE 1 END AS "end" FROM marks) w
      LEFT JOIN (SELECT block_id, lang, start, "end", min(id) AS mark FROM marks GROUP BY ALL) m ON m.block_id = w.block_id AND m.lang = w.lang AND m.start = w.start AND m."end" = w."end\"""",
    "marker_missing": _ALL + "SELECT * FROM missing",
    "marker_extra": _ALL + "SELECT * FROM extra",
    "marker_duplicated": _ALL + "SELECT * FROM dup",
    "marker_first_misorder": _ALL + "SELECT * FROM mis",
    "untranslated_blocks": _ALL + "SELECT * FROM untranslated",
    "digit_mismatch": _ALL + "SELECT * FROM digits",
    "validation_summary": _ALL + """, found AS (SELECT paper_id, 'missing' AS kind FROM missing UNION ALL SELECT paper_id, 'extra' FROM extra UNION ALL SELECT paper_id, 'duplicated' FROM dup UNION ALL SELECT paper_id, 'misordered' FROM mis UNION ALL SELECT paper_id, 'untranslated' FROM untranslated UNION ALL SELECT paper_id, 'digits' FROM digits)
      SELECT p.paper_id, count(*) FILTER (WHERE kind = 'missing') AS missing, count(*) FILTER (WHERE kind = 'extra') AS extra, count(*) FILTER (WHERE kind = 'duplicated') AS duplicated, count(*) FILTER (WHERE kind = 'misordered') AS misordered, count(*) FILTER (WHERE kind = 'untranslated') AS untranslated, count(*) FILTER (WHERE kind = 'digits') AS digits, count(*) FILTER (WHERE kind <> 'digits') = 0 AS ok
      FROM (SELECT DISTINCT paper_id FROM en) p LEFT JOIN found f ON f.paper_id = p.paper_id GROUP BY p.paper_id""",
    "blocks_to_retry": _ALL + "SELECT paper_id, id, min(rank) AS rank FROM (SELECT paper_id, id, 0 AS rank FROM missing UNION ALL SELECT paper_id, id, 1 FROM dup UNION ALL SELECT paper_id, id, 2 FROM mis UNION ALL SELECT paper_id, id, 3 FROM untranslated) GROUP BY paper_id, id",
    "grid_text": "SELECT doc_id, source || chr(10) || array_to_string(list_transform(g, lambda r: array_to_string(r, ' | ')), chr(10)) AS text, len(list_filter(g, lambda r: len(r) = len(g[1]))) = len(g) AS regular FROM (SELECT doc_id, source, list_transform(string_split(text, chr(10)), lambda l: string_split(l, ' ')) AS g FROM documents)",
    "grid_pad": """SELECT doc_id, CASE WHEN most <= w THEN array_to_string(list_transform(g, lambda r: array_to_string(r, '|') || repeat('|', w - len(r))), '/') ELSE 'none' END AS grid FROM
      (SELECT *, CASE WHEN doc_id % 4 = 0 THEN 60 ELSE most END AS w FROM (SELECT doc_id, g, list_max(list_transform(g, lambda r: len(r))) AS most FROM (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda l: string_split(l, ' ')) AS g FROM documents)))""",
    "render_blocks": _B + f"SELECT paper_id, ord, {_HTML} AS html FROM blocks",
    "render_document": _B + f"""SELECT paper_id, sha256('<!doctype html><html lang="en"><head><meta charset="utf-8"><title></title></head><body>' || chr(10) || string_agg({_HTML}, chr(10) ORDER BY ord) || chr(10) || '</body></html>') AS sha FROM blocks GROUP BY paper_id""",
    "dual_rows": V.with_(V.BLOCKS, _WZ) + f"""SELECT paper_id, ord, CASE WHEN type = 'deco' OR ord % 5 = 0 THEN '<div class="wide">' || {_esc('en')} || '</div>' ELSE '<div class="en">' || {_esc('en')} || '</div><div class="zh">' || {_esc('zh')} || '</div>' END AS row FROM wz""",
    "reader_stats": V.with_(V.BLOCKS, _WZ) + "SELECT paper_id, count(*) AS total, count(*) FILTER (WHERE zh <> '') AS translated, count(*) FILTER (WHERE zh_source = 'needs_review') AS review, count(*) FILTER (WHERE zh_source = 'human') AS human, count(*) FILTER (WHERE type = 'figure') AS figures FROM wz GROUP BY paper_id",
    "edge_band": V.with_(BOXES) + """SELECT page, id, CASE WHEN y0 <= 39.6 THEN 'top' WHEN y1 >= 752.4 THEN 'bottom' END AS band, (y0 <= 792 * 0.05 OR y1 >= 792 * 0.95) AND (x1 - x0 < 612 * 0.35 OR x1 - x0 > 612 * 0.7 OR (x0 < 306 AND x1 > 306)) AS marginal FROM boxes""",
    "columns": V.with_(BOXES) + "SELECT page, id, CASE WHEN (x0 + x1) / 2 < 306 THEN 0 ELSE 1 END AS side FROM boxes",
    "reading_order": V.with_(BOXES, """m AS (SELECT *, (y0 <= 792 * 0.05 OR y1 >= 792 * 0.95) AND (x1 - x0 < 612 * 0.35 OR x1 - x0 > 612 * 0.7 OR (x0 < 306 AND x1 > 306)) AS edge, x1 - x0 > 612 * 0.62 AS wide, CASE WHEN (x0 + x1) / 2 < 306 THEN 0 ELSE 1 END AS side, y0 <= 792 * 0.05 AS top FROM boxes)""",
      """r AS (SELECT *, sum(CASE WHEN wide = before THEN 0 ELSE 1 END) OVER (PARTITION BY page, edge ORDER BY y0, x0, id) AS run FROM (SELECT *, lag(wide) OVER (PARTITION BY page, edge ORDER BY y0, x0, id) AS before FROM m))""",
      """z AS (SELECT *, CASE WHEN NOT edge THEN 1 WHEN top THEN 0 ELSE 2 END AS zone, CASE WHEN edge THEN 0 ELSE run END AS r2, CASE WHEN NOT edge AND NOT wide AND min(side) OVER p <> max(side) OVER p THEN side ELSE 0 END AS col FROM r WINDOW p AS (PARTITION BY page, edge, run))""")
      + "SELECT page, id, row_number() OVER (PARTITION BY page ORDER BY zone, r2, col, y0, x0, id) AS place FROM z",
    "rule_nearest": V.with_(BOXES) + """SELECT page, rule, id, gap FROM (SELECT b.page, r.id AS rule, b.id, r.y0 - b.y1 AS gap, row_number() OVER (PARTITION BY b.page, r.id ORDER BY r.y0 - b.y1, b.id) AS k FROM boxes b JOIN boxes r ON r.page = b.page AND r.id % 3 = 0 AND b.id % 3 <> 0
      WHERE r.x0 <= b.x0 + 612 * 0.06 AND r.x1 >= b.x1 - 612 * 0.06 AND r.y0 - b.y1 BETWEEN 0 AND 26) WHERE k = 1""",
    "shade_cover": V.with_(BOXES) + """SELECT b.page, b.id, min(r.id) AS shade FROM boxes b JOIN boxes r ON r.page = b.page AND r.id % 3 = 0 AND b.id % 3 <> 0
      WHERE greatest(0, least(b.x1, r.x1) - greatest(b.x0, r.x0)) * greatest(0, least(b.y1, r.y1) - greatest(b.y0, r.y0)) / ((b.x1 - b.x0) * (b.y1 - b.y0)) >= 0.2 GROUP BY b.page, b.id""",
    "hrule_stitch": V.with_(BOXES) + """SELECT page, row, min(x0) AS x0, max(x1) AS x1, count(*) AS n FROM (SELECT *, sum(CASE WHEN x0 - reach <= 40 THEN 0 ELSE 1 END) OVER (PARTITION BY page, row ORDER BY x0, x1, id) AS run FROM
      (SELECT *, max(x1) OVER (PARTITION BY page, row ORDER BY x0, x1, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT *, CAST(floor(floor(y0 / 100) / 1.2) AS BIGINT) AS row FROM boxes))) GROUP BY page, row, run HAVING max(x1) - min(x0) >= 153""",
    "progress_running_max": V.with_(V.PROGRESS, "ep AS (SELECT *, sum(CASE WHEN kind <> 'scroll' THEN 1 ELSE 0 END) OVER (PARTITION BY paper_id ORDER BY ts, seq) AS epoch FROM progress_log)")
      + """SELECT paper_id, seq, CASE WHEN begun = 'mark_read' THEN 100 ELSE top END AS progress FROM (SELECT *, first_value(kind) OVER w AS begun, max(CASE kind WHEN 'mark_read' THEN 100 WHEN 'mark_unread' THEN 0 ELSE pct END) OVER w AS top FROM ep WINDOW w AS (PARTITION BY paper_id, epoch ORDER BY ts, seq ROWS UNBOUNDED PRECEDING))""",
    "first_scroll_flip": V.with_(V.PROGRESS, "ep AS (SELECT *, sum(CASE WHEN kind <> 'scroll' THEN 1 ELSE 0 END) OVER (PARTITION BY paper_id ORDER BY ts, seq) AS epoch FROM progress_log)")
      + """SELECT paper_id, seq, ts AS status_at FROM (SELECT *, first_value(kind) OVER (PARTITION BY paper_id, epoch ORDER BY ts, seq) AS begun, row_number() OVER (PARTITION BY paper_id, epoch, kind = 'scroll' ORDER BY ts, seq) AS k FROM ep) WHERE kind = 'scroll' AND k = 1 AND (begun = 'mark_unread' OR epoch = 0)""",
    "claim_first": "SELECT user_id AS paper_id, arg_min(event_id, struct_pack(ts := ts, e := event_id)) AS seq FROM events GROUP BY user_id",
    "throttle": V.with_(V.PROGRESS, "o AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY ts, seq) AS k FROM progress_log WHERE kind = 'scroll')",
      """t AS (SELECT paper_id, k, seq, pct AS last, true AS sent FROM o WHERE k = 1 UNION ALL SELECT o.paper_id, o.k, o.seq, CASE WHEN s THEN o.pct ELSE t.last END, s FROM t JOIN o ON o.paper_id = t.paper_id AND o.k = t.k + 1, LATERAL (SELECT o.pct >= t.last + 2 OR (o.pct = 100 AND t.last < 100) AS s))""", recursive=True) + "SELECT paper_id, seq FROM t WHERE sent",
    "upsert_latest": "SELECT user_id AS key, arg_max(event_id, struct_pack(ts := ts, e := event_id)) AS event_id, arg_max(event_type, struct_pack(ts := ts, e := event_id)) AS event_type FROM events GROUP BY user_id",
    "sparse_merge": "SELECT c_custkey AS key, coalesce(CASE WHEN c_custkey % 3 <> 0 THEN trim(c_name) END, CASE WHEN c_custkey % 2 = 0 THEN 'new ' || c_name END) AS title, coalesce(CASE WHEN c_custkey % 4 <> 0 THEN trim(c_mktsegment) END, CASE WHEN c_custkey % 2 = 0 THEN 'venue' END) AS venue FROM customer",
    "cascade_delete": "SELECT o_orderkey AS key, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey % 10 <> 3 GROUP BY o_orderkey",
    "recover_stuck": V.with_(V.PAPERS) + "SELECT CASE WHEN conv_state = 'doing' THEN 'queued' ELSE conv_state END AS conv_state, count(*) AS n FROM papers GROUP BY 1",
}
