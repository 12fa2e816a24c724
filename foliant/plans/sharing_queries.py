"""Queries over shared reading and public shapes, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import render as H
from foliant.operators import sequence as S
from foliant.operators import sharing as SH
from foliant.plans.document_queries import _HTML, _esc
from foliant.sources import views as V

#: Plans of the stand-in: papers and shares are dealt to as many.
PLANS = 151


def _papers(s, d):
    return V.papers(s, d).withColumn("plan_id", F.col("paper_id") % PLANS)


def _requests(s, d):
    """For each share a paper of its plan and one that is rarely its own, for every fifth the plan itself, and unknown tokens."""
    t = V.shares(s, d).select("token", "plan_id")
    own = t.select("token", (F.col("plan_id") + PLANS * (F.col("token") % 3)).alias("paper_id"))
    other = t.select("token", (F.col("token") % 997).alias("paper_id"))
    whole = t.where("token % 5 = 0").select("token", F.lit(None).cast("long").alias("paper_id"))
    unknown = t.where("token % 50 = 0").select((F.col("token") + 10**9).alias("token"), F.col("plan_id").alias("paper_id"))
    return own.unionByName(other).unionByName(whole).unionByName(unknown).distinct()


def _verdicts(s, d):
    return SH.judged(_requests(s, d), V.shares(s, d), _papers(s, d), V.SHARES_AS_OF)


def share_requests(s, d):
    return _verdicts(s, d)


def share_marks(s, d):
    marks = V.marks(s, d).select(F.col("block_id").alias("paper_id"), "id", "start", "end", "color")
    return SH.rows_shown(_verdicts(s, d), marks)


def share_plans(s, d):
    plans = _papers(s, d).select("plan_id").distinct().unionByName(V.shares(s, d).select("plan_id").distinct()).distinct()
    return SH.plans_shown(_verdicts(s, d), plans, _papers(s, d))


def _public(s, d):
    """Blocks with a translation, a source for figures, and a table every seventh line."""
    n = F.col("ord")
    grid = F.array(F.array(F.substring("en", 1, 3), F.lit("b")), F.array(F.lit("c"), F.lit("d")))
    zh_grid = F.when(n % 14 == 0, F.array(F.array(F.lit("甲"), F.lit("b")), F.array(F.lit("c"), F.lit("d")))).otherwise(grid)
    kind = F.when(n % 7 == 0, "table").otherwise(F.col("type"))
    src = F.when(n % 13 == 12, F.when(n % 2 == 0, F.concat(F.lit("assets/f"), n.cast("string"), F.lit(".png"))).otherwise("https://x.org/y.png"))
    return V.blocks(s, d).select("paper_id", "ord", "id", kind.alias("type"), "en", F.when(n % 3 == 0, F.concat(F.lit("中"), "en")).alias("zh"), F.when(n % 3 == 0, "mt").otherwise("none").alias("zh_source"), src.alias("src"), grid.alias("rows"), zh_grid.alias("rows_zh"), (n % 11 == 0).alias("needs_review"))


def public_blocks(s, d):
    done = SH.block_public(_public(s, d), "/papers/assets/")
    return done.select("paper_id", "ord", "id", "zh_source", "src", "needs_review", "no_zh", F.md5("en_html").alias("en_html"), F.md5("zh_html").alias("zh_html"), "table_zh")


def share_documents(s, d):
    """How much each request may read, and where its figures lie."""
    shown = SH.documents_shown(_verdicts(s, d).where("token % 7 = 0"), _public(s, d))
    return shown.groupBy("token", "paper_id").agg(F.count(F.lit(1)).alias("blocks"), F.count_if("needs_review").alias("review"), F.min("src").alias("src"))


def owner_notes(s, d):
    """Notes of the papers of every twenty-fifth plan."""
    notes = V.marks(s, d).select(F.col("id").alias("note_id"), F.col("block_id").alias("paper_id"))
    plans = _papers(s, d).select("plan_id").distinct()
    return SH.notes_of_owner(notes, _papers(s, d), plans, F.col("plan_id") % 25 == 7).select("note_id", "paper_id")


def notes_placed(s, d):
    """Notes on blocks by the paper and the block's id: many on blocks that are not there, every eleventh on none."""
    i = F.col("id")
    notes = V.marks(s, d).select(i.alias("note_id"), F.col("block_id").alias("paper_id"), F.when(i % 11 != 0, T.block_id(i % 12 + 1)).alias("block_id"))
    return SH.notes_in_order(notes, V.blocks(s, d)).select("note_id", "paper_id", "place")


def document_modes(s, d):
    n = F.col("ord")
    b = V.blocks(s, d).withColumn("zh", F.when(n % 3 == 0, F.concat(F.lit("中"), "en")))
    return H.document_modes(b).select("paper_id", "mode", F.md5("html").alias("html"))


def wrapped_titles(s, d):
    """Two lines of each five are a title."""
    return S.wrapped_titles(V.blocks(s, d).withColumn("type", F.when(F.col("ord") % 5 < 2, "h1").otherwise(F.col("type")))).where("type = 'h1'").select("paper_id", "ord", "id", F.md5("en").alias("en"), "parts")


QUERIES = {f.__name__: f for f in (share_requests, share_marks, share_plans, public_blocks, share_documents, owner_notes, notes_placed, document_modes, wrapped_titles)}

_PLAN_PAPERS = f"plan_papers AS (SELECT * REPLACE (paper_id % {PLANS} AS plan_id) FROM papers)"
_JUDGED = f"""requests AS (
  SELECT token, plan_id + {PLANS} * (token % 3) AS paper_id FROM shares UNION SELECT token, token % 997 FROM shares UNION SELECT token, NULL FROM shares WHERE token % 5 = 0 UNION SELECT token + 1000000000, plan_id FROM shares WHERE token % 50 = 0
), verdicts AS (
  SELECT r.token, r.paper_id, s.plan_id, CASE WHEN s.token IS NULL THEN 'missing' WHEN revoked THEN 'revoked' WHEN expires_at < TIMESTAMP '{V.SHARES_AS_OF}' THEN 'expired' WHEN r.paper_id IS NULL THEN 'ok'
    WHEN p.plan_id IS DISTINCT FROM s.plan_id THEN 'not shared' WHEN conv_state <> 'done' THEN 'not converted' ELSE 'ok' END AS verdict
  FROM requests r LEFT JOIN shares s ON s.token = r.token LEFT JOIN plan_papers p ON p.paper_id = r.paper_id
)"""
_SHARES = V.with_(V.PAPERS, V.SHARES, V.BLOCKS, V.MARKS, _PLAN_PAPERS, _JUDGED)
_PUBLIC = """public AS (SELECT paper_id, ord, id, CASE WHEN ord % 7 = 0 THEN 'table' ELSE type END AS type, en, CASE WHEN ord % 3 = 0 THEN '中' || en END AS zh, CASE WHEN ord % 3 = 0 THEN 'mt' ELSE 'none' END AS zh_source,
  CASE WHEN ord % 13 = 12 THEN CASE WHEN ord % 2 = 0 THEN 'assets/f' || ord || '.png' ELSE 'https://x.org/y.png' END END AS src, ord % 11 = 0 AS needs_review FROM blocks)"""

ORACLES = {
    "share_requests": _SHARES + "SELECT * FROM verdicts",
    "share_marks": _SHARES + """SELECT token, paper_id, id, start, "end", color FROM (SELECT DISTINCT token, paper_id FROM verdicts WHERE verdict IN ('ok', 'not converted') AND paper_id IS NOT NULL) v JOIN marks m ON m.block_id = v.paper_id""",
    "share_plans": _SHARES + """SELECT token, v.plan_id, count(p.paper_id) AS paper_count, count(*) FILTER (status IN ('read', 'reviewed')) AS done_count FROM (SELECT DISTINCT token, plan_id FROM verdicts WHERE verdict = 'ok') v LEFT JOIN plan_papers p ON p.plan_id = v.plan_id GROUP BY token, v.plan_id""",
    "public_blocks": V.with_(V.BLOCKS, _PUBLIC) + f"""SELECT a.paper_id, ord, id, zh_source, CASE WHEN src LIKE 'assets/%' THEN '/papers/assets/' || substr(src, 8) ELSE src END AS src, needs_review, type IN ('deco', 'refs', 'eq') AS no_zh, md5({_HTML}) AS en_html, md5(other) AS zh_html,
      CASE WHEN type = 'table' THEN ord % 14 = 0 AND coalesce(regexp_matches(zh, '\\S'), false) END AS table_zh
      FROM public a JOIN (SELECT paper_id, ord AS o, {_HTML} AS other FROM (SELECT * REPLACE (coalesce(nullif(zh, ''), en) AS en) FROM public)) b ON a.paper_id = b.paper_id AND a.ord = b.o""",
    "share_documents": V.with_(V.PAPERS, V.SHARES, V.BLOCKS, V.MARKS, _PLAN_PAPERS, _JUDGED, _PUBLIC) + """SELECT token, v.paper_id, count(*) AS blocks, count(*) FILTER (needs_review) AS review, min(CASE WHEN src LIKE 'assets/%' THEN '/share/' || token || '/papers/' || v.paper_id || '/assets/' || substr(src, 8) ELSE src END) AS src
      FROM (SELECT DISTINCT token, paper_id FROM verdicts WHERE verdict = 'ok' AND paper_id IS NOT NULL AND token % 7 = 0) v JOIN public p ON p.paper_id = v.paper_id GROUP BY token, v.paper_id""",
    "owner_notes": V.with_(V.PAPERS, V.MARKS, _PLAN_PAPERS) + "SELECT id AS note_id, block_id AS paper_id FROM marks m JOIN plan_papers p ON p.paper_id = m.block_id WHERE p.plan_id % 25 = 7",
    "notes_placed": V.with_(V.BLOCKS, V.MARKS) + "SELECT m.id AS note_id, m.block_id AS paper_id, ord AS place FROM marks m LEFT JOIN blocks b ON b.paper_id = m.block_id AND b.id = CASE WHEN m.id % 11 <> 0 THEN printf('b-%04d', m.id % 12 + 1) END",
    "document_modes": V.with_(V.BLOCKS, "t AS (SELECT *, CASE WHEN ord % 3 = 0 THEN '中' || en END AS zh FROM blocks)") + f"""SELECT paper_id, 'en' AS mode, md5(string_agg({_HTML}, chr(10) ORDER BY ord)) AS html FROM t GROUP BY paper_id
      UNION ALL SELECT paper_id, 'zh', md5(string_agg({_HTML}, chr(10) ORDER BY ord)) FROM (SELECT * REPLACE (coalesce(nullif(zh, ''), en) AS en) FROM t) GROUP BY paper_id
      UNION ALL SELECT paper_id, 'dual', md5(string_agg(CASE WHEN type = 'deco' OR NOT coalesce(regexp_matches(zh, '\\S'), false) THEN '<div class="wide">' || {_esc('en')} || '</div>' ELSE '<div class="en">' || {_esc('en')} || '</div><div class="zh">' || {_esc('zh')} || '</div>' END, chr(10) ORDER BY ord)) FROM t GROUP BY paper_id""",
    "wrapped_titles": V.with_(V.BLOCKS) + """SELECT paper_id, min(ord) AS ord, arg_min(id, ord) AS id, md5(string_agg(trim(en), ' ' ORDER BY ord)) AS en, count(*) AS parts FROM blocks WHERE ord % 5 < 2 GROUP BY paper_id, ord // 5""",
}
