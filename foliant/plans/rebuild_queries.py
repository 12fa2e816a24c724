"""Queries over rebuilt reference lists and notes, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import rebuild as RB
from foliant.plans.document_queries import _EXPECTED
from foliant.sources import views as V

_SPACES = "[ \\t\\n\\x0B\\f\\r]+"


def lists(s, d):
    """Each document as a reference list that was cut wrongly: a fragment holds the end of one line and the beginning of the next, under the next one's number.

    After ten fragments come the page's footer and the next page's header, after forty a figure.
    """
    order = Window.partitionBy("paper_id").orderBy("ord")
    lines = V.blocks(s, d, dealt=True).where(F.length(F.trim("en")) >= 2).select("paper_id", "en", "ord")
    rows = lines.select("paper_id", "en", (F.row_number().over(order) - 1).cast("long").alias("k"), F.lag("en").over(order).alias("prev"), F.lead("en").over(order).isNull().alias("last"))
    left = lambda c: F.substring(c, F.lit(1), F.floor(F.length(c) / 2).cast("int"))
    right = lambda c: F.substring(c, F.floor(F.length(c) / 2).cast("int") + 1, F.length(c))
    k, k10, page = F.col("k"), F.col("k") * 10, F.floor(F.col("k") / 10) + 1
    number = F.concat(F.lit("["), (k + 1).cast("string"), F.lit("] "))
    opening = F.concat(F.coalesce(F.concat(right(F.col("prev")), F.lit(" ")), F.lit("")), number, left(F.col("en")))

    def block(when, ord_, kind, at, band, en):
        made = F.struct(ord_.alias("ord"), T.block_id(ord_ + 1).alias("id"), F.lit(kind).alias("type"), at.cast("long").alias("page"), F.lit(band).cast("string").alias("band"), en.alias("en"))
        return F.when(when, made)

    each = F.array(
        block(k == 0, k10, "h2", page, None, F.lit("References")),
        block(F.lit(True), k10 + 10, "refs", page, None, opening),
        block(F.col("last"), k10 + 20, "refs", F.floor((k + 1) / 10) + 1, None, right(F.col("en"))),
        block(k % 10 == 9, k10 + 15, "refs", page, "foot", F.concat(F.lit("page "), page.cast("string"))),
        block(k % 10 == 9, k10 + 16, "refs", page + 1, "head", F.lit("A running head")),
        block(k % 40 == 39, k10 + 17, "figure", page + 1, None, F.lit("")),
    )
    return rows.select("paper_id", F.inline(F.filter(each, lambda x: x.isNotNull())))


def list_anchors(s, d):
    """Nine signs in each fragment, every fifth without a range."""
    b = lists(s, d).where("type <> 'figure'")
    k = F.col("ord")
    start = F.least(k % 7, F.length("en") - 1)
    ranged = k % 50 != 40
    return b.select("paper_id", k.alias("id"), F.col("id").alias("block_id"), F.lit("en").alias("lang"), F.when(ranged, start).alias("start"), F.when(ranged, F.least(start + 9, F.length("en"))).alias("end"))


def references_rebuilt(s, d):
    return RB.Rebuild(lists(s, d)).after()


def reference_anchors(s, d):
    return RB.Rebuild(lists(s, d)).anchors(list_anchors(s, d))


def rebuild_report(s, d):
    return RB.Rebuild(lists(s, d)).report(list_anchors(s, d))


def _stored(s, d):
    n = F.col("ord")
    zh = F.when(n % 5 == 0, "").otherwise(F.concat(F.lit("中"), "en"))
    return V.blocks(s, d).select("paper_id", "id", "page", "en", zh.alias("zh"), F.when(n % 7 == 0, "human").otherwise("mt").alias("zh_source"), (n % 4 == 0).alias("needs_review"))


def _fresh(s, d):
    """Notes at every third line, its blanks now line ends; every fourth of these has more text."""
    b = V.blocks(s, d).where("ord % 3 = 0")
    text = F.concat(F.when(F.col("ord") % 12 == 9, "x").otherwise(""), F.replace("en", F.lit(" "), F.lit("\n")))
    return b.select("paper_id", F.concat(F.lit("n-"), "id").alias("id"), "page", text.alias("en"), F.concat(F.lit("note "), F.col("ord").cast("string")).alias("note"))


def _translated(s, d):
    n = F.col("ord")
    return V.blocks(s, d).where("ord % 2 = 0").select("paper_id", "id", F.when(n % 10 == 0, " ").otherwise(F.concat(F.lit("译"), n.cast("string"))).alias("text"), (n % 4 == 0).alias("bad"))


def notes_rebuilt(s, d):
    return RB.notes_rebuilt(_stored(s, d), _fresh(s, d), _translated(s, d)).drop("old_en")


def note_anchors(s, d):
    """A range of each block's original and one of its translation."""
    b = V.blocks(s, d)
    start = F.col("ord") % 9
    base = b.select("paper_id", F.col("id").alias("block_id"), "ord", start.alias("start"), (start + 1 + F.col("ord") % 6).alias("end"), F.length("en").alias("n"))
    own = lambda lang: base.select("paper_id", F.concat("block_id", F.lit(f"-{lang}")).alias("id"), "block_id", F.lit(lang).alias("lang"), "start", "end")
    return RB.note_anchors(own("en").unionByName(own("zh")), RB.notes_rebuilt(_stored(s, d), _fresh(s, d), _translated(s, d)))


QUERIES = {
    "references_rebuilt": references_rebuilt,
    "reference_anchors": reference_anchors,
    "rebuild_report": rebuild_report,
    "notes_rebuilt": notes_rebuilt,
    "note_anchors": note_anchors,
}

_SQUEEZE = lambda x: f"trim(regexp_replace({x}, '{_SPACES}', ' ', 'g'))"

_LISTS = f"""lines AS (SELECT paper_id, en, row_number() OVER w - 1 AS k, lag(en) OVER w AS prev, lead(en) OVER w IS NULL AS last FROM blocks WHERE length(trim(en)) >= 2 WINDOW w AS (PARTITION BY paper_id ORDER BY ord)),
lists AS (
  SELECT paper_id, ord, printf('b-%04d', ord + 1) AS id, type, page, band, en FROM (
    SELECT paper_id, 0 AS ord, 'h2' AS type, 1 AS page, NULL AS band, 'References' AS en FROM lines WHERE k = 0
    UNION ALL SELECT paper_id, k * 10 + 10, 'refs', k // 10 + 1, NULL, coalesce(substr(prev, length(prev) // 2 + 1) || ' ', '') || '[' || (k + 1) || '] ' || substr(en, 1, length(en) // 2) FROM lines
    UNION ALL SELECT paper_id, k * 10 + 20, 'refs', (k + 1) // 10 + 1, NULL, substr(en, length(en) // 2 + 1) FROM lines WHERE last
    UNION ALL SELECT paper_id, k * 10 + 15, 'refs', k // 10 + 1, 'foot', 'page ' || (k // 10 + 1) FROM lines WHERE k % 10 = 9
    UNION ALL SELECT paper_id, k * 10 + 16, 'refs', k // 10 + 2, 'head', 'A running head' FROM lines WHERE k % 10 = 9
    UNION ALL SELECT paper_id, k * 10 + 17, 'figure', k // 10 + 2, NULL, '' FROM lines WHERE k % 40 = 39)
)"""
#: Where each entry begins is known: behind the end of the line before.
_CUT = f"""cut AS (SELECT *, min(CASE WHEN type = 'refs' AND band IS NULL THEN ord END) OVER (PARTITION BY paper_id, stretch) AS head
  FROM (SELECT *, sum(CASE WHEN type <> 'refs' THEN 1 ELSE 0 END) OVER (PARTITION BY paper_id ORDER BY ord) AS stretch FROM lists)),
parts AS (SELECT *, CAST(sum(length(joint) + length(en)) OVER (PARTITION BY paper_id, stretch ORDER BY ord) - length(en) AS BIGINT) AS base FROM (
  SELECT *, CASE WHEN p IS NULL OR regexp_matches(p, '\\s') OR regexp_matches(en, '^\\s') OR (p = '-' AND regexp_matches(en, '^\\pL')) THEN '' ELSE ' ' END AS joint
  FROM (SELECT c.*, right(lag(en) OVER (PARTITION BY paper_id, stretch ORDER BY ord), 1) AS p FROM cut c WHERE type = 'refs' AND band IS NULL))),
streams AS (SELECT paper_id, stretch, head, string_agg(joint || en, '' ORDER BY ord) AS stream, arg_min(id, ord) AS first, arg_min(page, ord) AS first_page FROM parts GROUP BY paper_id, stretch, head),
starts AS (SELECT p.paper_id, p.stretch, p.page, p.base + CASE WHEN l.prev IS NULL THEN 0 ELSE length(l.prev) - length(l.prev) // 2 + 1 END AS f FROM parts p JOIN lines l ON l.paper_id = p.paper_id AND l.k * 10 + 10 = p.ord),
raws AS (SELECT *, substr(stream, f + 1, t - f) AS raw FROM (
  SELECT s.paper_id, s.stretch, head, stream, x.page, f, coalesce(lead(f) OVER (PARTITION BY s.paper_id, s.stretch ORDER BY f), length(stream)) AS t, row_number() OVER (PARTITION BY s.paper_id, s.stretch ORDER BY f) AS n
  FROM streams s JOIN starts x ON s.paper_id = x.paper_id AND s.stretch = x.stretch)),
sound AS (SELECT paper_id, stretch, min(f) AS f FROM raws GROUP BY ALL HAVING count(*) > 1 AND max(length({_SQUEEZE('raw')})) <= 2000),
top AS (SELECT paper_id, max(ord) + 1 AS top FROM lists GROUP BY paper_id),
entries AS (
  SELECT r.paper_id, r.stretch, head, n, printf('b-%04d', top + row_number() OVER (PARTITION BY r.paper_id ORDER BY r.stretch, n)) AS id, 'ref' AS type, page, {_SQUEEZE('raw')} AS en, r.f, t, raw
  FROM raws r SEMI JOIN sound USING (paper_id, stretch) JOIN top ON top.paper_id = r.paper_id
  UNION ALL
  SELECT s.paper_id, s.stretch, head, 0, first, 'refs', first_page, {_SQUEEZE('substr(stream, 1, f)')}, 0, f, substr(stream, 1, f) FROM streams s JOIN sound USING (paper_id, stretch) WHERE {_SQUEEZE('substr(stream, 1, f)')} <> ''
)"""
_REBUILT = f"""rebuilt AS (
  SELECT paper_id, row_number() OVER (PARTITION BY paper_id ORDER BY at_, pg, side, sub) AS place, id, type, page, band, en FROM (
    SELECT c.paper_id, CASE WHEN among THEN head ELSE ord END AS at_, CASE WHEN among THEN page ELSE 0 END AS pg, CASE WHEN NOT among THEN 0 WHEN band = 'head' THEN 0 ELSE 2 END AS side, ord AS sub, id, type, page, band, en
    FROM (SELECT c.*, s.f IS NOT NULL AS found, s.f IS NOT NULL AND type = 'refs' AND band IS NOT NULL AND ord > head AS among FROM cut c LEFT JOIN sound s ON c.paper_id = s.paper_id AND c.stretch = s.stretch) c
    WHERE NOT (found AND type = 'refs' AND band IS NULL)
    UNION ALL SELECT paper_id, head, max(page) OVER (PARTITION BY paper_id, stretch ORDER BY n), 1, n, id, type, page, NULL, en FROM entries))"""
#: A place in an entry: as many signs as its beginning has once blanks are squeezed.
_AFTER = f"""anchors AS (SELECT paper_id, ord AS id, id AS block_id, CASE WHEN ord % 50 <> 40 THEN least(ord % 7, length(en) - 1) END AS s, CASE WHEN ord % 50 <> 40 THEN least(least(ord % 7, length(en) - 1) + 9, length(en)) END AS e FROM lists WHERE type <> 'figure'),
points AS (SELECT a.*, p.stretch, base + coalesce(s, 0) AS point, base FROM anchors a LEFT JOIN (parts SEMI JOIN sound USING (paper_id, stretch)) p ON p.paper_id = a.paper_id AND p.id = a.block_id),
met AS (SELECT p.*, x.id AS new_id, x.f, x.t, x.raw, row_number() OVER (PARTITION BY p.paper_id, p.id ORDER BY (x.f <= point) DESC, CASE WHEN x.f <= point THEN -x.f ELSE x.f END) AS k
  FROM points p LEFT JOIN entries x ON x.paper_id = p.paper_id AND x.stretch = p.stretch),
held AS (SELECT *, least(greatest(base + s, f), t - 1) - f AS a, least(greatest(base + e, least(greatest(base + s, f), t - 1) + 1), t) - 1 - f AS z FROM met WHERE k = 1),
after AS (SELECT paper_id, id, coalesce(new_id, block_id) AS block_id, 'en' AS lang, CASE WHEN new_id IS NULL OR s IS NULL THEN s ELSE PLACED_a END AS start, CASE WHEN new_id IS NULL OR s IS NULL THEN e ELSE least(PLACED_z + 1, length(SQUEEZED)) END AS "end", new_id IS NOT NULL AS moved FROM held)"""
_AFTER = _AFTER.replace("SQUEEZED", _SQUEEZE("raw"))
for _p in "az":
    _led = f"regexp_replace(ltrim(regexp_replace(substr(raw, 1, {_p}), '{_SPACES}', ' ', 'g')), ' $', '')"
    _seam = f"regexp_matches(substr(raw, {_p} + 1, 1), '\\s') OR ({_p} > 0 AND regexp_matches(substr(raw, {_p}, 1), '\\s'))"
    _AFTER = _AFTER.replace(f"PLACED_{_p}", f"CASE WHEN {_SQUEEZE(f'substr(raw, {_p} + 1)')} = '' THEN length({_led}) WHEN {_led} = '' THEN 0 WHEN {_seam} THEN length({_led}) + 1 ELSE length({_led}) END")
_BASE = (V.BLOCKS, _LISTS, _CUT)

_NOTES = f"""stored AS (SELECT paper_id, id, page, ord, en, CASE WHEN ord % 5 = 0 THEN '' ELSE '中' || en END AS zh, CASE WHEN ord % 7 = 0 THEN 'human' ELSE 'mt' END AS zh_source, ord % 4 = 0 AS needs_review, regexp_replace(en, '\\s+', '', 'g') AS tight FROM blocks),
fresh AS (SELECT *, regexp_replace(en, '\\s+', '', 'g') AS tight FROM (SELECT paper_id, 'n-' || id AS id, page, CASE WHEN ord % 12 = 9 THEN 'x' ELSE '' END || replace(en, ' ', chr(10)) AS en, 'note ' || ord AS note FROM blocks WHERE ord % 3 = 0)),
one AS (SELECT paper_id, page, tight, count(*) AS n, min({{'id': id, 'en': en, 'note': note}}) AS x FROM fresh GROUP BY ALL),
many AS (SELECT *, count(*) OVER (PARTITION BY paper_id, page, tight) AS m FROM stored),
judged AS (SELECT coalesce(m.paper_id, o.paper_id) AS paper_id, m.id AS old_id, ord, x, coalesce(m.page, o.page) AS page, m.en AS old_en, zh, zh_source, needs_review,
    CASE WHEN m.id IS NULL THEN 'missing' WHEN o.n IS NULL THEN 'kept' WHEN m <> 1 OR n <> 1 THEN 'ambiguous' WHEN m.en = x.en THEN 'kept' ELSE 'restamped' END AS fate
  FROM many m FULL JOIN one o ON m.paper_id = o.paper_id AND m.page = o.page AND m.tight = o.tight),
told AS (SELECT *, x.en AS text, 'p' AS type, CASE WHEN ord % 2 = 0 AND ord % 10 <> 0 THEN '译' || ord END AS new_zh, coalesce(fate = 'restamped' AND zh_source <> 'human' AND ord % 2 = 0 AND ord % 10 <> 0, false) AS got FROM judged),
after AS (SELECT paper_id, coalesce(old_id, x.id) AS id, page, CASE WHEN fate = 'restamped' THEN x.en ELSE coalesce(old_en, x.en) END AS en, CASE WHEN got THEN new_zh ELSE zh END AS zh,
    CASE WHEN got THEN CASE WHEN {_EXPECTED} THEN 'mt' ELSE 'none' END ELSE zh_source END AS zh_source,
    coalesce(CASE WHEN fate <> 'restamped' THEN needs_review WHEN got THEN ord % 4 = 0 WHEN trim(zh) = '' THEN true ELSE needs_review END, false) AS needs_review,
    CASE WHEN fate IN ('restamped', 'missing') THEN x.note END AS note, old_en, ord, got AS retranslated, fate FROM told)"""

ORACLES = {
    "references_rebuilt": V.with_(*_BASE, _REBUILT) + "SELECT * FROM rebuilt",
    "reference_anchors": V.with_(*_BASE, _AFTER) + "SELECT * FROM after",
    "rebuild_report": V.with_(*_BASE, _REBUILT, _AFTER) + """SELECT paper_id, refs <> refs_left AS changed, refs, entries, refs_left, coalesce(anchors_moved, 0) AS anchors_moved
      FROM (SELECT paper_id, count(*) FILTER (type = 'refs') AS refs FROM lists GROUP BY paper_id) JOIN (SELECT paper_id, count(*) FILTER (type = 'ref') AS entries, count(*) FILTER (type = 'refs') AS refs_left FROM rebuilt GROUP BY paper_id) USING (paper_id)
      LEFT JOIN (SELECT paper_id, count(*) FILTER (moved) AS anchors_moved FROM after GROUP BY paper_id) USING (paper_id)""",
    "notes_rebuilt": V.with_(V.BLOCKS, _NOTES) + "SELECT paper_id, id, page, en, zh, zh_source, needs_review, note, retranslated, fate FROM after",
    "note_anchors": V.with_(V.BLOCKS, _NOTES, """places AS (SELECT paper_id, id AS block_id, old_en, fate, retranslated, ord % 9 AS s, ord % 9 + 1 + ord % 6 AS e FROM after WHERE old_en IS NOT NULL),
      counted AS (SELECT *, length(regexp_replace(substr(old_en, 1, s), '\\s', '', 'g')) AS a, length(regexp_replace(substr(old_en, 1, e), '\\s', '', 'g')) AS z,
        list_filter(range(0, length(old_en)), lambda i: regexp_matches(substr(old_en, i + 1, 1), '\\S')) AS signs FROM places)""") + """
      SELECT paper_id, block_id || '-en' AS id, block_id, 'en' AS lang, CASE WHEN fate <> 'restamped' THEN 'kept' WHEN a < z THEN 'moved' ELSE 'removed' END AS fate,
        CASE WHEN fate <> 'restamped' THEN s WHEN a < z THEN signs[a + 1] END AS start, CASE WHEN fate <> 'restamped' THEN e WHEN a < z THEN signs[z] + 1 END AS "end" FROM counted
      UNION ALL SELECT paper_id, block_id || '-zh', block_id, 'zh', CASE WHEN retranslated THEN 'removed' ELSE 'kept' END, CASE WHEN NOT retranslated THEN s END, CASE WHEN NOT retranslated THEN e END FROM counted""",
}
