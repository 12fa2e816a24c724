"""Queries over annotations, proofreading, translation choices, shares and paper pages, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import accounts as AC
from foliant.operators import annotations as A
from foliant.operators import editing as E
from foliant.operators import references as RE
from foliant.operators import relational as R
from foliant.operators import spans as SP
from foliant.operators import validate as VA
from foliant.plans.document_queries import _EXPECTED
from foliant.plans.layout_queries import SPANS, _spans
from foliant.session import scratch, table
from foliant.sources import documents as DO
from foliant.sources import html as H
from foliant.sources import papers as PA
from foliant.sources import views as V

PENS = ["view", "click", "purchase", "signup"]
_PENS = "'view', 'click', 'purchase', 'signup'"


def _notes(s, d):
    """Notes on the places of marks, or one further; every fifth has its mark, every eleventh stands on no block."""
    i = F.col("id")
    return V.marks(s, d).select("id", F.when(i % 11 != 0, F.col("block_id")).alias("block_id"), "lang", "start", (F.col("end") + F.when(i % 3 == 0, 0).otherwise(1)).alias("end"), F.when(i % 5 == 0, i).alias("hl_id"))


NOTES = """notes AS (SELECT id, CASE WHEN id % 11 <> 0 THEN block_id END AS block_id, lang, start, "end" + CASE WHEN id % 3 = 0 THEN 0 ELSE 1 END AS "end", CASE WHEN id % 5 = 0 THEN id END AS hl_id FROM marks)"""


def _blocks(s, d):
    """Blocks with a translation, its source and a caption."""
    n = F.col("ord")
    return V.blocks(s, d).withColumns({"zh": F.when(n % 5 == 0, "").otherwise(F.concat(F.lit("中文。"), "en", F.lit("！完"))), "zh_source": F.when(n % 7 == 0, "human").otherwise("mt"), "caption": F.when(n % 2 == 0, "")})


TRANSLATED = """translated AS (SELECT *, CASE WHEN ord % 5 = 0 THEN '' ELSE '中文。' || en || '！完' END AS zh, CASE WHEN ord % 7 = 0 THEN 'human' ELSE 'mt' END AS zh_source FROM blocks)"""


def marks_by_block(s, d):
    papers = V.papers(s, d).select(F.col("paper_id").alias("block_id"))
    done = A.marks_by_block(papers, V.marks(s, d))
    shown = F.transform("marks", lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string"), m["id"].cast("string"), m["color"]))
    return done.select("block_id", F.size("marks").cast("long").alias("n"), F.array_join(shown, ",").alias("marks"))


def highlight_checks(s, d):
    i = F.col("id")
    rows = V.marks(s, d).withColumn("end", F.when(i % 9 == 0, F.col("start")).otherwise(F.col("end")))
    return rows.select("id", A.refusal(F.col("color"), F.col("start"), F.col("end"), PENS).alias("refused"))


def notes_unmarked(s, d):
    gone = V.marks(s, d).where("id % 2 = 0").select("id")
    return A.unmarked(_notes(s, d), gone).select("id", "hl_id")


def marks_recoloured(s, d):
    m = V.marks(s, d)
    changes = m.where("id % 4 = 0").select("id", F.when(F.col("id") % 8 == 0, "click").otherwise("black").alias("color"))
    return A.recoloured(m, changes, PENS).select("id", "start", "end", "color")


def retranslated_anchors(s, d):
    changes = V.papers(s, d).select(F.col("paper_id").alias("block_id"), F.col("title").alias("old"), F.when(F.col("paper_id") % 2 == 0, F.col("title")).otherwise(F.upper("title")).alias("new"))
    return A.retranslated(V.marks(s, d).join(changes.select("block_id"), "block_id", "left_semi"), changes, ["block_id"]).select("id", "fate")


def anchors_moved(s, d):
    """The title of each paper, cut anew into two blocks, the second of which starts before the first ends."""
    p = V.papers(s, d).select(F.col("paper_id").alias("block_id"), F.length("title").cast("long").alias("n")).where("n > 3")
    half = F.floor(F.col("n") / 2)
    one = p.select("block_id", (F.col("block_id") * 2).alias("new_id"), F.lit(0).cast("long").alias("from"), (half + 1).alias("to"), F.lit(1).cast("long").alias("base"))
    two = p.select("block_id", (F.col("block_id") * 2 + 1).alias("new_id"), half.alias("from"), F.col("n").alias("to"), F.lit(1).cast("long").alias("base"))
    marks = V.marks(s, d).select("id", "block_id", F.when(F.col("id") % 10 != 0, F.col("start") % 60).alias("start"), F.when(F.col("id") % 10 != 0, F.col("start") % 60 + 5).alias("end"))
    return A.moved_to_spans(marks, one.unionByName(two))


def _sids(s, d):
    i = F.col("id")
    sid = F.when(i % 13 == 0, "b-1").otherwise(F.format_string("b-%04d:%s%d", (i % 3 + 1).cast("int"), F.when(i % 2 == 0, "e").otherwise("c"), (i % 5).cast("int")))
    return V.marks(s, d).select(F.col("block_id").alias("paper_id"), "id", sid.alias("sid"))


def sentence_ranges(s, d):
    return A.sentence_ranges(_sids(s, d), _blocks(s, d).select("paper_id", F.col("id").alias("block"), "en", "zh"), ["paper_id"])


def anchors_resolved(s, d):
    """How many sentence anchors became ranges, and how many resolve to nothing."""
    every = _sids(s, d)
    made = sentence_ranges(s, d).select("id", F.lit(1).alias("made"))
    return every.join(made, "id", "left").agg(F.count("made").alias("moved"), F.count_if(F.col("made").isNull()).alias("dropped"))


def furniture_placed(s, d):
    """Every fifth block is furniture, heads and feet by turns."""
    b = V.blocks(s, d).select("paper_id", "page", "ord")
    return RE.furniture_placed(b.where("ord % 5 <> 0"), b.where("ord % 5 = 0").withColumn("band", F.when(F.col("ord") % 10 == 0, "head").otherwise("foot")))


def shares_listed(s, d):
    plans = table(s, d, "customer").select(F.col("c_custkey").alias("plan_id"), F.col("c_nationkey").alias("user_key"))
    joined = V.shares(s, d).join(plans, "plan_id")
    return R.placed_within(joined, "user_key", F.desc("created_at"), F.asc("token"), name="place").select("user_key", "place", "token")


def share_owned(s, d):
    plans = table(s, d, "customer").where("c_nationkey = 7").select(F.col("c_custkey").alias("plan_id"))
    return V.shares(s, d).join(plans, "plan_id", "left_semi").select("token", "plan_id")


def shared_papers(s, d):
    """What each live share shows: the papers of its plan."""
    live = R.share_state(V.shares(s, d), V.SHARES_AS_OF).where(F.col("state").isin("active", "expiring")).select("token", F.col("plan_id").alias("plan_key"))
    return live.join(table(s, d, "orders").select(F.col("o_custkey").alias("plan_key"), F.col("o_orderkey").alias("paper_key")), "plan_key").select("token", "paper_key")


def users_shown(s, d):
    """Users by a status and a needle in name or address, with the number of each status beside."""
    c = table(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    shown = c.where((F.col("c_mktsegment") == "BUILDING") & F.lower("c_name").contains("00"))
    counts = c.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(shown.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("shown")), "c_mktsegment", "left").na.fill(0, ["shown"])


def page_orders(s, d):
    b = V.blocks(s, d)
    ids = b.groupBy("paper_id", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"]).alias("ids"))
    k = (F.col("paper_id") + F.col("page")) % 4
    wanted = ids.withColumn("ids", F.when(k == 0, F.col("ids")).when(k == 1, F.reverse("ids")).when(k == 2, F.slice("ids", 1, F.size("ids") - 1)).otherwise(F.concat("ids", F.slice("ids", 1, 1))))
    return E.reorder_refused(wanted, b)


def block_split(s, d):
    b = V.blocks(s, d).select("paper_id", "ord", "en")
    parts = b.where("ord % 3 = 0").select("paper_id", "ord", F.split("en", r"\. ").alias("parts"))
    return E.split_blocks(b, parts).select("paper_id", "ord", F.col("part").cast("long").alias("part"), "text")


def pages_left(s, d):
    b = V.blocks(s, d)
    return E.pages_left(b, b.where("page <= paper_id % 3").select("paper_id", "page"))


def page_overview(s, d):
    return E.overview(V.blocks(s, d), F.size(T.artifacts(F.col("en"))) > 0)


def titles(s, d):
    done = E.titles(V.blocks(s, d), "p")
    return done.select("paper_id", "title", F.size("candidates").cast("long").alias("n"), F.sha2(F.array_join("candidates", "|"), 256).alias("candidates"))


def translation_todo(s, d):
    only = V.blocks(s, d).where("ord % 4 = 1").select("paper_id", "id")
    b = _blocks(s, d)
    kinds = {"all": E.to_translate(b), "only": E.to_translate(b, only), "resume": E.to_translate(b, resume=True)}
    out = None
    for name, rows in kinds.items():
        one = rows.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n")).select("paper_id", F.lit(name).alias("choice"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def _payloads(s, d):
    """Payloads that follow from the length of a document and its first word."""
    n, word = F.length("text"), F.regexp_extract("text", "^([A-Za-z]*)", 1)
    rule = F.when(n % 3 == 0, '"below"').when(n % 3 == 1, '{"side": "above"}').otherwise('"left"')
    color = F.when(n % 4 == 0, F.concat(F.lit("#"), F.upper(F.substring(F.md5("text"), 1, 6)))).when(n % 4 == 1, "red").otherwise("#12345")
    em = F.when(n % 5 == 3, F.lit("null")).when(n % 5 == 2, F.concat(F.lit('"0.'), (n % 100).cast("string"), F.lit('"'))).otherwise(F.concat(F.lit("0."), (n % 100).cast("string")))
    payload = F.concat(F.lit('{"rule": '), rule, F.lit(', "shade": {"color": "'), color, F.lit('"}, "note": {"em": '), em, F.lit('}, "markers": ["'), F.substring(word, 1, 1), F.lit('", "'), (n % 200).cast("string"), F.lit('", "'), word, F.lit('"]}'))
    return table(s, d, "documents").where("text is not null").select("doc_id", payload.alias("p"))


def payload_checks(s, d):
    p = F.col("p")
    return _payloads(s, d).select("doc_id", E.rule_side(p).alias("side"), E.shade_color(p).alias("color"), E.note_em(p).alias("em"), F.array_join(E.note_markers(p), "|").alias("markers"))


def _sources(s, d):
    n = F.col("ord")
    return V.blocks(s, d).select("paper_id", F.when(n % 3 == 0, F.concat(F.lit("assets/f"), (n % 4).cast("string"), F.lit(".png"))).when(n % 3 == 1, "https://x/assets/y.png").alias("src"))


def asset_names(s, d):
    return E.assets(_sources(s, d), F.col("src"))


def asset_sizes(s, d):
    files = s.range(0, 3).select(F.concat(F.lit("f"), F.col("id").cast("string"), F.lit(".png")).alias("name"), ((F.col("id") + 1) * 100).alias("bytes"))
    return E.asset_bytes(asset_names(s, d), files, 300)


def cache_repointed(s, d):
    """Cache rows with nested fields and another folder of that name inside; the fields are read back."""
    kind = F.col("event_type")
    folder = F.when(kind == "view", F.concat(F.lit("old/"), "props")).when(kind == "click", F.concat(F.lit("older/"), F.lit("a"))).when(kind == "purchase", F.lit("old")).otherwise(F.lit("new"))
    value = F.to_json(F.struct(F.col("value").alias("size"), F.struct(F.lit("/data/old").alias("dir"), F.col("user_id").alias("n")).alias("inner"), F.concat(F.lit("/data/"), folder).alias("dir"), F.array(kind, F.col("props")).alias("list")))
    done = E.repointed(table(s, d, "events").select(F.col("event_id").alias("key"), value.alias("value")), "/data/old", "/data/kept")
    got = lambda p: F.get_json_object("value", p)
    return done.select("key", got("$.dir").alias("dir"), got("$.inner.dir").alias("inner_dir"), got("$.inner.n").cast("long").alias("n"), got("$.size").cast("double").alias("size"), got("$.list[0]").alias("kind"), got("$.list[1]").alias("props"))


def enqueue_guard(s, d):
    p = V.papers(s, d)
    action = F.when(F.col("paper_id") % 3 == 0, "convert").when(F.col("paper_id") % 3 == 1, "refs").otherwise("assets")
    return p.select("paper_id", E.enqueue_verdict(action, F.col("conv_state")).alias("verdict"))


def band_blocks(s, d):
    """Every third block as a line of its page, near a band of the page's middle."""
    b = V.blocks(s, d)
    lines = b.where("ord % 3 = 1").select("paper_id", "page", F.col("ord").alias("n"), F.substring("en", 3, 30).alias("text"), (F.col("ord") % 10 * 12.0).alias("y0"), (F.col("ord") % 10 * 12.0 + 10).alias("y1"), F.lit(20.0).alias("top"), F.lit(80.0).alias("bottom"))
    return E.band_blocks(lines, b)


def _paper_pages(s, d):
    """Documents as HTML papers: the first block as abstract, every fourth block as an equation with the number of its place, between numbers that belong to none."""
    b = V.blocks(s, d).select("paper_id", "ord", T.escape(F.col("en")).alias("en"))
    n = F.col("ord")
    number = F.when(n % 3 != 0, F.concat(F.lit('<span class="ltx_tag ltx_tag_equation">( '), n.cast("string"), F.lit(" )</span>"))).otherwise("")
    nested = F.lit('<table class="ltx_equation ltx_eqn_table" id="in"><tr><td>x</td></tr></table>')
    eq = F.concat(F.lit('<table id="S1.E'), n.cast("string"), F.lit('" class="ltx_eqn_table x ltx_equation"><tr><td>'), nested, F.lit('<math alttext="'), F.substring("en", 1, 5), F.lit('"><mi>y</mi></math></td><td>'), number, F.lit('</td></tr></table><span class="ltx_tag_equation">(99)</span>'))
    head = F.concat(F.lit('<div class="x ltx_abstract"><h6>Abstract</h6><div><p>'), "en", F.lit(' <math display="block" alttext="a&lt;b"><mi>a</mi></math></p></div></div><div class="ltx_abstract">no</div>'))
    part = F.when(n == 0, head).when(n % 4 == 1, eq).otherwise(F.concat(F.lit("<p>"), "en", F.lit("</p>")))
    whole = b.select("paper_id", "ord", part.alias("h")).groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("ord", "h"))).alias("l"))
    return whole.select("paper_id", F.array_join(F.transform("l", lambda x: x["h"]), "\n").alias("html"))


def paper_abstract(s, d):
    return PA.abstracts(_paper_pages(s, d), "paper_id", "html").select("paper_id", F.md5("abstract").alias("abstract"))


def equation_marks(s, d):
    return PA.equation_marks(_paper_pages(s, d), "paper_id", "html")


def paper_refs(s, d):
    """Numbers that follow from a document's length and words, in each form."""
    n, w = F.length("text"), F.size(F.split("text", " "))
    number = F.concat(F.lpad((n % 10000).cast("string"), 4, "1"), F.lit("."), F.lpad((w % 100000).cast("string"), 5, "0"))
    old = F.concat(F.lit("math.GT/"), F.lpad((n % 10000000).cast("string"), 7, "0"))
    kind = n % 6
    ref = F.when(kind == 0, F.concat(F.lit("https://arxiv.org/abs/"), number, F.lit("v2"))).when(kind == 1, F.concat(F.lit("arXiv:"), number)).when(kind == 2, F.concat(old, F.lit("v3"))).when(kind == 3, F.concat(number, F.lit("v1"))).when(kind == 4, F.concat(F.lit("see "), F.substring("text", 1, 9), F.lit(" hep-th/9901001"))).otherwise("none 12.3")
    return table(s, d, "documents").select("doc_id", H.paper_ref_parts(ref).alias("r")).select("doc_id", F.col("r.id").alias("id"), F.col("r.version").alias("version"))


def split_zh(s, d):
    zh = F.concat(F.lit("一"), F.translate("text", ".!?;", "。！？；"))
    return table(s, d, "documents").select("doc_id", F.posexplode(T.sentences(zh, "zh")).alias("n", "sentence")).select("doc_id", F.col("n").cast("long").alias("n"), "sentence")


def code_cooldown(s, d):
    """What is left of each user's cooldown at an event, since the event before."""
    last = F.lag(F.date_trunc("second", "ts")).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    slow = F.timestamp_seconds((F.unix_seconds(F.col("last").cast("timestamp")) + (F.unix_seconds(F.date_trunc("second", "ts").cast("timestamp")) - F.unix_seconds(F.col("last").cast("timestamp"))) % 100).cast("double")).cast("timestamp_ntz")
    e = table(s, d, "events").withColumn("last", last.cast("timestamp_ntz")).where("last is not null")
    return e.select("event_id", AC.cooldown_left(F.col("last"), slow).alias("left"))


def shares_backfilled(s, d):
    old = V.shares(s, d).withColumn("expires_at", F.when(F.col("token") % 2 == 0, F.col("expires_at")))
    return AC.shares_backfilled(old, V.SHARES_AS_OF).select("token", "expires_at")


def grids_usable(s, d):
    """A grid of each document's first words against one translated by its length: alike, part translated, cut short, ragged or without text."""
    w = lambda k: F.coalesce(F.get(F.split("text", " "), F.lit(k)), F.lit(""))
    i = F.length("text") % 5
    rows = F.when(i == 3, F.array(F.array(w(0), w(1)), F.array(w(2)))).otherwise(F.array(F.array(w(0), w(1)), F.array(w(2), w(3))))
    part = F.array(F.array(F.concat(F.lit("译"), w(0)), w(1)), F.array(w(2), w(3)))
    zh = F.when((i == 0) | (i == 4), part).when(i == 2, F.slice(part, 1, 1)).otherwise(rows)
    shown = F.when(i == 4, F.regexp_replace(w(0), ".", " ")).otherwise(F.concat(F.lit("译"), w(0)))
    return table(s, d, "documents").where("text is not null").select("doc_id", VA.table_usable(rows, zh, shown).alias("usable"))


def blocks_stored(s, d):
    """Blocks saved twice, the second time only some papers with other texts, and three papers loaded."""
    path = f"{scratch(s)}/foliant/stored-{uuid.uuid4().hex}"
    b = V.blocks(s, d).select("paper_id", "ord", "id", "en")
    DO.save_blocks(b, path, 8)
    DO.save_blocks(b.where("paper_id % 3 = 1").withColumn("en", F.upper("id")), path, 8)
    out = None
    for paper in (2, 4, 5):
        one = DO.load_blocks(s, path, paper).select("paper_id", "ord", "id", "en")
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {
    "code_cooldown": code_cooldown,
    "shares_backfilled": shares_backfilled,
    "grids_usable": grids_usable,
    "blocks_stored": blocks_stored,
    "logos_dropped": lambda s, d: SP.without_logos(_spans(s, d), F.lit(4.5)).groupBy("paper_id").agg(F.count(F.lit(1)).alias("n")),
    "junk_lines": lambda s, d: V.blocks(s, d).groupBy("paper_id").agg(F.count_if(T.junk(F.substring(F.trim("en"), -2, 2))).alias("n")),
    "json_values": lambda s, d: table(s, d, "documents").select("doc_id", F.array_join(DO.json_or(F.when(F.length("text") % 2 == 0, F.to_json(F.slice(F.split("text", " "), 1, 3))).when(F.length("text") % 4 == 1, F.substring("text", 1, 9)), "array<string>", F.array(F.lit("-"))), "|").alias("v")),
    "marks_by_block": marks_by_block,
    "highlights_in_order": lambda s, d: A.in_order(V.marks(s, d)).select("block_id", "place", "id"),
    "highlight_checks": highlight_checks,
    "note_highlights": lambda s, d: A.with_marks(_notes(s, d), V.marks(s, d)),
    "notes_unmarked": notes_unmarked,
    "marks_recoloured": marks_recoloured,
    "retranslated_anchors": retranslated_anchors,
    "anchors_moved": anchors_moved,
    "sentence_ranges": sentence_ranges,
    "anchors_resolved": anchors_resolved,
    "furniture_placed": furniture_placed,
    "shares_listed": shares_listed,
    "share_owned": share_owned,
    "shared_papers": shared_papers,
    "users_shown": users_shown,
    "page_orders": page_orders,
    "block_split": block_split,
    "pages_left": pages_left,
    "type_counts": lambda s, d: E.type_counts(V.blocks(s, d)),
    "max_page": lambda s, d: V.blocks(s, d).groupBy("paper_id").agg(F.max(E.page_of(F.when(F.col("ord") % 2 == 0, F.col("page").cast("string")).otherwise("x"))).cast("long").alias("page")),
    "page_overview": page_overview,
    "titles": titles,
    "participating": lambda s, d: E.participating(_blocks(s, d).withColumn("en", F.when(F.col("ord") % 26 == 12, "").otherwise(F.col("en")))).groupBy("paper_id").agg(F.count(F.lit(1)).alias("n")),
    "translation_todo": translation_todo,
    "payload_checks": payload_checks,
    "asset_names": asset_names,
    "asset_sizes": asset_sizes,
    "cache_repointed": cache_repointed,
    "enqueue_guard": enqueue_guard,
    "band_blocks": band_blocks,
    "paper_abstract": paper_abstract,
    "equation_marks": equation_marks,
    "paper_refs": paper_refs,
    "split_zh": split_zh,
    "has_math": lambda s, d: table(s, d, "documents").select("doc_id", T.has_math(F.concat("text", F.when(F.col("doc_id") % 4 == 0, r"\(x^2\)").when(F.col("doc_id") % 4 == 1, r"\(").when(F.col("doc_id") % 4 == 2, r"\[y\]").otherwise("$z$"))).alias("math")),
}

_SENTENCE_ROWS = """parts AS (SELECT paper_id, id AS block, 'en' AS lang, en AS t, list_filter(string_split(regexp_replace(en, '([.!?][.!?"''”’)\\]]*)(\\s|$)', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: regexp_matches(x, '\\S')) AS l FROM translated
  UNION ALL SELECT paper_id, id, 'zh', zh, list_filter(regexp_extract_all(zh, '[^。！？；…]+[。！？；…]*'), lambda x: regexp_matches(x, '\\S')) FROM translated)"""
_SENTENCES = """placed AS (SELECT paper_id, block, lang, k, s, CAST(sum(length(s)) OVER (PARTITION BY paper_id, block, lang ORDER BY k) AS BIGINT) AS e FROM (SELECT paper_id, block, lang, unnest(range(0, len(l))) AS k, unnest(l) AS s FROM parts))"""
_SIDS = """sids AS (SELECT block_id AS paper_id, id, CASE WHEN id % 13 = 0 THEN 'b-1' ELSE printf('b-%04d', id % 3 + 1) END AS block, CASE WHEN id % 2 = 0 THEN 'en' ELSE 'zh' END AS lang, id % 5 AS k, id % 13 <> 0 AS sound FROM marks)"""
_RANGED = """ranged AS (SELECT id, lang, e - length(s) + length(regexp_extract(s, '^\\s*', 0)) AS start, e - length(regexp_extract(s, '\\s*$', 0)) AS "end" FROM sids JOIN placed USING (paper_id, block, lang, k) WHERE sound)"""
_RANGES = V.with_(V.MARKS, V.BLOCKS, TRANSLATED, _SENTENCE_ROWS, _SENTENCES, _SIDS, _RANGED)
_SPANS = """p AS (SELECT paper_id AS block_id, length(title) AS n FROM papers WHERE length(title) > 3), spans AS (SELECT block_id, block_id * 2 AS new_id, 0 AS f, n // 2 + 1 AS t, 1 AS base FROM p UNION ALL SELECT block_id, block_id * 2 + 1, n // 2, n, 1 FROM p),
  a AS (SELECT id, block_id, CASE WHEN id % 10 <> 0 THEN start % 60 END AS start, CASE WHEN id % 10 <> 0 THEN start % 60 + 5 END AS e FROM marks),
  chosen AS (SELECT a.*, s.*, row_number() OVER (PARTITION BY a.id ORDER BY CASE WHEN f <= base + coalesce(start, 0) AND base + coalesce(start, 0) < t THEN 0 ELSE 1 END, CASE WHEN f <= base + coalesce(start, 0) AND base + coalesce(start, 0) < t THEN f ELSE -f END) AS k FROM a JOIN spans s ON s.block_id = a.block_id)"""
_LISTED = "SELECT paper_id, page, list(id ORDER BY ord) AS ids FROM blocks GROUP BY paper_id, page"

ORACLES = {
    "code_cooldown": """SELECT event_id, greatest(0, 60 - CAST(epoch(date_trunc('second', ts)) - epoch(last) AS BIGINT) % 100) AS "left" FROM (SELECT event_id, ts, lag(date_trunc('second', ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last FROM events) WHERE last IS NOT NULL""",
    "shares_backfilled": V.with_(V.SHARES) + f"SELECT token, CASE WHEN token % 2 = 0 THEN expires_at ELSE TIMESTAMP '{V.SHARES_AS_OF}' + INTERVAL 24 HOUR END AS expires_at FROM shares",
    "grids_usable": "SELECT doc_id, length(text) % 5 = 0 AS usable FROM documents WHERE text IS NOT NULL",
    "blocks_stored": V.with_(V.BLOCKS) + "SELECT paper_id, ord, id, CASE WHEN paper_id % 3 = 1 THEN upper(id) ELSE en END AS en FROM blocks WHERE paper_id IN (2, 4, 5)",
    "logos_dropped": V.with_(V.BLOCKS, SPANS) + "SELECT paper_id, count(*) AS n FROM spans WHERE NOT (length(trim(text)) <= 3 AND size >= 9) GROUP BY paper_id",
    "junk_lines": V.with_(V.BLOCKS) + r"SELECT paper_id, count(*) FILTER (WHERE regexp_matches(x, '^[^A-Za-z0-9]{0,2}$') AND NOT regexp_matches(x, '[\p{L}\p{N}]')) AS n FROM (SELECT paper_id, right(trim(en), 2) AS x FROM blocks) GROUP BY paper_id",
    "json_values": "SELECT doc_id, CASE WHEN length(text) % 2 = 0 THEN array_to_string(string_split(text, ' ')[1:3], '|') ELSE '-' END AS v FROM documents",
    "marks_by_block": V.with_(V.PAPERS, V.MARKS) + """SELECT p.paper_id AS block_id, count(id) AS n, coalesce(string_agg(start || ':' || "end" || ':' || id || ':' || color, ',' ORDER BY start, "end", id), '') AS marks FROM papers p LEFT JOIN marks m ON m.block_id = p.paper_id GROUP BY p.paper_id""",
    "highlights_in_order": V.with_(V.MARKS) + "SELECT block_id, row_number() OVER (PARTITION BY block_id ORDER BY start, id) AS place, id FROM marks",
    "highlight_checks": V.with_(V.MARKS) + f"SELECT id, CASE WHEN id % 9 = 0 THEN 'empty range' WHEN color NOT IN ({_PENS}) THEN 'no such pen' END AS refused FROM marks",
    "note_highlights": V.with_(V.MARKS, NOTES, """w AS (SELECT * FROM notes WHERE hl_id IS NULL AND block_id IS NOT NULL AND "end" > start), h AS (SELECT block_id, lang, start, "end", min(id) AS held FROM marks GROUP BY ALL)""") + """SELECT n.id, coalesce(n.hl_id, x.held) AS hl_id, x.maker FROM notes n LEFT JOIN
      (SELECT w.id, held, CASE WHEN held IS NULL THEN min(w.id) OVER (PARTITION BY w.block_id, w.lang, w.start, w."end") END AS maker FROM w LEFT JOIN h ON h.block_id = w.block_id AND h.lang = w.lang AND h.start = w.start AND h."end" = w."end") x ON x.id = n.id""",
    "notes_unmarked": V.with_(V.MARKS, NOTES) + "SELECT id, CASE WHEN hl_id % 2 = 1 THEN hl_id END AS hl_id FROM notes",
    "marks_recoloured": V.with_(V.MARKS) + """SELECT id, start, "end", CASE WHEN id % 8 = 0 THEN 'click' ELSE color END AS color FROM marks""",
    "retranslated_anchors": V.with_(V.PAPERS, V.MARKS) + "SELECT m.id, CASE WHEN lang = 'zh' AND paper_id % 2 = 1 AND title <> upper(title) THEN 'dropped' ELSE 'kept' END AS fate FROM marks m JOIN papers p ON p.paper_id = m.block_id",
    "anchors_moved": V.with_(V.PAPERS, V.MARKS, _SPANS) + """SELECT id, new_id, greatest(0, least(start + base - f, t - f)) AS start, greatest(0, least(e + base - f, t - f)) AS "end" FROM (SELECT id, new_id, start, e, base, f, t FROM chosen WHERE k = 1)""",
    "sentence_ranges": _RANGES + """SELECT id, lang, start, "end" FROM ranged WHERE "end" > start""",
    "anchors_resolved": _RANGES + """SELECT count(r.id) AS moved, count(*) - count(r.id) AS dropped FROM sids LEFT JOIN (SELECT id FROM ranged WHERE "end" > start) r USING (id)""",
    "furniture_placed": V.with_(V.BLOCKS) + """SELECT paper_id, page, ord, CASE WHEN ord % 10 = 0 THEN 'head' WHEN ord % 5 = 0 THEN 'foot' END AS band,
      row_number() OVER (PARTITION BY paper_id ORDER BY page, CASE WHEN ord % 10 = 0 THEN 0 WHEN ord % 5 = 0 THEN 2 ELSE 1 END, ord) AS place FROM blocks""",
    "shares_listed": V.with_(V.SHARES) + "SELECT c_nationkey AS user_key, row_number() OVER (PARTITION BY c_nationkey ORDER BY created_at DESC, token) AS place, token FROM shares JOIN customer ON c_custkey = plan_id",
    "share_owned": V.with_(V.SHARES) + "SELECT token, plan_id FROM shares WHERE plan_id IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7)",
    "shared_papers": V.with_(V.SHARES) + f"SELECT token, o_orderkey AS paper_key FROM shares JOIN orders ON o_custkey = plan_id WHERE NOT revoked AND expires_at >= TIMESTAMP '{V.SHARES_AS_OF}'",
    "users_shown": "SELECT c_mktsegment, count(*) AS n, count(*) FILTER (WHERE c_mktsegment = 'BUILDING' AND contains(lower(c_name), '00')) AS shown FROM customer GROUP BY c_mktsegment",
    "page_orders": V.with_(V.BLOCKS) + f"SELECT paper_id, page, CASE (paper_id + page) % 4 WHEN 0 THEN 'unchanged' WHEN 1 THEN CASE WHEN len(ids) = 1 THEN 'unchanged' ELSE 'reordered' END ELSE 'refused' END AS verdict FROM ({_LISTED})",
    "block_split": V.with_(V.BLOCKS, """cut AS (SELECT paper_id, ord, en, CASE WHEN ord % 3 = 0 THEN list_filter(list_transform(string_split(en, '. '), lambda x: trim(x)), lambda x: x <> '') ELSE [] END AS l FROM blocks)""") + "SELECT paper_id, ord, unnest(range(0, len(l))) AS part, unnest(l) AS text FROM (SELECT paper_id, ord, CASE WHEN len(l) >= 2 THEN l ELSE [en] END AS l FROM cut)",
    "pages_left": V.with_(V.BLOCKS) + "SELECT paper_id, count(*) FILTER (WHERE page > paper_id % 3) AS n_left, count(*) FILTER (WHERE page > paper_id % 3) = 0 AS finished FROM (SELECT DISTINCT paper_id, page FROM blocks) GROUP BY paper_id",
    "type_counts": V.with_(V.BLOCKS) + "SELECT paper_id, type, count(*) AS n FROM blocks GROUP BY ALL",
    "max_page": V.with_(V.BLOCKS) + "SELECT paper_id, CAST(max(CASE WHEN ord % 2 = 0 THEN page ELSE 0 END) AS BIGINT) AS page FROM blocks GROUP BY paper_id",
    "page_overview": V.with_(V.BLOCKS) + r"""SELECT paper_id, page, count(*) AS n_blocks, CAST(sum(length(en)) AS BIGINT) AS n_chars, count(*) FILTER (WHERE regexp_matches(en, '\b[A-Za-z]{2,}-\s+[a-z]{2,}') OR regexp_matches(en, '[A-Za-z0-9_]\s+\.(\s|$)')
      OR len(list_filter(regexp_extract_all(en, '\[[^\]\n]{0,14}?\]'), lambda x: regexp_matches(x, '^\[\s|\s\]$') AND regexp_matches(x, '[0-9]'))) > 0) AS n_suspect FROM blocks GROUP BY paper_id, page""",
    "titles": V.with_(V.BLOCKS) + r"SELECT paper_id, arg_min(trim(en), ord) AS title, count(*) AS n, sha256(string_agg(trim(en), '|' ORDER BY ord)) AS candidates FROM blocks WHERE type = 'p' AND regexp_matches(en, '\S') GROUP BY paper_id",
    "participating": V.with_(V.BLOCKS) + "SELECT paper_id, count(*) AS n FROM blocks WHERE type <> 'figure' OR ord % 26 <> 12 AND en <> '' GROUP BY paper_id",
    "translation_todo": V.with_(V.BLOCKS, TRANSLATED, f"own AS (SELECT *, en AS text FROM translated WHERE (type <> 'figure' OR coalesce(en <> '', false)) AND zh_source <> 'human'), todo AS (SELECT * FROM own WHERE {_EXPECTED})") + r"""SELECT paper_id, 'all' AS choice, count(*) AS n FROM todo GROUP BY paper_id
      UNION ALL SELECT paper_id, 'only', count(*) FROM todo WHERE ord % 4 = 1 GROUP BY paper_id UNION ALL SELECT paper_id, 'resume', count(*) FROM todo WHERE NOT regexp_matches(zh, '\S') GROUP BY paper_id""",
    "payload_checks": r"""SELECT doc_id, CASE n % 3 WHEN 0 THEN 'below' WHEN 1 THEN 'above' END AS side, CASE WHEN n % 4 = 0 THEN '#' || upper(substr(md5(text), 1, 6)) ELSE '' END AS color, em,
      CASE WHEN em > 0 THEN concat(substr(word, 1, 1), '|', CASE WHEN n % 200 < 100 THEN CAST(n % 200 AS VARCHAR) ELSE '' END, '|', CASE WHEN length(word) = 1 THEN word ELSE '' END) ELSE '' END AS markers
      FROM (SELECT *, CAST(CASE WHEN n % 5 = 3 THEN 0 WHEN e > 0.5 AND e <= 0.98 THEN e ELSE 0 END AS DOUBLE) AS em FROM (SELECT doc_id, text, length(text) AS n, CAST('0.' || (length(text) % 100) AS DOUBLE) AS e, regexp_extract(text, '^([A-Za-z]*)', 1) AS word FROM documents WHERE text IS NOT NULL))""",
    "asset_names": V.with_(V.BLOCKS) + "SELECT DISTINCT paper_id, 'f' || ord % 4 || '.png' AS name FROM blocks WHERE ord % 3 = 0",
    "asset_sizes": V.with_(V.BLOCKS) + "SELECT paper_id, count(*) AS n, CAST(sum(k + 1) * 100 AS BIGINT) AS bytes, sum(k + 1) * 100 <= 300 AS fits FROM (SELECT DISTINCT paper_id, ord % 4 AS k FROM blocks WHERE ord % 3 = 0) WHERE k < 3 GROUP BY paper_id",
    "cache_repointed": """SELECT event_id AS key, '/data/' || CASE event_type WHEN 'view' THEN 'kept/' || props WHEN 'click' THEN 'older/a' WHEN 'purchase' THEN 'kept' ELSE 'new' END AS dir, '/data/old' AS inner_dir, user_id AS n, value AS size, event_type AS kind, props FROM events""",
    "enqueue_guard": V.with_(V.PAPERS) + "SELECT paper_id, CASE WHEN paper_id % 3 = 0 AND conv_state NOT IN ('doing', 'queued') OR paper_id % 3 <> 0 AND conv_state = 'done' THEN 'queued' ELSE 'conflict' END AS verdict FROM papers",
    "band_blocks": V.with_(V.BLOCKS, r"""lines AS (SELECT paper_id, page, ord AS n, lower(regexp_replace(substr(en, 3, 30), '[\s-]+', '', 'g')) AS line FROM blocks WHERE ord % 3 = 1 AND ord % 10 * 12 >= 18 AND ord % 10 * 12 + 10 <= 82)""") + r"""SELECT DISTINCT paper_id, page, id FROM
      (SELECT l.paper_id, l.page, b.id, row_number() OVER (PARTITION BY l.paper_id, l.page, l.n ORDER BY length(en), ord) AS k FROM lines l JOIN blocks b ON b.paper_id = l.paper_id AND b.page = l.page AND b.type = 'p' AND length(line) >= 3 AND contains(lower(regexp_replace(en, '[\s-]+', '', 'g')), line)) WHERE k = 1""",
    "paper_abstract": V.with_(V.BLOCKS) + r"""SELECT paper_id, md5(trim(regexp_replace(en, '\s+', ' ', 'g') || ' \[a<b\]')) AS abstract FROM blocks WHERE ord = 0""",
    "equation_marks": V.with_(V.BLOCKS) + "SELECT paper_id, 'S1.E' || ord AS eq_id, CASE WHEN ord % 3 <> 0 THEN CAST(ord AS VARCHAR) ELSE '' END AS number FROM blocks WHERE ord % 4 = 1",
    "paper_refs": """SELECT doc_id, CASE k WHEN 2 THEN 'math.GT/' || lpad(CAST(n % 10000000 AS VARCHAR), 7, '0') WHEN 4 THEN 'hep-th/9901001' WHEN 5 THEN NULL ELSE number END AS id, CASE k WHEN 0 THEN 'v2' WHEN 2 THEN 'v3' WHEN 3 THEN 'v1' WHEN 5 THEN NULL ELSE '' END AS version
      FROM (SELECT *, lpad(CAST(n % 10000 AS VARCHAR), 4, '1') || '.' || lpad(CAST(w % 100000 AS VARCHAR), 5, '0') AS number, n % 6 AS k FROM (SELECT doc_id, length(text) AS n, len(string_split(text, ' ')) AS w FROM documents WHERE text IS NOT NULL)) UNION ALL SELECT doc_id, NULL, NULL FROM documents WHERE text IS NULL""",
    "split_zh": "SELECT doc_id, unnest(range(0, len(l))) AS n, unnest(l) AS sentence FROM (SELECT doc_id, list_filter(regexp_extract_all('一' || translate(text, '.!?;', '。！？；'), '[^。！？；…]+[。！？；…]*'), lambda x: regexp_matches(x, '\\S')) AS l FROM documents)",
    "has_math": r"SELECT doc_id, regexp_matches(t, '(?s)\\\(.+?\\\)|\\\[.+?\\\]') AS math FROM (SELECT doc_id, text || CASE doc_id % 4 WHEN 0 THEN '\(x^2\)' WHEN 1 THEN '\(' WHEN 2 THEN '\[y\]' ELSE '$z$' END AS t FROM documents)",
}
