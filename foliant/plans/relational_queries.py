"""Relational queries of the library over the stand-in views, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import relational as R
from foliant.session import table
from foliant.sources import views as V

AS_OF = "2024-03-01 00:00:00"


def _tenants(spark, sf):
    """Customers own orders, which hold line items: users, plans and papers."""
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_key"))
    plans = table(spark, sf, "orders").select(F.col("o_orderkey").alias("plan_key"), F.col("o_custkey").alias("user_key"))
    papers = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("plan_key"), F.col("l_linenumber").alias("paper_key"), F.col("l_quantity").cast("long").alias("tokens"))
    return users, plans, papers


def _stamped(spark, sf):
    p = V.papers(spark, sf)
    return p.where(R.is_done(F.col("status"))).select(F.coalesce("status_at", "created_at").alias("at"))


def overview_by_plan(spark, sf):
    p = V.papers(spark, sf)
    return R.plan_overview(p.select("plan_id").distinct(), p)


def usage_per_user(spark, sf):
    return R.usage(*_tenants(spark, sf))


def board_columns(spark, sf):
    p = V.papers(spark, sf)
    out = R.placed_within(p, "status", F.coalesce("status_at", "created_at").desc(), F.asc("paper_id"), name="place")
    return out.select("status", "place", "paper_id")


def placeholder_title(spark, sf):
    p = V.papers(spark, sf)
    title = F.translate("title", "./\n ", "____")
    source = F.concat(F.lit("/in/"), F.when(F.col("paper_id") % 5 == 0, title).otherwise("paper"), F.lit(".pdf"))
    flag = F.when(F.col("paper_id") % 6 == 0, F.lit(True)).when(F.col("paper_id") % 6 == 1, F.lit(False))
    return p.select("paper_id", R.placeholder_title(title, flag, source).alias("placeholder"))


def session_validity(spark, sf):
    s = V.shares(spark, sf).select(F.col("token"), F.col("plan_id").alias("user_key"), F.when(~F.col("revoked"), F.col("expires_at")).alias("expires_at"))
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_key"))
    return R.valid_sessions(s, users, V.SHARES_AS_OF).select("token", "user_key")


def email_allowlist(spark, sf):
    c = table(spark, sf, "customer")
    host = F.when(F.col("c_custkey") % 3 == 0, "example.org").when(F.col("c_custkey") % 3 == 1, "mail.Example.org").otherwise("badexample.org")
    email = F.concat(F.lit("u"), F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 10 == 9, F.lit("")).otherwise(F.lit("@")), host)
    return c.select("c_custkey", R.email_allowed(email, ["example.org"]).alias("allowed"))


def fixed_point_admin_guard(spark, sf):
    n = table(spark, sf, "supplier").select("s_suppkey", (F.col("s_nationkey") == 7).alias("is_admin"), F.when(F.col("s_suppkey") % 4 == 0, "disabled").otherwise("active").alias("status"))
    return R.admin_guard(n)


def cache_misses(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    cached = d.where("doc_id % 3 = 0").select(F.sha2(F.concat(F.lit("parse-v17"), "text"), 256).alias("fingerprint")).distinct()
    return R.cache_misses(d, cached, "parse-v17").select("doc_id", "fingerprint")


def note_order(spark, sf):
    m = V.marks(spark, sf).withColumn("block_id", F.when(F.col("id") % 9 != 0, F.col("block_id")))
    order = (F.col("block_id").isNull().cast("int"), F.col("block_id"), F.when(F.col("id") % 4 == 0, 0).otherwise(1), F.when(F.col("id") % 4 == 0, -1).otherwise(F.col("start")), F.when(F.col("lang") == "en", 0).otherwise(1), F.col("id"))
    keyed = m.select("id", *[c.alias(f"k{i}") for i, c in enumerate(order)])
    return R.placed(keyed, *[F.asc(f"k{i}") for i in range(len(order))], name="place").select("place", "id")


QUERIES = {
    "overview_by_plan": overview_by_plan,
    "plan_totals": lambda s, d: R.plan_stats(V.papers(s, d), None),
    "status_histogram_zero_filled": lambda s, d: R.histogram(V.papers(s, d), "status", R.STATUSES),
    "conv_state_histogram": lambda s, d: R.histogram(V.papers(s, d), "conv_state"),
    "usage_per_user": usage_per_user,
    "library_search": lambda s, d: R.search(V.papers(s, d), "the%er", plan="src3").select("paper_id", "title"),
    "library_search_all_fields": lambda s, d: R.search_all(V.papers(s, d), "TH EN", ["title", "authors", "plan_id"]).select("paper_id"),
    "library_sorted_title": lambda s, d: R.library_order(V.papers(s, d), "title").select("rank", "paper_id"),
    "library_sorted_year": lambda s, d: R.library_order(V.papers(s, d), "year").select("rank", "paper_id"),
    "library_sorted_progress": lambda s, d: R.library_order(V.papers(s, d), "progress").select("rank", "paper_id"),
    "library_sorted_created": lambda s, d: R.library_order(V.papers(s, d), "unknown").select("rank", "paper_id"),
    "board_columns": board_columns,
    "recent_top5": lambda s, d: R.recent(V.papers(s, d)).select("paper_id", "status"),
    "attention_list": lambda s, d: R.attention(V.papers(s, d), AS_OF).select("kind", "paper_id"),
    "attention_titles": lambda s, d: R.first_titles(R.attention(V.papers(s, d), AS_OF), "kind"),
    "pace_7d": lambda s, d: R.pace(_stamped(s, d), "2024-02-10 12:00:00", 7, "day"),
    "pace_30d": lambda s, d: R.pace(_stamped(s, d), "2024-02-20 12:00:00", 30, "day"),
    "pace_12w": lambda s, d: R.pace(_stamped(s, d), "2024-03-20 12:00:00", 12, "week"),
    "pace_summary": lambda s, d: R.pace_summary(_stamped(s, d), "2024-02-10 12:00:00", 7),
    "share_state": lambda s, d: R.share_state(V.shares(s, d), V.SHARES_AS_OF).select("token", "state", "seconds_left"),
    "share_state_counts": lambda s, d: R.histogram(R.share_state(V.shares(s, d), V.SHARES_AS_OF), "state", R.SHARE_STATES),
    "share_filter_active": lambda s, d: R.histogram(R.share_state(V.shares(s, d), V.SHARES_AS_OF).where(F.col("state").isin("active", "expiring")), "state", R.SHARE_STATES),
    "share_resolve": lambda s, d: R.resolve_share(V.shares(s, d), F.lit(77), V.SHARES_AS_OF),
    "share_renew": lambda s, d: R.renewed(V.shares(s, d), V.SHARES_AS_OF, F.col("hours") * 2 - 5).select("token", "expires_at"),
    "owner_scope_join": lambda s, d: (lambda u, p, l: R.owned(l, p, 7).select("plan_key", "paper_key", "tokens"))(*_tenants(s, d)),
    "session_validity": session_validity,
    "email_allowlist": email_allowlist,
    "placeholder_title": placeholder_title,
    "queue_fifo": lambda s, d: R.fifo(V.papers(s, d), 25).select("rank", "paper_id"),
    "cache_misses": cache_misses,
    "pending_pages": lambda s, d: R.pending_pages(V.blocks(s, d), V.blocks(s, d).where("(paper_id + page) % 3 = 0").select("paper_id", "page").distinct()),
    "fixed_point_admin_guard": fixed_point_admin_guard,
    "note_order": note_order,
    "token_estimate": lambda s, d: R.token_estimate(V.blocks(s, d), 3.5).select("paper_id", F.round("estimate", 4).alias("estimate")),
}

_SEARCHED = "FROM papers WHERE"
_DONE = "status IN ('read', 'reviewed')"
_AT = f"stamped AS (SELECT coalesce(status_at, created_at) AS done_at FROM papers WHERE {_DONE})"
_TENANTS = "plans AS (SELECT o_orderkey AS plan_key, o_custkey AS user_key FROM orders), items AS (SELECT l_orderkey AS plan_key, l_linenumber AS paper_key, CAST(l_quantity AS BIGINT) AS tokens FROM lineitem)"
_STATE = f"""states AS (SELECT *, greatest(0, date_diff('second', TIMESTAMP '{V.SHARES_AS_OF}', expires_at)) AS seconds_left,
  CASE WHEN revoked THEN 'revoked' WHEN expires_at < TIMESTAMP '{V.SHARES_AS_OF}' THEN 'expired' WHEN date_diff('second', TIMESTAMP '{V.SHARES_AS_OF}', expires_at) < 3600 THEN 'expiring' ELSE 'active' END AS state FROM shares)"""
_ATTENTION = f"""attention AS (
  SELECT 'failed' AS kind, paper_id, title FROM papers WHERE conv_state = 'failed'
  UNION ALL SELECT 'unread', paper_id, title FROM papers WHERE conv_state = 'done' AND status = 'unread' AND date_diff('day', CAST(coalesce(status_at, created_at) AS DATE), DATE '{AS_OF[:10]}') >= 14
  UNION ALL SELECT 'stale', paper_id, title FROM papers WHERE status = 'reading' AND progress > 0 AND progress < 100 AND date_diff('day', CAST(coalesce(status_at, created_at) AS DATE), DATE '{AS_OF[:10]}') >= 21)"""


def _ordered(order: str) -> str:
    return V.with_(V.PAPERS) + f"SELECT row_number() OVER (ORDER BY {order}, paper_id) AS rank, paper_id FROM papers"


def _pace(day: str, n: int, unit: str) -> str:
    step = 7 if unit == "week" else 1
    return V.with_(V.PAPERS, _AT) + f"""SELECT bucket, count(done_at) AS n FROM
      (SELECT CAST(CAST(date_trunc('{unit}', DATE '{day}') AS DATE) - CAST(k * {step} AS INTEGER) AS DATE) AS bucket FROM (SELECT unnest(range(0, {n})) AS k))
      LEFT JOIN stamped ON CAST(date_trunc('{unit}', done_at) AS DATE) = bucket GROUP BY bucket"""


ORACLES = {
    "overview_by_plan": V.with_(V.PAPERS) + f"SELECT plan_id, count(*) AS total, count(*) FILTER (WHERE {_DONE}) AS done, CAST(floor(count(*) FILTER (WHERE {_DONE}) * 100.0 / count(*) + 0.5) AS BIGINT) AS pct FROM papers GROUP BY plan_id",
    "plan_totals": V.with_(V.PAPERS) + f"SELECT count(*) AS total, count(*) FILTER (WHERE {_DONE}) AS done FROM papers",
    "status_histogram_zero_filled": V.with_(V.PAPERS) + "SELECT d.status, count(paper_id) AS n FROM (SELECT unnest(['unread', 'reading', 'read', 'reviewed']) AS status) d LEFT JOIN papers p ON p.status = d.status GROUP BY d.status",
    "conv_state_histogram": V.with_(V.PAPERS) + "SELECT conv_state, count(*) AS n FROM papers GROUP BY conv_state",
    "usage_per_user": V.with_(_TENANTS) + "SELECT c_custkey AS user_key, CAST(coalesce(sum(n), 0) AS BIGINT) AS papers, CAST(coalesce(sum(t), 0) AS BIGINT) AS tokens FROM customer LEFT JOIN plans ON user_key = c_custkey LEFT JOIN (SELECT plan_key, count(DISTINCT paper_key) AS n, sum(tokens) AS t FROM items GROUP BY plan_key) i ON i.plan_key = plans.plan_key GROUP BY c_custkey",
    "library_search": V.with_(V.PAPERS) + f"SELECT paper_id, title {_SEARCHED} plan_id = 'src3' AND (title ILIKE '%the%er%' OR authors ILIKE '%the%er%')",
    "library_search_all_fields": V.with_(V.PAPERS) + f"SELECT paper_id {_SEARCHED} contains(lower(concat_ws(' ', title, authors, plan_id)), 'th en')",
    "library_sorted_title": _ordered("lower(title) ASC NULLS FIRST"),
    "library_sorted_year": _ordered("coalesce(year, 0) DESC"),
    "library_sorted_progress": _ordered("progress DESC NULLS LAST"),
    "library_sorted_created": _ordered("created_at DESC NULLS LAST"),
    "board_columns": V.with_(V.PAPERS) + "SELECT status, row_number() OVER (PARTITION BY status ORDER BY coalesce(status_at, created_at) DESC, paper_id) AS place, paper_id FROM papers",
    "recent_top5": V.with_(V.PAPERS) + "SELECT paper_id, status FROM papers ORDER BY coalesce(status_at, created_at) DESC, paper_id LIMIT 5",
    "attention_list": V.with_(V.PAPERS, _ATTENTION) + "SELECT kind, paper_id FROM attention",
    "attention_titles": V.with_(V.PAPERS, _ATTENTION) + "SELECT kind, count(*) AS n, string_agg(title, '、' ORDER BY place) FILTER (WHERE place <= 3) AS titles FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY paper_id) AS place FROM attention) GROUP BY kind",
    "pace_7d": _pace("2024-02-10", 7, "day"),
    "pace_30d": _pace("2024-02-20", 30, "day"),
    "pace_12w": _pace("2024-03-20", 12, "week"),
    "pace_summary": V.with_(V.PAPERS, _AT) + """SELECT *, CASE WHEN previous > 0 THEN CAST(floor((total - previous) * 100.0 / previous + 0.5) AS BIGINT) ELSE 0 END AS change, floor(total * 10.0 / 7 + 0.5) / 10 AS mean FROM
      (SELECT count(*) FILTER (WHERE done_at > TIMESTAMP '2024-02-03 12:00:00' AND done_at <= TIMESTAMP '2024-02-10 12:00:00') AS total, count(*) FILTER (WHERE done_at > TIMESTAMP '2024-01-27 12:00:00' AND done_at <= TIMESTAMP '2024-02-03 12:00:00') AS previous FROM stamped)""",
    "share_state": V.with_(V.SHARES, _STATE) + "SELECT token, state, seconds_left FROM states",
    "share_state_counts": V.with_(V.SHARES, _STATE) + "SELECT d.state, count(token) AS n FROM (SELECT unnest(['active', 'expiring', 'expired', 'revoked']) AS state) d LEFT JOIN states s ON s.state = d.state GROUP BY d.state",
    "share_filter_active": V.with_(V.SHARES, _STATE) + "SELECT d.state, count(token) AS n FROM (SELECT unnest(['active', 'expiring', 'expired', 'revoked']) AS state) d LEFT JOIN (SELECT * FROM states WHERE state IN ('active', 'expiring')) s ON s.state = d.state GROUP BY d.state",
    "share_resolve": V.with_(V.SHARES) + f"SELECT CASE WHEN count(*) = 0 THEN 'missing' WHEN bool_or(revoked) THEN 'revoked' WHEN max(expires_at) < TIMESTAMP '{V.SHARES_AS_OF}' THEN 'expired' ELSE 'ok' END AS verdict FROM shares WHERE token = 77",
    "share_renew": V.with_(V.SHARES) + f"SELECT token, TIMESTAMP '{V.SHARES_AS_OF}' + to_hours(greatest(1, least(24, hours * 2 - 5))) AS expires_at FROM shares",
    "owner_scope_join": V.with_(_TENANTS) + "SELECT i.plan_key, paper_key, tokens FROM items i JOIN plans p ON p.plan_key = i.plan_key WHERE user_key = 7",
    "session_validity": V.with_(V.SHARES) + f"SELECT token, plan_id AS user_key FROM shares WHERE (revoked OR expires_at > TIMESTAMP '{V.SHARES_AS_OF}') AND plan_id IN (SELECT c_custkey FROM customer)",
    "email_allowlist": "SELECT c_custkey, c_custkey % 3 < 2 AND c_custkey % 10 <> 9 AS allowed FROM customer",
    "placeholder_title": "SELECT doc_id AS paper_id, CASE WHEN doc_id % 6 = 0 THEN true WHEN doc_id % 6 = 1 THEN false ELSE text = '' OR doc_id % 5 = 0 END AS placeholder FROM documents",
    "queue_fifo": V.with_(V.PAPERS) + "SELECT * FROM (SELECT row_number() OVER (ORDER BY created_at, paper_id) AS rank, paper_id FROM papers WHERE conv_state = 'queued') WHERE rank <= 25",
    "cache_misses": "SELECT doc_id, sha256('parse-v17' || text) AS fingerprint FROM documents WHERE sha256('parse-v17' || text) NOT IN (SELECT sha256('parse-v17' || text) FROM documents WHERE doc_id % 3 = 0)",
    "pending_pages": V.with_(V.BLOCKS) + "SELECT DISTINCT paper_id, page FROM blocks WHERE page <> 0 AND (paper_id + page) % 3 <> 0",
    "fixed_point_admin_guard": "SELECT s_suppkey, s_nationkey = 7 AS is_admin, CASE WHEN s_suppkey % 4 = 0 THEN 'disabled' ELSE 'active' END AS status, s_nationkey <> 7 OR (SELECT count(*) FROM supplier WHERE s_nationkey = 7 AND s_suppkey % 4 <> 0) - CASE WHEN s_nationkey = 7 AND s_suppkey % 4 <> 0 THEN 1 ELSE 0 END > 0 AS may_demote FROM supplier",
    "note_order": V.with_(V.MARKS) + """SELECT row_number() OVER (ORDER BY CASE WHEN id % 9 = 0 THEN 1 ELSE 0 END, CASE WHEN id % 9 <> 0 THEN block_id END NULLS FIRST, CASE WHEN id % 4 = 0 THEN 0 ELSE 1 END,
      CASE WHEN id % 4 = 0 THEN -1 ELSE start END, CASE WHEN lang = 'en' THEN 0 ELSE 1 END, id) AS place, id FROM marks""",
    "token_estimate": V.with_(V.BLOCKS) + "SELECT paper_id, round(CAST(sum(length(en)) AS DOUBLE) * 3.5 / 1000, 4) AS estimate FROM blocks GROUP BY paper_id",
}
