"""Library tables as views over the driver's tables, in DataFrame form and, for the oracles, as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.session import table

BASE_TIME = "2024-01-01 00:00:00"


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document, with the status, progress and conversion state that its labels and id give."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    i = F.col("doc_id")
    status = F.when(F.col("quality").isNull(), "unread").when(F.col("quality") == 0, "reading").when(F.col("toxic") == 1, "reviewed").otherwise("read")
    state = F.when(i % 11 == 0, "failed").when(i % 11 == 1, "queued").when(i % 11 == 2, "doing").when(i % 11 == 3, "none").otherwise("done")
    base = docs.join(labels, "doc_id", "left").select(
        i.alias("paper_id"),
        F.col("source").alias("plan_id"),
        F.substring("text", 1, 40).alias("title"),
        F.col("lang").alias("authors"),
        "n_chars",
        F.when(i % 7 != 0, (2000 + i % 25).cast("int")).alias("year"),
        status.alias("status"),
        (F.col("n_chars") % 101).alias("progress"),
        state.alias("conv_state"),
        (F.lit(BASE_TIME).cast("timestamp_ntz") + F.make_dt_interval(hours=i.cast("int"))).alias("created_at"),
        F.col("n_chars").alias("tokens_used"),
    )
    stamped = F.when(F.col("status") != "unread", F.col("created_at") + F.make_dt_interval(days=(F.col("paper_id") % 40).cast("int")))
    return base.withColumn("status_at", stamped)


PAPERS = f"""papers AS (
  SELECT *, CASE WHEN status <> 'unread' THEN created_at + to_days(CAST(paper_id % 40 AS INTEGER)) END AS status_at FROM (
    SELECT d.doc_id AS paper_id, source AS plan_id, substr(text, 1, 40) AS title, lang AS authors, n_chars,
      CASE WHEN d.doc_id % 7 <> 0 THEN CAST(2000 + d.doc_id % 25 AS INTEGER) END AS year,
      CASE WHEN quality IS NULL THEN 'unread' WHEN quality = 0 THEN 'reading' WHEN toxic = 1 THEN 'reviewed' ELSE 'read' END AS status,
      n_chars % 101 AS progress,
      CASE d.doc_id % 11 WHEN 0 THEN 'failed' WHEN 1 THEN 'queued' WHEN 2 THEN 'doing' WHEN 3 THEN 'none' ELSE 'done' END AS conv_state,
      TIMESTAMP '{BASE_TIME}' + to_hours(d.doc_id) AS created_at, n_chars AS tokens_used
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id))"""


def blocks(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """The lines of each document as blocks: ten to a page, with a type by place and length.

    With dealt, documents are dealt by paper before they are cut, so that what groups by paper moves each text once and
    nothing that is made of it.
    """
    docs = table(spark, sf_dir, "documents")
    if dealt:
        docs = docs.select("doc_id", "text").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    lines = docs.select(F.col("doc_id").alias("paper_id"), F.posexplode(F.split("text", "\n", -1)).alias("ord", "en"))
    kind = F.when(F.trim("en") == "", "deco").when((F.col("ord") == 0) & (F.length("en") <= 60), "h2").when(F.col("ord") % 13 == 12, "figure").otherwise("p")
    return lines.select("paper_id", F.col("ord").cast("long").alias("ord"), F.format_string("b-%04d", F.col("ord") + 1).alias("id"), (F.floor(F.col("ord") / 10) + 1).alias("page"), kind.alias("type"), "en")


BLOCKS = """blocks AS (
  SELECT paper_id, ord, printf('b-%04d', ord + 1) AS id, ord // 10 + 1 AS page,
    CASE WHEN trim(en) = '' THEN 'deco' WHEN ord = 0 AND length(en) <= 60 THEN 'h2' WHEN ord % 13 = 12 THEN 'figure' ELSE 'p' END AS type, en
  FROM (SELECT doc_id AS paper_id, unnest(range(0, len(l))) AS ord, unnest(l) AS en FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))"""


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highlights from events: a range on a block and language, with arrival time and id."""
    e = table(spark, sf_dir, "events")
    start = F.floor(F.col("value") * 7) % 400
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("block_id"), F.when(F.col("event_id") % 2 == 0, "en").otherwise("zh").alias("lang"), start.alias("start"), (start + 1 + F.col("event_id") % 40).alias("end"), F.col("event_type").alias("color"), "ts")


MARKS = """marks AS (
  SELECT event_id AS id, user_id AS block_id, CASE WHEN event_id % 2 = 0 THEN 'en' ELSE 'zh' END AS lang, s AS start, s + 1 + event_id % 40 AS "end", event_type AS color, ts
  FROM (SELECT *, CAST(floor(value * 7) AS BIGINT) % 400 AS s FROM events))"""


def progress_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading events: scrolls, manual marks and edits of a paper's progress."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type").isin("view", "click"), "scroll").when(F.col("event_type") == "purchase", "mark_read").when(F.col("event_type") == "signup", "mark_unread").otherwise("user_edit")
    return e.select(F.col("user_id").alias("paper_id"), "ts", F.col("event_id").alias("seq"), (F.floor("value") % 101).alias("pct"), kind.alias("kind"))


PROGRESS = """progress_log AS (
  SELECT user_id AS paper_id, ts, event_id AS seq, CAST(floor(value) AS BIGINT) % 101 AS pct,
    CASE WHEN event_type IN ('view', 'click') THEN 'scroll' WHEN event_type = 'purchase' THEN 'mark_read' WHEN event_type = 'signup' THEN 'mark_unread' ELSE 'user_edit' END AS kind
  FROM events)"""


def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share links from events, each with its hours and its end."""
    e = table(spark, sf_dir, "events").withColumn("created_at", F.date_trunc("second", "ts").cast("timestamp_ntz"))
    hours = 1 + F.col("event_id") % 24
    return e.select(F.col("event_id").alias("token"), F.col("user_id").alias("plan_id"), "created_at", hours.alias("hours"), (F.col("created_at") + F.make_dt_interval(hours=hours.cast("int"))).alias("expires_at"), (F.col("event_type") == "error").alias("revoked"))


SHARES = """shares AS (
  SELECT event_id AS token, user_id AS plan_id, date_trunc('second', ts) AS created_at, 1 + event_id % 24 AS hours,
    date_trunc('second', ts) + to_hours(1 + event_id % 24) AS expires_at, event_type = 'error' AS revoked
  FROM events)"""
#: The clock of the share queries: every operator takes its time as a parameter.
SHARES_AS_OF = "2024-01-15 00:00:00"


def with_(*views: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}{', '.join(views)} "
