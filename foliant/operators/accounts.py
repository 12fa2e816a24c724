"""Accounts and stored state: one-time codes, backfills of older rows, what a paper's metadata may overwrite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators.relational import as_time, placeholder_title


def issued_codes(requests: DataFrame, minutes: int = 10) -> DataFrame:
    """(email, purpose, hash, expires_at): the latest code of each address and purpose."""
    hashed = requests.withColumn("hash", T.code_hash(F.col("email"), F.col("purpose"), F.col("code")))
    latest = hashed.groupBy(F.lower(F.trim("email")).alias("email"), "purpose").agg(F.max_by(F.struct("hash", "ts"), F.struct("ts", "code")).alias("x"))
    return latest.select("email", "purpose", "x.hash", (F.col("x.ts") + F.make_dt_interval(mins=F.lit(minutes))).alias("expires_at"))


def code_verdict(issued: DataFrame, tries: DataFrame) -> DataFrame:
    """Each try with its verdict: none, expired, wrong or ok."""
    t = tries.withColumn("hash_tried", T.code_hash(F.col("email"), F.col("purpose"), F.col("code"))).withColumn("email", F.lower(F.trim("email")))
    joined = t.join(issued, ["email", "purpose"], "left")
    verdict = F.when(F.col("hash").isNull(), "none").when(F.col("expires_at") < F.col("ts"), "expired").when(F.col("hash") != F.col("hash_tried"), "wrong").otherwise("ok")
    return joined.select("email", "purpose", "ts", verdict.alias("verdict"))


def cooldown_left(last: Column, now: Column, seconds: int = 60) -> Column:
    """Seconds until another code may be sent."""
    return F.greatest(F.lit(0).cast("long"), F.lit(seconds) - F.timestamp_diff("SECOND", last, now))


def backfilled(papers: DataFrame) -> DataFrame:
    """Rows of before the reading time was kept take the time of their last change, if they were read at all."""
    return papers.withColumn("last_read_at", F.coalesce("last_read_at", F.when(F.col("progress") > 0, F.col("updated_at"))))


def shares_backfilled(shares: DataFrame, now: str) -> DataFrame:
    return shares.withColumn("expires_at", F.coalesce("expires_at", as_time(now) + F.make_dt_interval(hours=F.lit(24))))


def metadata_written(papers: DataFrame, meta: DataFrame) -> DataFrame:
    """A model's metadata where a paper has none: the title only in place of a placeholder, Chinese over English."""
    m = meta.select("paper_id", *[F.col(c).alias(f"_{c}") for c in ("title_zh", "title_en", "authors", "year")])
    joined = papers.join(m, "paper_id", "left")
    own = placeholder_title(F.col("title"), F.col("placeholder"))
    found = F.coalesce(F.nullif(F.trim("_title_zh"), F.lit("")), F.nullif(F.trim("_title_en"), F.lit("")))
    title = F.when(own, F.coalesce(found, F.col("title"))).otherwise(F.col("title"))
    return joined.select("paper_id", title.alias("title"), F.coalesce(F.nullif(F.trim("authors"), F.lit("")), F.col("_authors")).alias("authors"), F.coalesce("year", "_year").alias("year"))
