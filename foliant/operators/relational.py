"""Relational operators of the library: filters, search, ordering, aggregates, joins, sharing state, pace.

All are functions of DataFrames and parameters; the clock is a parameter (as_of), never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.session import written

STATUSES = ("unread", "reading", "read", "reviewed")
SHARE_STATES = ("active", "expiring", "expired", "revoked")
#: Seconds before its end in which a share is expiring.
EXPIRING = 3600


def as_time(value: str) -> Column:
    return F.lit(value).cast("timestamp_ntz")


def is_done(status: Column) -> Column:
    return status.isin("read", "reviewed")


def percent(part: Column, whole: Column) -> Column:
    """Half-up percentage; 0 of nothing."""
    return F.when(whole > 0, F.floor(part * 100.0 / whole + 0.5)).otherwise(F.lit(0).cast("long"))


def search(papers: DataFrame, needle: str, plan: str | None = None, status: str | None = None) -> DataFrame:
    """Title or author holds the needle, ASCII case aside; % and _ are wildcards."""
    hit = F.col("title").ilike(f"%{needle}%") | F.col("authors").ilike(f"%{needle}%")
    for column, value in (("plan_id", plan), ("status", status)):
        if value is not None:
            hit = hit & (F.col(column) == value)
    return papers.where(hit)


def search_all(papers: DataFrame, needle: str, columns: list[str]) -> DataFrame:
    """The lower-cased needle lies in the named columns joined by blanks."""
    return papers.where(F.lower(F.concat_ws(" ", *columns)).contains(needle.lower()))


def ranked(df: DataFrame, *order: Column, by: str | None = None, name: str = "rank") -> DataFrame:
    """df with the place of each row in an order, overall or within each value of `by`."""
    w = Window.partitionBy(by) if by else Window.partitionBy()
    return df.withColumn(name, F.row_number().over(w.orderBy(*order)).cast("long"))


def placed(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """df with the place of each row in a total order of all, without gathering them in one task.

    Rows are parted by ranges of the order and numbered within each; the counts of the parts before, as many numbers as
    there are parts, are added. The parted rows are written once, since parting them again would draw other ranges.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "placed")
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_row", within).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_row")).drop("_part", "_row", "_before")


def placed_within(df: DataFrame, by: str, *order: Column, name: str = "rank") -> DataFrame:
    """df with the place of each row in an order within each of the few values of `by`, none of them gathered in one task.

    As placed(), with counts for each part and value: as many rows as there are parts and values.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.repartitionByRange(parts, F.col(by), *order).withColumn("_part", F.spark_partition_id()), "placed")
    counts = ranged.groupBy(by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(F.col(by).alias("_by"), F.col("_part").alias("_of"), (F.sum("_n").over(Window.partitionBy(by).orderBy("_part")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part", by).orderBy(*order))
    joined = ranged.withColumn("_row", within).join(before, (F.col("_part") == F.col("_of")) & F.col(by).eqNullSafe(F.col("_by")))
    return joined.withColumn(name, F.col("_before") + F.col("_row")).drop("_part", "_row", "_before", "_by", "_of")


LIBRARY_ORDERS = {
    "created_desc": lambda: (F.desc("created_at"), F.asc("paper_id")),
    "created_asc": lambda: (F.asc("created_at"), F.asc("paper_id")),
    "title": lambda: (F.lower("title").asc_nulls_first(), F.asc("paper_id")),
    "year": lambda: (F.coalesce("year", F.lit(0)).desc(), F.asc("paper_id")),
    "progress": lambda: (F.desc("progress"), F.asc("paper_id")),
}


def library_order(papers: DataFrame, name: str) -> DataFrame:
    """All rows with their places in a named order; an unknown name means created_desc."""
    return placed(papers, *LIBRARY_ORDERS.get(name, LIBRARY_ORDERS["created_desc"])())


def recent(papers: DataFrame, k: int = 5) -> DataFrame:
    return papers.orderBy(F.coalesce("status_at", "created_at").desc(), "paper_id").limit(k)


def plan_stats(papers: DataFrame, by: str | None = "plan_id") -> DataFrame:
    """Papers and finished papers of each plan, or of all."""
    grouped = papers.groupBy(by) if by else papers.groupBy()
    return grouped.agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.count_if(is_done(F.col("status"))), F.lit(0)).alias("done"))


def plan_overview(plans: DataFrame, papers: DataFrame) -> DataFrame:
    """Every plan with its counts and completion; plans without papers count as zero."""
    stats = plans.join(plan_stats(papers), "plan_id", "left").na.fill(0, ["total", "done"])
    return stats.withColumn("pct", percent(F.col("done"), F.col("total")))


def histogram(df: DataFrame, column: str, domain: tuple[str, ...] | None = None) -> DataFrame:
    """Rows of each value; with a domain, exactly its values, zero-filled."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    if domain is None:
        return counts
    fixed = df.sparkSession.createDataFrame([(x,) for x in domain], f"{column} string")
    return F.broadcast(fixed).join(counts, column, "left").na.fill(0, ["n"])


def usage(users: DataFrame, plans: DataFrame, papers: DataFrame) -> DataFrame:
    """Papers and tokens of each user, users without any included. Papers are pre-aggregated by plan."""
    per_plan = papers.groupBy("plan_key").agg(F.countDistinct("paper_key").alias("papers"), F.sum("tokens").alias("tokens"))
    joined = users.join(plans, "user_key", "left").join(per_plan, "plan_key", "left")
    return joined.groupBy("user_key").agg(F.coalesce(F.sum("papers"), F.lit(0)).alias("papers"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))


def owned(rows: DataFrame, plans: DataFrame, user: int) -> DataFrame:
    """Rows whose plan belongs to the user."""
    return rows.join(plans.where(F.col("user_key") == user).select("plan_key"), "plan_key", "left_semi")


def attention(papers: DataFrame, as_of: str) -> DataFrame:
    """(kind, paper_id, title) of papers that ask for attention: conversion failed; converted and unread for 14 days; reading and untouched for 21."""
    now = as_time(as_of)
    idle = lambda at: F.datediff(F.to_date(now), F.to_date(at))
    failed = F.col("conv_state") == "failed"
    unread = (F.col("conv_state") == "done") & (F.col("status") == "unread") & (idle(F.coalesce("status_at", "created_at")) >= 14)
    stale = (F.col("status") == "reading") & (F.col("progress") > 0) & (F.col("progress") < 100) & (idle(F.coalesce("status_at", "created_at")) >= 21)
    kinds = F.filter(F.array(F.when(failed, "failed"), F.when(unread, "unread"), F.when(stale, "stale")), lambda k: k.isNotNull())
    return papers.select(F.explode(kinds).alias("kind"), "paper_id", "title")


def first_titles(rows: DataFrame, by: str, k: int = 3) -> DataFrame:
    """The number of rows of each kind and its first titles by id, joined. Each task keeps k rows of a kind before they are dealt."""
    place = F.row_number().over(Window.partitionBy(by).orderBy("paper_id"))
    first = rows.select(by, "paper_id", "title").withColumn("place", place).where(F.col("place") <= k)
    joined = first.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "title"))), lambda x: x["title"]), "、").alias("titles"))
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).join(joined, by)


def pace(stamped: DataFrame, as_of: str, buckets: int, unit: str) -> DataFrame:
    """(bucket, n) of completions in each of the last days or Monday weeks, empty ones zero; stamped: (at)."""
    today = F.to_date(as_time(as_of))
    last = F.date_trunc("week", today).cast("date") if unit == "week" else today
    step = 7 if unit == "week" else 1
    calendar = stamped.sparkSession.range(buckets).select(F.date_sub(last, (F.col("id") * step).cast("int")).alias("bucket"))
    own = F.date_trunc(unit, "at").cast("date")
    counts = stamped.select(own.alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    return calendar.join(counts, "bucket", "left").na.fill(0, ["n"])


def pace_summary(stamped: DataFrame, as_of: str, days: int) -> DataFrame:
    """Total of a rolling window, of the one before it, and the half-up change in percent (0 after nothing)."""
    now, span = as_time(as_of), F.make_dt_interval(days=F.lit(days))
    inside = (F.col("at") > now - span) & (F.col("at") <= now)
    before = (F.col("at") > now - span - span) & (F.col("at") <= now - span)
    sums = stamped.agg(F.count_if(inside).alias("total"), F.count_if(before).alias("previous"))
    change = F.when(F.col("previous") > 0, F.floor((F.col("total") - F.col("previous")) * 100.0 / F.col("previous") + 0.5)).otherwise(F.lit(0).cast("long"))
    return sums.withColumns({"change": change, "mean": F.floor(F.col("total") * 10.0 / days + 0.5) / 10})


def share_state(shares: DataFrame, as_of: str) -> DataFrame:
    """state: revoked, expired, expiring or active; seconds_left, never negative."""
    left = F.greatest(F.lit(0).cast("long"), F.coalesce(F.timestamp_diff("SECOND", as_time(as_of), F.col("expires_at")), F.lit(0)))
    over = F.col("expires_at") < as_time(as_of)
    state = F.when(F.col("revoked"), "revoked").when(over, "expired").when(F.col("expires_at").isNotNull() & (left < EXPIRING), "expiring").otherwise("active")
    return shares.withColumns({"seconds_left": left, "state": state})


def resolve_share(shares: DataFrame, token: Column, as_of: str) -> DataFrame:
    """One row: ok, missing, revoked or expired, in that precedence."""
    own = shares.where(F.col("token") == token).agg(F.count(F.lit(1)).alias("n"), F.bool_or("revoked").alias("revoked"), F.max("expires_at").alias("end"))
    verdict = F.when(F.col("n") == 0, "missing").when(F.col("revoked"), "revoked").when(F.col("end") < as_time(as_of), "expired").otherwise("ok")
    return own.select(verdict.alias("verdict"))


def renewed(shares: DataFrame, as_of: str, hours: Column) -> DataFrame:
    """A new end for each share; hours are held in 1..24."""
    held = F.greatest(F.lit(1), F.least(F.lit(24), hours)).cast("int")
    return shares.withColumn("expires_at", as_time(as_of) + F.make_dt_interval(hours=held))


def valid_sessions(sessions: DataFrame, users: DataFrame, as_of: str) -> DataFrame:
    """Sessions of known users that haven't ended; no end means for ever."""
    live = sessions.where(F.col("expires_at").isNull() | (F.col("expires_at") > as_time(as_of)))
    return live.join(users, "user_key", "left_semi")


def email_allowed(email: Column, allowed: list[str]) -> Column:
    """A well-formed address whose domain is, or lies under, an allowed one; an empty list allows all."""
    domain = F.lower(F.substring_index(email, "@", -1))
    formed = email.rlike(r"^[^@ ]+@[^@ ]+[.][^@ ]+$")
    if not allowed:
        return formed
    return formed & F.exists(F.array(*[F.lit(a.lower()) for a in allowed]), lambda a: (domain == a) | domain.endswith(F.concat(F.lit("."), a)))


def placeholder_title(title: Column, flag: Column, *sources: Column) -> Column:
    """An explicit flag decides; else no title, or one that is a source's file name without folder and ending."""
    stems = F.array(*[F.regexp_replace(F.substring_index(s, "/", -1), "[.][A-Za-z0-9]{1,5}$", "") for s in sources])
    return F.coalesce(flag, F.coalesce(F.trim(title), F.lit("")) == "", F.lit(False)) | (flag.isNull() & F.coalesce(F.array_contains(stems, F.trim(title)), F.lit(False)))


def admin_guard(users: DataFrame) -> DataFrame:
    """may_demote: whether another active administrator would be left. One number, counted ahead, is all that is shared."""
    admin = F.col("is_admin") & (F.col("status") == "active")
    total = users.where(admin).count()
    return users.withColumn("may_demote", ~F.col("is_admin") | (F.lit(total) - admin.cast("long") > 0))


def fifo(papers: DataFrame, limit: int) -> DataFrame:
    """The queued papers that come next."""
    return ranked(papers.where(F.col("conv_state") == "queued").orderBy("created_at", "paper_id").limit(limit), F.asc("created_at"), F.asc("paper_id"))


def cache_misses(docs: DataFrame, cached: DataFrame, salt: str) -> DataFrame:
    """Documents whose salted fingerprint isn't cached."""
    return docs.withColumn("fingerprint", F.sha2(F.concat(F.lit(salt), "text"), 256)).join(cached, "fingerprint", "left_anti")


def pending_pages(blocks: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Pages with blocks that haven't been reviewed; page 0 is none."""
    return blocks.where("page <> 0").select("paper_id", "page").distinct().join(reviewed, ["paper_id", "page"], "left_anti")


def token_estimate(blocks: DataFrame, per_thousand: float) -> DataFrame:
    return blocks.groupBy("paper_id").agg((F.coalesce(F.sum(F.length("en")), F.lit(0)) * per_thousand / 1000).alias("estimate"))
