"""State machines over ordered logs in batch form, and data changes as rewrites. The streaming forms are in foliant.streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def so_far():
    return Window.partitionBy("paper_id").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def progress(log: DataFrame) -> DataFrame:
    """progress after each event of a reading log.

    A mark starts an epoch: read locks 100, unread resets to 0, an edit sets its value; scrolls within an epoch only
    raise it, and do nothing while it is locked.
    """
    mark = F.col("kind") != "scroll"
    epochs = log.withColumn("epoch", F.sum(F.when(mark, 1).otherwise(0)).over(so_far()))
    within = Window.partitionBy("paper_id", "epoch").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    started = F.first(F.when(mark, F.col("kind"))).over(within)
    value = F.when(F.col("kind") == "mark_read", 100).when(F.col("kind") == "mark_unread", 0).otherwise(F.col("pct"))
    return epochs.withColumn("progress", F.when(F.coalesce(started, F.lit("")) == "mark_read", F.lit(100)).otherwise(F.max(value).over(within)).cast("long"))


def first_scrolls(log: DataFrame) -> DataFrame:
    """The scroll that turns each unread epoch into reading: the first after its start or after a mark of unread."""
    epochs = log.withColumn("epoch", F.sum(F.when(F.col("kind") != "scroll", 1).otherwise(0)).over(so_far()))
    within = Window.partitionBy("paper_id", "epoch").orderBy("ts", "seq")
    begun = F.first("kind").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    nth = F.sum(F.when(F.col("kind") == "scroll", 1).otherwise(0)).over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    flips = epochs.withColumns({"begun": begun, "nth": nth}).where("kind = 'scroll' and nth = 1 and (begun = 'mark_unread' or (epoch = 0))")
    return flips.select("paper_id", "seq", F.col("ts").alias("status_at"))


def claims(requests: DataFrame, key: str) -> DataFrame:
    """The first request for each key takes it; the others find it taken."""
    place = F.row_number().over(Window.partitionBy(key).orderBy("ts", "seq"))
    return requests.withColumn("claimed", place == 1)


def throttled(log: DataFrame, step: int = 2) -> DataFrame:
    """Of each paper's scrolls those that are sent on: `step` more than the last one sent, or the first to reach 100.

    A fold over the ordered array of a paper, since each choice depends on the last row that was sent.
    """
    ordered = log.where("kind = 'scroll'").groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("ts", "seq", "pct"))).alias("l"))
    zero = F.struct(F.lit(-1000).cast("long").alias("last"), F.array().cast("array<bigint>").alias("out"))

    def one(a: Column, x: Column) -> Column:
        send = (x["pct"] >= a["last"] + step) | ((x["pct"] == 100) & (a["last"] < 100))
        return F.when(send, F.struct(x["pct"].alias("last"), F.concat(a["out"], F.array(x["seq"])).alias("out"))).otherwise(a)

    return ordered.select("paper_id", F.explode(F.aggregate("l", zero, one, lambda a: a["out"])).alias("seq"))


def upsert(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """The latest row of each key of old and new; the higher version wins, new on ties."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    latest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version), F.desc("_new")))
    return both.withColumn("_n", latest).where("_n = 1").drop("_n", "_new")


def sparse_merge(old: DataFrame, patch: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Old values where they aren't blank, the patch's otherwise."""
    p = patch.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    kept = lambda c: F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.col(f"_{c}"))
    return old.join(p, key, "left").withColumns({c: kept(c) for c in columns}).drop(*[f"_{c}" for c in columns])


def cascade_delete(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Parents and children without the keys that go."""
    return parents.join(gone, key, "left_anti"), children.join(gone, key, "left_anti")


def recovered(papers: DataFrame) -> DataFrame:
    """After a restart: work in hand is queued again; its attempts stay as they were."""
    return papers.withColumn("conv_state", F.when(F.col("conv_state") == "doing", "queued").otherwise(F.col("conv_state")))
