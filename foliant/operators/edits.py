"""Edits of stored blocks as rewrites: insertion, deletion, correction, merging; matching of two versions of a paper."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as T

KEY = "paper_id"


def inserted(blocks: DataFrame, new: DataFrame) -> DataFrame:
    """blocks with new ones (paper_id, after, en, type) behind the block named; ids go on from the highest, page and section are the neighbour's."""
    highest = blocks.groupBy(KEY).agg(F.max(F.regexp_extract("id", "([0-9]+)$", 1).cast("int")).alias("top"))
    place = F.row_number().over(Window.partitionBy(KEY).orderBy("after", "en"))
    at = new.withColumn("_n", place).join(highest, KEY).join(blocks.select(KEY, F.col("id").alias("after"), F.col("ord").alias("_ord"), F.col("page").alias("_page")), [KEY, "after"])
    rows = at.select(KEY, F.col("_ord").alias("ord"), F.col("_n").alias("_sub"), T.block_id(F.col("top") + F.col("_n")).alias("id"), F.col("_page").alias("page"), "type", "en")
    both = blocks.select(KEY, "ord", F.lit(0).alias("_sub"), "id", "page", "type", "en").unionByName(rows)
    return both.withColumn("ord", (F.row_number().over(Window.partitionBy(KEY).orderBy("ord", "_sub")) - 1).cast("long")).drop("_sub")


def deleted(blocks: DataFrame, gone: DataFrame, notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks without those of (paper_id, id), notes): notes of a block that goes lose their anchor and keep its text as quote."""
    left = blocks.join(gone, [KEY, "id"], "left_anti")
    old = blocks.join(gone, [KEY, "id"], "left_semi").select(KEY, F.col("id").alias("block_id"), F.col("en").alias("_old"))
    joined = notes.join(old, [KEY, "block_id"], "left")
    lost = F.col("_old").isNotNull()
    quote = F.substring(F.col("_old"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    kept = lambda c: F.when(~lost, F.col(c))
    return left, joined.select(KEY, "note_id", kept("block_id").alias("block_id"), kept("start").alias("start"), kept("end").alias("end"), F.when(lost, quote).alias("quote"))


def corrected(blocks: DataFrame, patch: DataFrame) -> DataFrame:
    """blocks after a patch (paper_id, id, en, zh): a translation makes it human, an original alone asks for review."""
    p = patch.select(KEY, "id", F.col("en").alias("_en"), F.col("zh").alias("_zh"))
    joined = blocks.join(p, [KEY, "id"], "left")
    source = F.when(F.col("_zh").isNotNull(), "human").when(F.col("_en").isNotNull(), "needs_review").otherwise(F.col("zh_source"))
    return joined.withColumns({"en": F.coalesce("_en", "en"), "zh": F.coalesce("_zh", "zh"), "zh_source": source}).drop("_en", "_zh")


def merged_into_previous(blocks: DataFrame, flagged: str) -> DataFrame:
    """Flagged blocks joined to the nearest one before them that isn't; a first block stays."""
    order = Window.partitionBy(KEY).orderBy("ord")
    start = F.when((F.row_number().over(order) == 1) | ~F.col(flagged), 1).otherwise(0)
    group = F.sum("_start").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    runs = blocks.withColumn("_start", start).withColumn("_group", group)
    parts = F.array_sort(F.collect_list(F.struct("ord", "id", "type", "en")))
    return runs.groupBy(KEY, "_group").agg(parts.alias("p")).select(KEY, F.col("p")[0]["ord"].alias("ord"), F.col("p")[0]["id"].alias("id"), F.col("p")[0]["type"].alias("type"), F.array_join(F.transform("p", lambda b: b["en"]), " ").alias("en"), F.size("p").cast("long").alias("parts"))


def matched(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """(paper_id, stored, fresh): blocks of one page and text, white space aside, that are one of a kind on both sides and not the same text."""
    key = [KEY, "page", "_tight"]
    side = lambda df, name: df.withColumn("_tight", F.sha2(T.tight(F.col("en")), 256)).groupBy(*key).agg(F.count(F.lit(1)).alias(f"_{name}"), F.first("id").alias(name), F.first("en").alias(f"{name}_en"))
    both = side(stored, "stored").join(side(fresh, "fresh"), key).where("_stored = 1 and _fresh = 1")
    return both.where("stored_en <> fresh_en").select(KEY, "stored", "fresh")


def same_layout(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """same: whether two versions of a paper agree in every id and text at every place."""
    pick = lambda df, s: df.select(KEY, "ord", F.col("id").alias(f"{s}_id"), F.col("en").alias(f"{s}_en"))
    both = pick(stored, "a").join(pick(fresh, "b"), [KEY, "ord"], "full")
    agree = F.col("a_id").eqNullSafe(F.col("b_id")) & F.col("a_en").eqNullSafe(F.col("b_en"))
    return both.groupBy(KEY).agg(F.bool_and(agree).alias("same"))


def queue_states(log: DataFrame, most: int = 3) -> DataFrame:
    """(paper_id, state, attempts) after a queue's log (paper_id, ts, seq, event): a fold, since each step depends on the last.

    enqueue queues what isn't in hand and forgets earlier attempts; claim takes what is queued and counts; done, fail and
    decline end what is in hand; lost fails a queued one before its claim, for good at `most`; restart queues again.
    """
    ordered = log.groupBy(KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "seq", "event"))), lambda x: x["event"]).alias("events"))
    zero = F.struct(F.lit("none").alias("state"), F.lit(0).cast("long").alias("attempts"))

    def step(a, e):
        s, n = a["state"], a["attempts"]
        make = lambda state, count: F.struct(state.alias("state"), count.cast("long").alias("attempts"))
        return (
            F.when((e == "enqueue") & (s != "doing"), make(F.lit("queued"), F.lit(0)))
            .when((e == "claim") & (s == "queued"), make(F.lit("doing"), n + 1))
            .when(e.isin("done", "fail", "decline") & (s == "doing"), make(F.when(e == "done", "done").otherwise("failed"), n))
            .when((e == "lost") & (s == "queued"), make(F.when(n + 1 >= most, "failed").otherwise("queued"), n + 1))
            .when((e == "restart") & (s == "doing"), make(F.lit("queued"), n))
            .otherwise(a)
        )

    folded = ordered.select(KEY, F.aggregate("events", zero, step).alias("x"))
    return folded.select(KEY, "x.state", "x.attempts")
