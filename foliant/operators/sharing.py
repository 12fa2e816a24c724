"""Reading by share: requests with a token are judged all at once, and what a share may show is a join on its plan.

The owner's view and a share's have one shape each for papers, plans and blocks, so both come from the same projections.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators.render import asset_url, render_block
from foliant.operators.relational import share_state
from foliant.operators.validate import table_usable

PAPER = ["paper_id", "plan_id", "title", "authors", "year", "status", "status_at", "progress", "conv_state", "created_at"]


def judged(requests: DataFrame, shares: DataFrame, papers: DataFrame, as_of: str) -> DataFrame:
    """requests (token, paper_id) with plan_id and verdict: missing, revoked or expired share, "not shared" for a paper of another plan, "not converted" for one without a document, else ok.

    A request for no paper in particular (null) is one for the plan.
    """
    known = share_state(shares, as_of).select("token", "plan_id", "state")
    own = papers.select("paper_id", F.col("plan_id").alias("_plan"), (F.col("conv_state") == "done").alias("_done"))
    both = requests.join(known, "token", "left").join(own, "paper_id", "left")
    verdict = (
        F.when(F.col("state").isNull(), "missing")
        .when(F.col("state").isin("revoked", "expired"), F.col("state"))
        .when(F.col("paper_id").isNull(), "ok")
        .when(~F.col("plan_id").eqNullSafe(F.col("_plan")), "not shared")
        .when(~F.coalesce("_done", F.lit(False)), "not converted")
        .otherwise("ok")
    )
    return both.select("token", "paper_id", "plan_id", verdict.alias("verdict"))


def rows_shown(verdicts: DataFrame, rows: DataFrame) -> DataFrame:
    """(token, …): rows (paper_id, …), such as notes or marks, of the papers of requests that are not refused; a document need not be there."""
    open_ = verdicts.where("verdict in ('ok', 'not converted') and paper_id is not null").select("token", "paper_id").distinct()
    return open_.join(rows, "paper_id")


def plan_public(plans: DataFrame, papers: DataFrame) -> DataFrame:
    """plans (plan_id, …) with paper_count and done_count."""
    done = F.count_if(F.col("status").isin("read", "reviewed"))
    counted = papers.groupBy("plan_id").agg(F.count(F.lit(1)).alias("paper_count"), done.alias("done_count"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return plans.join(counted, "plan_id", "left").select(*plans.columns, zero("paper_count"), zero("done_count"))


def plans_shown(verdicts: DataFrame, plans: DataFrame, papers: DataFrame) -> DataFrame:
    """(token, plan_id, …, paper_count, done_count) of each share that may be read."""
    open_ = verdicts.where("verdict = 'ok'").select("token", "plan_id").distinct()
    return open_.join(plan_public(plans, papers), "plan_id")


def paper_public(papers: DataFrame) -> DataFrame:
    return papers.select(*PAPER)


def asset_under(src: Column, folder: Column) -> Column:
    """A relative source under a folder, that of each row; absolute ones stay."""
    return F.when(src.rlike("^(https?://|/|data:)"), src).otherwise(F.concat(folder, F.lit("/"), F.substring_index(src, "/", -1)))


def block_public(blocks: DataFrame, prefix: str | None = None) -> DataFrame:
    """blocks (paper_id, ord, id, type, en, zh, zh_source, src, rows, rows_zh, needs_review) in the shape that readers get.

    Both languages are rendered; what needs no translation says so (no_zh); a table says whether its translated grid is
    worth showing (table_zh); a relative source is put under the prefix.
    """
    no_zh = F.col("type").isin(*T.UNTRANSLATED_TYPES)
    zh = F.coalesce(F.nullif(F.col("zh"), F.lit("")), F.col("en"))
    html = lambda c: render_block(F.col("type"), F.col("id"), c)
    src = asset_url(F.col("src"), prefix) if prefix else F.col("src")
    table = F.when(F.col("type") == "table", table_usable(F.col("rows"), F.col("rows_zh"), F.coalesce("zh", F.lit(""))))
    return blocks.select("paper_id", "ord", "id", "type", "en", "zh", "zh_source", src.alias("src"), F.coalesce("needs_review", F.lit(False)).alias("needs_review"), no_zh.alias("no_zh"), html(F.col("en")).alias("en_html"), html(zh).alias("zh_html"), table.alias("table_zh"))


def documents_shown(verdicts: DataFrame, blocks: DataFrame) -> DataFrame:
    """(token, …): the blocks of each paper that a request may read, as they are now, their sources under the share's own path."""
    open_ = verdicts.where("verdict = 'ok' and paper_id is not null").select("token", "paper_id").distinct()
    shown = open_.join(block_public(blocks), "paper_id")
    return shown.withColumn("src", asset_under(F.col("src"), F.concat(F.lit("/share/"), F.col("token").cast("string"), F.lit("/papers/"), F.col("paper_id").cast("string"), F.lit("/assets"))))


def notes_of_owner(notes: DataFrame, papers: DataFrame, plans: DataFrame, owner: Column) -> DataFrame:
    """notes (note_id, paper_id, block_id) of the papers of an owner's plans: two joins that keep notes once."""
    own = papers.join(plans.where(owner).select("plan_id"), "plan_id", "left_semi").select("paper_id")
    return notes.join(own, "paper_id", "left_semi")


def notes_in_order(notes: DataFrame, blocks: DataFrame) -> DataFrame:
    """notes with the place of their block, by (paper_id, block_id); place is null for a note on no block, or on one that is gone, and such notes come last."""
    own = blocks.select("paper_id", F.col("id").alias("block_id"), F.col("ord").alias("place"))
    return notes.join(own, ["paper_id", "block_id"], "left")
