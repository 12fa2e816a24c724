"""Tables made of several blocks: proposals are judged against the text they take in, and accepted ones replace their blocks.

A cell must occur in the blocks' joined text, blanks and hyphens aside, since a cell's text often runs over a block's
end. What cells and caption do not cover must be less than a handful of words, each stretch covered once, longest texts
first. A block goes into one table: proposals of a paper are taken in order.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.functions.multisets import bound
from foliant.operators.validate import grid_shape, grid_text
from foliant.session import ship, written

#: What is no content of a cell, beside blanks; most rows of a table; words left over that show text left out, and words that don't count among them.
HYPHENS = "\\-\u00ad\u2010\u2011\u2012\u2013\u2014\u2212"
MOST_ROWS, RESIDUE = 80, 4
COMMON = ["the", "and", "for", "with", "that", "this", "from", "are", "was", "not", "table", "figure", "note", "total", "other", "than", "more", "less", "see"]
KEY = ["paper_id", "table_id"]


def bare(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), f"[\\s{HYPHENS}]+", "")


def placeable(source: Column, cell: Column) -> Column:
    """Whether a cell's text occurs in a source, blanks and hyphens aside."""
    return bare(source).contains(bare(cell))


def left_words(source: str | None, placed: list[str] | None) -> list[str]:
    """The words of a source that placed texts don't cover; longer texts are taken out first, and a stretch once. Linear in the source for each text."""
    flat = re.sub(r"(?<=[A-Za-z])-\s+(?=[a-z])", "", re.sub(r"\s+", " ", (source or "").replace("\u00ad", "")))
    kept = [i for i, c in enumerate(flat) if not _DROPPED.match(c)]
    tight, taken = "".join(flat[i] for i in kept), bytearray(len(kept))
    for text in sorted({_DROPPED.sub("", p or "") for p in placed if p} if placed is not None else (), key=lambda p: (-len(p), p)):
        at = tight.find(text) if len(text) > 1 else -1
        while at >= 0:
            if taken.find(1, at, at + len(text)) < 0:
                taken[at : at + len(text)] = b"\1" * len(text)
                at = tight.find(text, at + len(text))
            else:
                at = tight.find(text, at + 1)
    signs = list(flat)
    for i, gone in zip(kept, taken, strict=True):
        if gone:
            signs[i] = " "
    return [w for w in re.findall("[A-Za-z][A-Za-z's-]{3,}", "".join(signs)) if w.lower() not in COMMON]


_DROPPED = re.compile(f"[\\s{HYPHENS}]")


def _left(sources: pd.Series, placed: pd.Series) -> pd.Series:
    return pd.Series([left_words(s, None if p is None else list(p)) for s, p in zip(sources, placed, strict=True)])


def residue(source: Column, placed: Column) -> Column:
    """left_words() over columns, in Arrow batches: a cell may be as long as a block, too long for a pattern."""
    return F.pandas_udf(_left, "array<string>")(source, placed)


def judged(proposals: DataFrame, blocks: DataFrame) -> DataFrame:
    """proposals (paper_id, table_id, ids, rows, caption) with verdict (empty if sound), their blocks in the order given, and detail, the cells or words that speak against them."""
    ship(proposals.sparkSession)
    each = proposals.select(*KEY, F.posexplode(F.array_distinct("ids")).alias("k", "id"))
    own = blocks.select("paper_id", "id", "ord", "type", "page", "en", F.lit(True).alias("there"))
    held = F.array_sort(F.collect_list(F.struct("k", "id", "ord", "type", "page", "en", "there")))
    taken = each.join(own, ["paper_id", "id"], "left").groupBy(*KEY).agg(held.alias("blocks"))
    rows = F.transform("rows", lambda r: F.transform(r, lambda c: F.trim(T.clean_text(c))))
    both = proposals.withColumn("rows", rows).join(taken, KEY, "left").withColumn("source", F.array_join(F.transform("blocks", lambda b: F.coalesce(b["en"], F.lit(""))), "\n"))
    shape = grid_shape(F.col("rows"))
    cells = F.filter(F.flatten("rows"), lambda c: c != "")
    missing = bound(bare(F.col("source")), lambda s: F.filter(cells, lambda c: ~s.contains(bare(c))))
    both = both.withColumns({"shape": shape, "missing": missing, "left": residue(F.col("source"), F.concat(cells, F.filter(F.array(F.coalesce("caption", F.lit(""))), lambda c: c != "")))})
    pages = F.array_distinct(F.transform("blocks", lambda b: b["page"]))
    verdict = (
        F.when(F.coalesce(F.size("blocks"), F.lit(0)) < 2, "few blocks")
        .when(F.exists("blocks", lambda b: b["there"].isNull()), "no such block")
        .when(F.size(pages) > 1, "several pages")
        .when(F.exists("blocks", lambda b: b["type"].isin("figure", "table")), "no text block")
        .when(F.col("shape").isNull(), "ragged")
        .when((F.col("shape.rows") < 2) | (F.col("shape.columns") < 2), "too small")
        .when(F.col("shape.rows") > MOST_ROWS, "too long")
        .when(F.size(cells) == 0, "empty")
        .when(F.size("missing") > 0, "not in the source")
        .when(F.size("left") >= RESIDUE, "text left out")
        .otherwise("")
    )
    detail = F.when(verdict == "not in the source", F.col("missing")).when(verdict == "text left out", F.col("left")).otherwise(F.array().cast("array<string>"))
    return both.select(*KEY, "rows", "caption", "blocks", verdict.alias("verdict"), detail.alias("detail"))


def settled(proposals: DataFrame, blocks: DataFrame) -> DataFrame:
    """judged(), where a sound proposal is refused ("taken") if one before it was accepted that holds one of its blocks."""
    sound = written(judged(proposals, blocks), "tables")  # judged once, though read twice
    order = F.array_sort(F.collect_list(F.struct("table_id", F.transform("blocks", lambda b: b["id"]).alias("ids"))))
    zero = F.struct(F.array().cast("array<string>").alias("held"), F.array().cast("array<bigint>").alias("won"))
    step = lambda a, x: F.when(F.arrays_overlap(a["held"], x["ids"]), a).otherwise(F.struct(F.concat(a["held"], x["ids"]).alias("held"), F.concat(a["won"], F.array(x["table_id"])).alias("won")))
    won = sound.where("verdict = ''").groupBy("paper_id").agg(F.aggregate(order, zero, step, lambda a: a["won"]).alias("won")).select("paper_id", F.explode("won").alias("table_id"), F.lit(True).alias("accepted"))
    both = sound.join(won, KEY, "left")
    verdict = F.when((F.col("verdict") == "") & F.col("accepted").isNull(), "taken").otherwise(F.col("verdict"))
    return both.withColumn("verdict", verdict).drop("accepted")


def tabled(settlements: DataFrame, blocks: DataFrame) -> DataFrame:
    """blocks (paper_id, ord, id, page, type, en) after settled() proposals: a table where the first of its blocks stood, under a new id, and those blocks gone; all in one rewrite."""
    won = settlements.where("verdict = ''")
    gone = won.select("paper_id", F.explode("blocks").alias("b")).select("paper_id", F.col("b.id").alias("id"))
    number = F.when(F.col("id").rlike("^b-[0-9]+$"), F.substring("id", 3, 18).cast("long"))
    highest = blocks.groupBy("paper_id").agg(F.coalesce(F.max(number), F.lit(0)).alias("top"))
    ranked = won.groupBy("paper_id").agg(F.array_sort(F.collect_list("table_id")).alias("order"))
    first = F.get("blocks", F.lit(0))
    new = won.join(ranked, "paper_id").join(highest, "paper_id").select("paper_id", first["ord"].alias("ord"), T.block_id(F.col("top") + F.array_position("order", F.col("table_id"))).alias("id"), first["page"].alias("page"), F.lit("table").alias("type"), grid_text(F.col("rows"), F.col("caption")).alias("en"))
    return blocks.select("paper_id", "ord", "id", "page", "type", "en").join(gone, ["paper_id", "id"], "left_anti").select("paper_id", "ord", "id", "page", "type", "en").unionByName(new)
