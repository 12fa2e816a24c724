"""Operators over ordered blocks: forward fills, runs, groups, neighbours, prefixes, chunks.

All take rows keyed by paper_id and ordered by ord; windows share one partitioning by paper_id, so a chain of them
shuffles once. Every order ends in a unique column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as T

KEY = "paper_id"
HEADINGS = ("h1", "h2", "h3", "h4")
PROSE = ("p", "abstract", "meta")
FURNITURE = ("deco", "eq")


def by_paper(*order: Column | str) -> Window:
    return Window.partitionBy(KEY).orderBy(*(order or ("ord",)))


def so_far(*order: Column | str):
    return by_paper(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def with_sections(blocks: DataFrame) -> DataFrame:
    """section: the text of the last heading of level 2 to 4, the block's own included."""
    heading = F.when(F.col("type").isin("h2", "h3", "h4"), F.col("en"))
    return blocks.withColumn("section", F.last(heading, ignorenulls=True).over(so_far()))


def islands(rows: DataFrame, changed: Column, name: str = "island") -> DataFrame:
    """Numbers runs: changed tells where one starts (null, as on the first row, counts as a start)."""
    return rows.withColumn(name, F.sum(F.when(F.coalesce(changed, F.lit(True)), 1).otherwise(0)).over(so_far()))


def page_groups(blocks: DataFrame) -> DataFrame:
    """Runs of blocks on one page, in order; a page can make several."""
    runs = islands(blocks, F.col("page") != F.lag("page").over(by_paper()))
    return runs.groupBy(KEY, "island").agg(F.first("page").alias("page"), F.min("ord").alias("first"), F.count(F.lit(1)).alias("n"))


def wrapped_titles(blocks: DataFrame) -> DataFrame:
    """blocks with each run of neighbouring first-level headings as one, in the place and under the id of its first: a title that was wrapped."""
    title = F.coalesce(F.col("type") == "h1", F.lit(False))
    runs = islands(blocks, ~(title & F.coalesce(F.lag(title).over(by_paper()), F.lit(False))))
    held = F.array_sort(F.collect_list(F.struct("ord", "id", "type", "en")))
    first = F.get("b", F.lit(0))
    return runs.groupBy(KEY, "island").agg(held.alias("b")).select(KEY, first["ord"].alias("ord"), first["id"].alias("id"), first["type"].alias("type"), F.array_join(F.transform("b", lambda x: F.trim(x["en"])), " ").alias("en"), F.size("b").cast("long").alias("parts"))


def merge_runs(blocks: DataFrame, alike: Column, signal: Column, least: int = 2) -> DataFrame:
    """Runs of at least `least` consecutive blocks that are alike, with a signal in one of them: the head's place, members, joined text."""
    flagged = blocks.withColumns({"alike": F.coalesce(alike, F.lit(False)), "signal": F.coalesce(signal, F.lit(False))})
    gap = F.col("ord") - F.row_number().over(Window.partitionBy(KEY, "alike").orderBy("ord"))
    grouped = flagged.withColumn("run", gap).where("alike").groupBy(KEY, "run").agg(F.min("ord").alias("head"), F.count(F.lit(1)).alias("n"), F.bool_or("signal").alias("signal"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "en"))), lambda b: b["en"]), " ").alias("text"))
    return grouped.where((F.col("n") >= least) & F.col("signal")).select(KEY, "head", "n", "text")


def paragraph_index(blocks: DataFrame, prose: tuple[str, ...] = PROSE) -> DataFrame:
    """A running number of prose blocks; null for others."""
    one = F.col("type").isin(*prose)
    return blocks.withColumn("para", F.when(one, F.sum(one.cast("int")).over(so_far())))


def outline(blocks: DataFrame) -> DataFrame:
    """Headings of levels 1 to 3, with their leading number set apart, or a dot."""
    level = F.substring("type", 2, 1).cast("int")
    number = F.regexp_extract("en", r"^((?:[IVX]{1,6}|[A-Z]|[0-9]+(?:\.[0-9]+)*)\.?) ", 1)
    return blocks.where(F.col("type").isin("h1", "h2", "h3")).select(KEY, "ord", F.greatest(F.lit(1), F.least(F.lit(3), level)).alias("level"), F.when(number == "", "·").otherwise(number).alias("number"), "en")


def without_furniture(blocks: DataFrame) -> DataFrame:
    return blocks.where(~F.col("type").isin(*FURNITURE))


def seam_pairs(blocks: DataFrame) -> DataFrame:
    """(first, second) of neighbouring prose blocks, furniture aside, of which the second goes on with the first."""
    w = by_paper()
    near = without_furniture(blocks).withColumns({"next": F.lead("ord").over(w), "next_type": F.lead("type").over(w), "next_en": F.lead("en").over(w)})
    count = lambda c: F.size(F.regexp_extract_all(c, F.lit(r"[^\s]+"), F.lit(0)))
    joined = F.col("type").isin(*PROSE) & F.col("next_type").isin(*PROSE) & (count(F.col("en")) >= 6) & (count(F.col("next_en")) >= 3) & T.continues(F.col("en"), F.col("next_en"))
    return near.where(joined).select(KEY, F.col("ord").alias("first"), F.col("next").alias("second"))


def context(blocks: DataFrame, n: int = 2) -> DataFrame:
    """The places of the n blocks before and after each, furniture aside."""
    w = by_paper()
    near = without_furniture(blocks)
    places = lambda a, b: F.array_join(F.transform(F.collect_list("ord").over(w.rowsBetween(a, b)), lambda x: x.cast("string")), ",")
    return near.select(KEY, "ord", places(-n, -1).alias("before"), places(1, n).alias("after"))


def head_prefix(blocks: DataFrame, most_chars: int = 4000, most: int = 14) -> DataFrame:
    """The blocks with text before the first that would pass the limit of characters or of number; a later, shorter one isn't taken.

    Figures, decoration and blank blocks don't count.
    """
    usable = blocks.where(~F.col("type").isin("figure", "deco") & F.col("en").rlike(r"\S"))
    summed = usable.withColumns({"chars": F.sum(F.length("en")).over(so_far()), "n": F.row_number().over(by_paper())})
    over = F.max(((F.col("chars") > most_chars) | (F.col("n") > most)).cast("int")).over(so_far())
    return summed.withColumn("over", over).where("over = 0").select(KEY, "ord", "chars")


def reference_tail(blocks: DataFrame, fraction: float = 0.35) -> DataFrame:
    """Blocks after the start of the references: the last heading-like block of the tail that names them, else the last numbered entry."""
    total = F.count(F.lit(1)).over(Window.partitionBy(KEY))
    place = F.row_number().over(by_paper()) - 1
    named = F.upper(F.regexp_replace("en", r"\s+", "")).rlike("^(REFERENCES|BIBLIOGRAPHY)") & (F.length("en") < 40)
    tail = blocks.withColumns({"total": total, "place": place}).withColumns({"named": named & (F.col("place") >= F.floor(F.col("total") * fraction)), "entry": T.numbered_reference(F.col("en"))})
    whole = Window.partitionBy(KEY)
    start = F.coalesce(F.max(F.when(F.col("named"), F.col("ord"))).over(whole), F.max(F.when(F.col("entry"), F.col("ord"))).over(whole) - 1)
    return tail.withColumn("start", start).where("ord > start and type = 'p'").select(KEY, "ord")


def renumber(blocks: DataFrame) -> DataFrame:
    """Ids anew, by place."""
    return blocks.withColumn("id", T.block_id(F.row_number().over(by_paper())))


def weighted_median(sizes: DataFrame, size: str, weight: str, default: float) -> DataFrame:
    """The lower weighted median of each paper: the least size at which half the weight is reached."""
    sums = sizes.groupBy(KEY, size).agg(F.sum(weight).alias("w"))
    running = sums.withColumns({"cum": F.sum("w").over(so_far(size)), "total": F.sum("w").over(Window.partitionBy(KEY))})
    return running.groupBy(KEY).agg(F.coalesce(F.min(F.when(F.col("cum") * 2 >= F.col("total"), F.col(size))), F.lit(default)).alias("median"))


def interval_union(rows: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """The length that a key's intervals cover together."""
    order = Window.partitionBy(key).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    gained = F.greatest(F.lit(0), F.col(end) - F.greatest(F.col(start), F.coalesce(before, F.col(start))))
    return rows.withColumn("gained", gained).groupBy(key).agg(F.sum("gained").alias("extent"))


def greedy_chunks(blocks: DataFrame, most: int = 12, most_chars: int = 6000) -> DataFrame:
    """(chunk, ord): blocks in order, a new chunk where one would pass either limit; the first block of a chunk always fits.

    A fold over the ordered array of a paper's sizes, since each cut depends on the one before.
    """
    ordered = blocks.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("ord", F.length("en").cast("long").alias("size")))).alias("b"))
    zero = F.struct(F.lit(0).cast("long").alias("chunk"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("chars"), F.array().cast("array<bigint>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        cut = (a["n"] > 0) & ((a["n"] >= most) | (a["chars"] + x["size"] > most_chars))
        chunk = a["chunk"] + cut.cast("long")
        return F.struct(chunk.alias("chunk"), F.when(cut, 1).otherwise(a["n"] + 1).cast("long").alias("n"), F.when(cut, x["size"]).otherwise(a["chars"] + x["size"]).alias("chars"), F.concat(a["out"], F.array(chunk)).alias("out"))

    folded = ordered.withColumn("chunks", F.aggregate("b", zero, step, lambda a: a["out"]))
    return folded.select(KEY, F.explode(F.arrays_zip(F.transform("b", lambda x: x["ord"]).alias("ord"), F.col("chunks").alias("chunk"))).alias("x")).select(KEY, F.col("x.chunk").alias("chunk"), F.col("x.ord").alias("ord"))


def caption_before(blocks: DataFrame, most: int = 4) -> DataFrame:
    """For each figure the nearest prose block among the `most` before it; of figures that share one, the first takes it."""
    near = F.last(F.when(F.col("type") == "p", F.col("ord")), ignorenulls=True).over(by_paper().rowsBetween(-most, -1))
    found = blocks.withColumn("caption", near).where("type = 'figure' and caption is not null")
    first = F.row_number().over(Window.partitionBy(KEY, "caption").orderBy("ord"))
    return found.withColumn("first", first).where("first = 1").select(KEY, "ord", "caption")


def joined_fragments(rows: DataFrame) -> DataFrame:
    """Fragments of a paper joined: no blank after a hyphen before a letter or next to a blank, else one."""
    ordered = rows.groupBy(KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "en"))), lambda b: b["en"]).alias("parts"))

    def step(a: Column, x: Column) -> Column:
        bare = (a == "") | (a.endswith("-") & x.rlike("^[A-Za-z]")) | a.rlike(r"\s\z") | x.rlike(r"^\s")
        return F.concat(a, F.when(bare, F.lit("")).otherwise(F.lit(" ")), x)

    return ordered.select(KEY, F.aggregate("parts", F.lit(""), step).alias("text"))
