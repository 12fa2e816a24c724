"""Operators over spans of text on a page: (paper_id, page, block, line, span, text, size, font, color, x0, y0, x1, y1, dir_y)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = ["paper_id", "page", "block"]
LINE = [*BLOCK, "line"]
WHITE = 0xFFFFFF
#: Shares of a page's height outside which white text is dropped.
TOP, BOTTOM = 0.075, 0.925


def page_rotation(spans: DataFrame, least: int = 200, share: float = 0.6) -> DataFrame:
    """270 or 90 where most of a page's characters run up or down, else 0."""
    n = F.length("text")
    count = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0))
    sums = spans.groupBy("paper_id", "page").agg(count(F.col("dir_y") < -0.5).alias("up"), count(F.col("dir_y") > 0.5).alias("down"), count(F.abs("dir_y") <= 0.5).alias("level"))
    vertical = F.col("up") + F.col("down")
    turned = (vertical >= least) & (vertical >= share * (vertical + F.col("level")))
    return sums.select("paper_id", "page", F.when(~turned, 0).when(F.col("up") >= F.col("down"), 270).otherwise(90).alias("rotation"))


def visible(spans: DataFrame, height: float) -> DataFrame:
    """Spans without the white ones of blocks in the zones at the edges of a page."""
    box = Window.partitionBy(*BLOCK)
    inside = (F.min("y0").over(box) > height * TOP) & (F.max("y1").over(box) < height * BOTTOM)
    return spans.withColumn("_inside", inside).where(F.col("_inside") | (F.coalesce(F.col("color"), F.lit(0)) != WHITE) | ~F.col("text").rlike(r"\S")).drop("_inside")


def joined(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Text in reading order, box, greatest size and fonts of each block or line."""
    parts = F.array_sort(F.collect_list(F.struct("line", "span", "text")))
    return spans.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda s: s["text"]), " ").alias("text"), *[f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))], F.max(F.when(F.col("text").rlike(r"\S"), F.col("size"))).alias("size"), F.array_sort(F.collect_set("font")).alias("fonts"))


def without_logos(spans: DataFrame, body: Column) -> DataFrame:
    """Spans without those of at most three characters that are twice the body's size."""
    return spans.where(~((F.length(F.trim("text")) <= 3) & (F.col("size") >= body * 2)))


def _place() -> Column:
    """The place of a span in reading order as one number, so that its least is found by hashing, without a sort."""
    return F.col("line").cast("long") * (1 << 32) + F.col("span")


def _main() -> Column:
    """Of rows (size, w, first): the size with most characters; of equal ones, that seen first."""
    return F.min_by("size", F.struct(F.col("w").isNull(), -F.col("w"), "first"))


def main_sizes(spans: DataFrame, keys: list[str]) -> DataFrame:
    """The size with most characters; of equal ones, that seen first. Spans become one row for each size before they are compared."""
    weights = spans.groupBy(*keys, "size").agg(F.sum(F.length("text")).alias("w"), F.min(_place()).alias("first"))
    return weights.groupBy(*keys).agg(_main().alias("main"))


def note_areas(spans: DataFrame, body: float, smaller: float = 0.4, gap: float = 1.0, least: int = 2) -> DataFrame:
    """(block, marks, em) of blocks in small print of which at least two lines start with a raised letter or number.

    Spans are read once: sums of each size of a line, then of a line, then of a block.
    """
    short = F.trim("text")
    mark = F.coalesce((F.length(short) <= 2) & short.rlike("^([a-z]|[0-9]{1,2})$"), F.lit(False))
    sized = spans.groupBy(*LINE, "size").agg(F.sum(F.length("text")).alias("w"), F.min(_place()).alias("first"), F.min(_place() * 2 + mark.cast("long")).alias("head"))
    lines = sized.groupBy(*LINE).agg(_main().alias("line_main"), F.min_by(F.struct("size", (F.pmod("head", F.lit(2)) == 1).alias("mark")), "first").alias("head"), F.collect_list(F.struct("size", "w", "first")).alias("sizes"))
    raised = F.col("head.mark") & (F.col("head.size") < F.col("line_main") - smaller)
    blocks = lines.groupBy(*BLOCK).agg(F.count_if(raised).alias("marks"), F.count(F.lit(1)).alias("lines"), F.flatten(F.collect_list("sizes")).alias("sizes"))
    small = blocks.where((F.col("lines") >= 2) & (F.col("marks") >= least))
    parts = small.select(*BLOCK, "marks", F.inline("sizes")).groupBy(*BLOCK, "marks", "size").agg(F.sum("w").alias("w"), F.min("first").alias("first"))
    found = parts.groupBy(*BLOCK, "marks").agg(_main().alias("main")).where((F.col("main") > 0) & (F.col("main") < body - gap))
    return found.select(*BLOCK, "marks", F.round(F.col("main") / body, 3).alias("em"))


def runin_heads(spans: DataFrame, most: int = 60, least_body: int = 25) -> DataFrame:
    """(block, head, body): leading bold spans set apart from the text they run into.

    The head is at most `most` characters and ends in no stop; the body has at least `least_body`.
    """
    order = Window.partitionBy(*BLOCK).orderBy("line", "span").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    plain = ~F.lower(F.coalesce(F.col("font"), F.lit(""))).rlike("bold|black|heavy") & F.col("text").rlike(r"\S")
    marked = spans.withColumn("_body", F.max(plain.cast("int")).over(order))
    text = lambda k: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_body") == k, F.struct("line", "span", "text")))), lambda s: s["text"]), " ")
    cut = marked.groupBy(*BLOCK).agg(F.trim(text(0)).alias("head"), F.trim(text(1)).alias("body"))
    return cut.where((F.length("head").between(1, most)) & ~F.col("head").rlike("[.,;!?，。；！？]$") & (F.length("body") >= least_body))
