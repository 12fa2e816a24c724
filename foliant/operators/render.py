"""Rendering of blocks as HTML expressions, and of documents as ordered joins of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as T


def render_block(kind: Column, block_id: Column, body: Column, level: Column | None = None) -> Column:
    """A block's element by type, with its id as marker; untranslated types carry a second one."""
    marks = F.concat(F.lit(' data-b="'), block_id, F.lit('"'), F.when(kind.isin(*T.UNTRANSLATED_TYPES), F.lit(' data-nt="1"')).when(kind == "ref", F.lit(' data-pt="1"')).otherwise(F.lit("")))
    tag = F.when(kind.isin("h1", "h2", "h3", "h4"), kind).when(kind.isin("figure", "deco"), "figure").when(kind == "eq", "div").otherwise("p")
    inner = F.when(kind.isin("figure", "deco"), F.concat(F.lit("<figcaption>"), T.escape(body), F.lit("</figcaption>"))).otherwise(T.escape(body))
    return F.concat(F.lit("<"), tag, marks, F.lit(">"), inner, F.lit("</"), tag, F.lit(">"))


def rendered(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("html", render_block(F.col("type"), F.col("id"), F.col("en")))


def document(blocks: DataFrame, title: str | None = None) -> DataFrame:
    """One HTML document for each paper, its blocks in order. A document is one record, gathered by its key."""
    parts = rendered(blocks).groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "html"))), lambda b: b["html"]), "\n").alias("body"))
    head = F.concat(F.lit('<!doctype html><html lang="en"><head><meta charset="utf-8"><title>'), T.escape(F.lit(title or "")), F.lit("</title></head><body>\n"))
    return parts.select("paper_id", F.concat(head, "body", F.lit("\n</body></html>")).alias("html"))


def document_modes(blocks: DataFrame) -> DataFrame:
    """(paper_id, mode, html): each paper's body in its language, in the other (a block without a translation as it stands), and with both side by side."""
    other = F.coalesce(F.nullif(F.col("zh"), F.lit("")), F.col("en"))
    html = lambda c: render_block(F.col("type"), F.col("id"), c)
    shaped = dual_rows(blocks).select("paper_id", "ord", F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), h.alias("html")) for m, h in (("en", html(F.col("en"))), ("zh", html(other)), ("dual", F.col("row")))])).alias("m"))
    whole = shaped.groupBy("paper_id", "m.mode").agg(F.array_sort(F.collect_list(F.struct("ord", "m.html"))).alias("l"))
    return whole.select("paper_id", "mode", F.array_join(F.transform("l", lambda x: x["html"]), "\n").alias("html"))


def dual_rows(blocks: DataFrame) -> DataFrame:
    """Two cells where a translation stands beside a text, one wide cell otherwise."""
    wide = F.col("type").isin(*T.UNTRANSLATED_TYPES) | ~F.coalesce(F.col("zh"), F.lit("")).rlike(r"\S")
    cell = lambda c, css: F.concat(F.lit(f'<div class="{css}">'), T.escape(c), F.lit("</div>"))
    return blocks.withColumn("row", F.when(wide, cell(F.col("en"), "wide")).otherwise(F.concat(cell(F.col("en"), "en"), cell(F.col("zh"), "zh"))))


def page_sections(groups: DataFrame) -> DataFrame:
    """Runs of blocks on one page (paper_id, island, page, first, n) with the label of the section they make: the page and the paper's last one, nothing without a page."""
    last = F.max("page").over(Window.partitionBy("paper_id"))
    label = F.when(F.col("page") > 0, F.concat(F.lit("page "), F.col("page").cast("string"), F.lit(" / "), last.cast("string"))).otherwise("")
    return groups.withColumn("label", label)


def asset_url(src: Column, prefix: str) -> Column:
    """A relative source under a prefix; absolute ones stay."""
    return F.when(src.rlike("^(https?://|/|data:)"), src).otherwise(F.concat(F.lit(prefix.rstrip("/") + "/"), F.substring_index(src, "/", -1)))


def furniture_class(kind: Column, band: Column, rule: Column, shade: Column) -> Column:
    """Class names by band, rule and shade."""
    return F.concat_ws(
        " ",
        F.when(kind == "deco", "deco"),
        F.when((kind == "deco") & band.isin("top", "bottom"), F.concat(F.lit("deco-"), band)),
        F.when((kind != "deco") & kind.isin("p", "refs", "ref") & band.isin("top", "bottom"), F.concat(F.lit("pg-band pg-"), band)),
        F.when((kind != "deco") & rule.isin("above", "below"), F.concat(F.lit("pg-rule-"), rule)),
        F.when((kind != "deco") & shade.rlike("^#[0-9a-fA-F]{6}$"), "pg-shade"),
    )


def reader_stats(blocks: DataFrame) -> DataFrame:
    """Counts that a reader shows for each paper."""
    translated = F.coalesce(F.col("zh"), F.lit("")).rlike(r"\S")
    return blocks.groupBy("paper_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(translated).alias("translated"),
        F.count_if(F.col("zh_source") == "needs_review").alias("review"),
        F.count_if(F.col("zh_source") == "human").alias("human"),
        F.count_if(F.col("type") == "figure").alias("figures"),
    )
