"""Comparison of a marked text with its translation. Rows: (paper_id, n, id, text), n the place of a marker."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.functions.multisets import lost

KEY = "paper_id"


def missing(en: DataFrame, zh: DataFrame) -> DataFrame:
    """Ids of en that zh lacks; swapped, the extra ones."""
    return en.select(KEY, "n", "id").join(zh.select(KEY, "id").distinct(), [KEY, "id"], "left_anti")


def duplicated(zh: DataFrame) -> DataFrame:
    """Ids that occur more than once, with the place of the first repeat."""
    again = F.row_number().over(Window.partitionBy(KEY, "id").orderBy("n"))
    return zh.withColumn("again", again).where("again = 2").select(KEY, "n", "id")


def first_misorder(en: DataFrame, zh: DataFrame) -> DataFrame:
    """The id of zh at the first place where the ids that both have part; repeated ids don't count on its side."""
    place = F.row_number().over(Window.partitionBy(KEY).orderBy("n"))
    a = en.join(zh.select(KEY, "id").distinct(), [KEY, "id"], "left_semi").select(KEY, "id", place.alias("k"))
    b = zh.join(en.select(KEY, "id").distinct(), [KEY, "id"], "left_semi").join(duplicated(zh).select(KEY, "id"), [KEY, "id"], "left_anti").select(KEY, F.col("id").alias("other"), place.alias("k"))
    apart = a.join(b, [KEY, "k"]).where("id <> other")
    return apart.groupBy(KEY).agg(F.min_by("other", "k").alias("id"))


def pairs(en: DataFrame, zh: DataFrame) -> DataFrame:
    """en with the text of the last marker of its id in zh."""
    last = zh.groupBy(KEY, "id").agg(F.max_by("text", "n").alias("zh"))
    return en.join(last, [KEY, "id"])


def untranslated(en: DataFrame, zh: DataFrame) -> DataFrame:
    """Ids that must have a translation and have none: blank, or a long text without a Chinese character."""
    p = pairs(en, zh)
    empty = ~p.zh.rlike(r"\S") | ((F.length(T.squeezed(F.col("text"))) > 40) & ~F.col("zh").rlike(T.CJK))
    return p.where(T.expects_translation(F.col("text"), F.col("type")) & empty).select(KEY, "id")


def digit_mismatch(en: DataFrame, zh: DataFrame) -> DataFrame:
    """Ids with both texts whose numbers differ in kind or order."""
    digits = lambda c: F.regexp_extract_all(c, F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0))
    p = pairs(en, zh).where(F.col("zh").rlike(r"\S") & T.expects_translation(F.col("text"), F.col("type")))
    return p.where(digits(F.col("text")) != digits(F.col("zh"))).select(KEY, "id")


def by_id(en: DataFrame, zh: DataFrame) -> DataFrame:
    """(paper_id, id, own, other, sources, last): each id's places in en and in zh, its (n, text, type) in en, and its last text in zh.

    Rows are dealt by paper once; all that follows groups within that.
    """
    none = F.lit(None).cast("string")
    rows = en.select(KEY, "id", "n", "text", F.col("type").alias("type"), F.lit(True).alias("source")).unionByName(zh.select(KEY, "id", "n", "text", none.alias("type"), F.lit(False).alias("source")))
    places = lambda which: F.array_sort(F.collect_list(F.when(which, F.col("n"))))
    sources = F.collect_list(F.when(F.col("source"), F.struct("n", "text", "type")))
    last = F.max_by(F.when(~F.col("source"), F.col("text")), F.when(~F.col("source"), F.col("n")))
    return rows.repartition(KEY).groupBy(KEY, "id").agg(places(F.col("source")).alias("own"), places(~F.col("source")).alias("other"), sources.alias("sources"), last.alias("last"))


def summary(en: DataFrame, zh: DataFrame) -> DataFrame:
    """Findings of each paper, and ok: no structural one. Numbers only warn."""
    ids = by_id(en, zh)
    digits = lambda c: F.regexp_extract_all(c, F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0))
    last, paired = F.col("last"), F.size("other") > 0
    wanted = lambda x: T.expects_translation(x["text"], x["type"])
    empty = lambda x: ~last.rlike(r"\S") | ((F.length(T.squeezed(x["text"])) > 40) & ~last.rlike(T.CJK))
    those = lambda f: F.when(paired, F.size(F.filter("sources", f))).otherwise(0)
    flagged = ids.select(
        KEY, "id", "own", "other", (F.size("own") > 0).alias("listed"),
        F.when(~paired, F.size("own")).otherwise(0).alias("missing"),
        F.when(F.size("own") == 0, F.size("other")).otherwise(0).alias("extra"),
        (F.size("other") > 1).cast("int").alias("duplicated"),
        those(lambda x: wanted(x) & empty(x)).alias("untranslated"),
        those(lambda x: wanted(x) & last.rlike(r"\S") & (digits(x["text"]) != digits(last))).alias("digits"),
    )
    in_order = lambda column, which: F.array_sort(F.flatten(F.collect_list(F.when(which, F.transform(column, lambda n: F.struct(n.alias("n"), F.col("id").alias("id")))))))
    shared = (F.size("own") > 0) & (F.size("other") > 0)
    counts = [F.sum(k).cast("long").alias(k) for k in ("missing", "extra", "duplicated", "untranslated", "digits")]
    papers = flagged.groupBy(KEY).agg(*counts, F.bool_or("listed").alias("listed"), in_order("own", shared).alias("a"), in_order("other", shared & (F.size("other") == 1)).alias("b"))
    apart = F.exists(F.zip_with("a", "b", lambda x, y: x["id"] != y["id"]), lambda x: x)
    out = papers.where("listed").withColumn("misordered", F.coalesce(apart, F.lit(False)).cast("long"))
    kinds = ["missing", "extra", "duplicated", "misordered", "untranslated", "digits"]
    bad = sum((F.col(k) for k in kinds[:-1]), F.lit(0))
    return out.select(KEY, *kinds).withColumn("ok", bad == 0)


def to_retry(en: DataFrame, zh: DataFrame) -> DataFrame:
    """Ids to translate again, each once, under its first finding: missing, repeated, first in another order, untranslated.

    All findings are read off one grouping by id; rows are dealt by paper once.
    """
    ids = by_id(en, zh)
    last, own, other = F.col("last"), F.size("own"), F.size("other")
    empty = lambda x: T.expects_translation(x["text"], x["type"]) & (~last.rlike(r"\S") | ((F.length(T.squeezed(x["text"])) > 40) & ~last.rlike(T.CJK)))
    shared = (own > 0) & (other > 0)
    in_order = lambda column, which: F.array_sort(F.flatten(F.collect_list(F.when(which, F.transform(column, lambda n: F.struct(n.alias("n"), F.col("id").alias("id")))))))
    part = F.get(F.filter(F.zip_with("a", "b", lambda x, y: F.when(x["id"] != y["id"], y["id"])), lambda i: i.isNotNull()), F.lit(0))
    papers = ids.groupBy(KEY).agg(in_order("own", shared).alias("a"), in_order("other", shared & (other == 1)).alias("b")).select(KEY, part.alias("_part"))
    listed = ids.join(papers, KEY)
    rank = F.when((own > 0) & (other == 0), 0).when(other > 1, 1).when(F.col("id") == F.col("_part"), 2).when((other > 0) & F.exists("sources", empty), 3)
    return listed.select(KEY, "id", rank.alias("rank")).where("rank is not null")


#: Letters of a word whose loss counts, and of its beginning that may stand inside another; the share of all words that may be lost; the least share of the length.
CONTENT_WORD, BEGINNING, LOST_SHARE, LEAST_LENGTH = 7, 6, 0.35, 0.7


LOST = "struct<words:int,lost:array<string>,content:array<string>>"


def _lost(was: str | None, now: str | None, after: str | None) -> tuple[int | None, list[str] | None, list[str] | None]:
    if was is None or now is None:
        return (None if was is None else len(was.split())), None, None
    gone = lost(was, now)
    content = [w for w in gone if len(w) >= CONTENT_WORD]
    run = re.sub("[^a-z]+", "", after) if content else ""
    return len(was.split()), gone, [w for w in content if w[:BEGINNING] not in run]


def _all_lost(was: pd.Series, now: pd.Series, after: pd.Series) -> pd.DataFrame:
    rows = [_lost(*r) for r in zip(was, now, after, strict=True)]
    return pd.DataFrame({"words": pd.array([n for n, _, _ in rows], "Int32"), "lost": [g for _, g, _ in rows], "content": [c for _, _, c in rows]})


def lost_words(before: Column, after: Column) -> Column:
    """(words, lost, content): words outside mathematics before, those that became fewer, and those among these that are content and aren't found run together.

    Words are found by Spark and counted in Arrow batches.
    """
    return F.pandas_udf(_all_lost, LOST)(T.prose_text(before), T.prose_text(after), F.lower(T.join_hyphen_breaks(after)))


def latex_problems(before: Column, after: Column, numbers: bool = True, words: Column | None = None) -> Column:
    """What speaks against a typeset text: no mathematics, other numbers (which may also be compared for several blocks together), lost words, shrinkage.

    words: the lost words, if they are known already.
    """

    def found(x: Column) -> Column:
        faults = [
            F.when(~after.rlike(r"\\\(|\\\["), "no_math"),
            F.when(T.equation_numbers(before) != T.equation_numbers(after), "numbers") if numbers else F.lit(None).cast("string"),
            F.when((F.size(x["content"]) > 0) | ((x["words"] > 0) & (F.size(x["lost"]) > x["words"] * LOST_SHARE)), "words"),
            F.when(F.length(after) < F.length(before) * LEAST_LENGTH, "shrunk"),
        ]
        return F.array_compact(F.array(*faults))

    return found(lost_words(before, after) if words is None else words)


def numbers_moved(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, before, after) of the chunks whose equation numbers, all their blocks' (ord, before, after) in order taken together, are others."""
    held = F.array_sort(F.collect_list(F.struct("ord", "before", "after")))
    one = lambda name: T.equation_numbers(F.array_join(F.transform("held", lambda x: F.coalesce(x[name], F.lit(""))), " "))
    both = rows.groupBy(*key).agg(held.alias("held")).select(*key, one("before").alias("before"), one("after").alias("after"))
    return both.where(F.col("before") != F.col("after"))


def grid_shape(rows: Column) -> Column:
    """(rows, columns) of a grid of equal, nonempty rows; null otherwise."""
    width = F.size(F.get(rows, 0))
    return F.when((F.size(rows) > 0) & (width > 0) & F.forall(rows, lambda r: F.size(r) == width), F.struct(F.size(rows).alias("rows"), width.alias("columns")))


def table_usable(rows: Column, zh: Column, zh_text: Column) -> Column:
    """A translated grid of the same shape, with text and some cell that differs."""
    differs = F.exists(F.zip_with(F.flatten(rows), F.flatten(zh), lambda a, b: ~a.eqNullSafe(b)), lambda x: x)
    return F.coalesce(grid_shape(rows).eqNullSafe(grid_shape(zh)) & grid_shape(rows).isNotNull() & zh_text.rlike(r"\S") & differs, F.lit(False))


def fit_grid(rows: Column, n: Column, width: Column) -> Column:
    """Short rows padded to the width; null where the number of rows is another or a row is too long."""
    fits = (F.size(rows) == n) & F.forall(rows, lambda r: F.size(r) <= width)
    return F.when(fits, F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r)))))


def grid_text(rows: Column, caption: Column) -> Column:
    """Rows as lines of cells between bars, after the caption."""
    lines = F.transform(rows, lambda r: F.array_join(r, " | "))
    return F.array_join(F.concat(F.when(F.coalesce(caption, F.lit("")) != "", F.array(caption)).otherwise(F.array().cast("array<string>")), lines), "\n")
