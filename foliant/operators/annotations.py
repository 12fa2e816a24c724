"""Annotations as changing tables: checks of new marks, notes with their marks, deletion, recolouring, moves to new blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as T

PLACE = ["block_id", "lang", "start", "end"]
#: A sentence anchor: a block, e or c for its language, and the sentence's number from 0.
SENTENCE = r"^(b-[0-9]+):([ec])([0-9]+)$"


def marks_by_block(blocks: DataFrame, marks: DataFrame) -> DataFrame:
    """blocks (block_id, ...) with their marks in order of place; empty where there are none."""
    own = marks.groupBy("block_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "id", "lang", "color"))).alias("marks"))
    joined = blocks.join(own, "block_id", "left")
    return joined.withColumn("marks", F.coalesce("marks", F.array().cast(joined.schema["marks"].dataType)))


def in_order(marks: DataFrame) -> DataFrame:
    """marks with their place in their block."""
    return marks.withColumn("place", F.row_number().over(Window.partitionBy("block_id").orderBy("start", "id")).cast("long"))


def refusal(color: Column, start: Column, end: Column, pens: list[str]) -> Column:
    """Why a mark can't be made: an empty range, or none of the pens; null if it can."""
    return F.when(F.coalesce(end <= start, F.lit(True)), "empty range").when(~F.coalesce(color.isin(pens), F.lit(False)), "no such pen")


def with_marks(notes: DataFrame, marks: DataFrame) -> DataFrame:
    """(id, hl_id, maker) of notes: a note on a range takes the first mark that covers exactly it.

    Where there is none, maker is the first note on that range, whose mark is to be made for all of them. Notes that have a
    mark, or stand on no range, stay as they are.
    """
    held = marks.groupBy(*PLACE).agg(F.min("id").alias("held"))
    ranged = F.col("hl_id").isNull() & F.col("block_id").isNotNull() & F.col("lang").isin("en", "zh") & (F.col("end") > F.col("start"))
    wanting = notes.where(ranged)
    first = wanting.groupBy(*PLACE).agg(F.min("id").alias("first")).join(held, PLACE, "left")
    placed = wanting.select("id", *PLACE).join(first, PLACE).select("id", "held", F.when(F.col("held").isNull(), F.col("first")).alias("maker"))
    return notes.select("id", "hl_id").join(placed, "id", "left").select("id", F.coalesce("hl_id", "held").alias("hl_id"), "maker")


def unmarked(notes: DataFrame, gone: DataFrame) -> DataFrame:
    """notes whose marks (hl_id) are in gone (id) lose them; the notes stay."""
    lost = gone.select(F.col("id").alias("_gone")).distinct()
    return notes.join(lost, F.col("hl_id") == F.col("_gone"), "left").withColumn("hl_id", F.when(F.col("_gone").isNull(), F.col("hl_id"))).drop("_gone")


def recoloured(marks: DataFrame, changes: DataFrame, pens: list[str]) -> DataFrame:
    """marks with the color of changes (id, color) where it is one of the pens; their ranges stay. One change an id."""
    new = changes.where(F.col("color").isin(pens)).select("id", F.col("color").alias("_new"))
    return marks.join(new, "id", "left").withColumn("color", F.coalesce("_new", "color")).drop("_new")


def retranslated(anchors: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Anchors after new translations (keys, old, new): one on a changed translation is dropped, all others are kept."""
    joined = anchors.join(changes, keys, "left")
    changed = (F.col("lang") == "zh") & ~F.col("old").eqNullSafe(F.col("new"))
    return joined.select(*keys, "id", F.when(changed, "dropped").otherwise("kept").alias("fate"))


def moved_to_spans(anchors: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, new_id, start, end) of anchors (id, block_id, start, end) on blocks that were cut anew.

    spans: (block_id, new_id, from, to, base), the part [from, to) of a stream that a new block holds and where the old
    block began in it. An anchor goes where its start lies, or else to the span that starts last; one without a range
    goes with the old block's beginning. Ranges are held to the new block.
    """
    point = F.col("base") + F.coalesce("start", F.lit(0))
    inside = (F.col("from") <= point) & (point < F.col("to"))
    best = F.struct((~inside).alias("outside"), F.when(inside, F.col("from")).otherwise(-F.col("from")).alias("by"), "new_id", "from", "to", "base")
    chosen = anchors.join(spans, "block_id").groupBy("id", "start", "end").agg(F.min(best).alias("s"))
    held = lambda c: F.greatest(F.lit(0), F.least(c + F.col("s.base") - F.col("s.from"), F.col("s.to") - F.col("s.from")))
    return chosen.select("id", F.col("s.new_id").alias("new_id"), held(F.col("start")).alias("start"), held(F.col("end")).alias("end"))


def sentence_ranges(anchors: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(id, lang, start, end) of sentence anchors (keys, id, sid) over blocks (keys, block, en, zh), blanks at the ends left out.

    Anchors that resolve to nothing are left out; what is missing is their number.
    """
    part = lambda k: F.regexp_extract("sid", SENTENCE, k)
    read = anchors.where(F.col("sid").rlike(SENTENCE)).select(*keys, "id", part(1).alias("block"), F.when(part(2) == "c", "zh").otherwise("en").alias("lang"), part(3).cast("int").alias("nth"))
    text = F.when(F.col("lang") == "zh", F.col("zh")).otherwise(F.col("en"))
    parts = F.when(F.col("lang") == "zh", T.sentences(F.col("zh"), "zh")).otherwise(T.sentences(F.col("en")))
    cut = read.join(blocks, [*keys, "block"]).select("id", "lang", text.alias("text"), F.get(T.sentence_offsets(parts), F.col("nth")).alias("at"))
    own = F.substring(F.col("text"), (F.col("at.start") + 1).cast("int"), (F.col("at.end") - F.col("at.start")).cast("int"))
    lead = F.length(F.regexp_extract(own, r"^\s*", 0))
    tail = F.length(F.regexp_extract(own, r"\s*$", 0))
    ranged = cut.where("at is not null").select("id", "lang", (F.col("at.start") + lead).alias("start"), (F.col("at.end") - tail).alias("end"))
    return ranged.where("end > start")
