"""Character-interval algebra of annotations: overlay, clipping, remapping through edits. Ranges are half-open code points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.functions.multisets import bound


def overlay(marks: DataFrame, keys: list[str], start: str = "start", end: str = "end", order: tuple[str, ...] = ("ts", "id"), payload: str = "color", width: int = 64) -> DataFrame:
    """What is seen once each mark, in order of arrival, has covered what lay under it.

    The keys' endpoints cut elementary segments; a segment belongs to the last mark over it; neighbouring segments of
    one mark are joined again. A segment meets only the marks that reach into its stretch of `width` places, so that a
    key with many marks is dealt among tasks, and work follows how many marks lie over one another.
    """
    stretch = lambda c: F.floor(c / F.lit(width))
    ends = marks.select(*keys, F.explode(F.array(start, end)).alias("s")).distinct()
    cut = ends.withColumn("e", F.lead("s").over(Window.partitionBy(*keys).orderBy("s"))).where("e is not null").withColumn("_at", stretch(F.col("s")))
    own = marks.where(F.col(start) < F.col(end)).select(*keys, F.col(start).alias("_a"), F.col(end).alias("_b"), F.struct(*order, payload).alias("owner"))
    own = own.withColumn("_at", F.explode(F.sequence(stretch(F.col("_a")), stretch(F.col("_b") - 1))))
    over = cut.join(own, [*keys, "_at"]).where((F.col("_a") <= F.col("s")) & (F.col("_b") >= F.col("e")))
    seen = over.groupBy(*keys, "s", "e").agg(F.max("owner").alias("owner"))
    w = Window.partitionBy(*keys).orderBy("s")
    fresh = ~(F.lag("owner").over(w).eqNullSafe(F.col("owner")) & (F.lag("e").over(w) == F.col("s")))
    runs = seen.withColumn("fresh", fresh).withColumn("run", F.sum(F.col("fresh").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return runs.groupBy(*keys, "run").agg(F.min("s").alias("start"), F.max("e").alias("end"), F.first("owner").alias("owner")).select(*keys, "start", "end", F.col(f"owner.{order[-1]}").alias(order[-1]), F.col(f"owner.{payload}").alias(payload))


def clip(marks: DataFrame, units: DataFrame, keys: list[str]) -> DataFrame:
    """The parts of marks inside each unit (u_start, u_end), relative to the unit's start."""
    hit = marks.join(units, keys).where((F.col("start") < F.col("u_end")) & (F.col("end") > F.col("u_start")))
    return hit.select(*keys, "id", "unit", (F.greatest("start", "u_start") - F.col("u_start")).alias("start"), (F.least("end", "u_end") - F.col("u_start")).alias("end"))


def units_of(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, unit, u_start, u_end, atomic) of each text's parts in order: formulas, which are atomic, and what stands between."""
    parts = T.math_units(F.col(text))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<u_start:int,u_end:int,atomic:boolean>>").alias("units"))

    def step(a: Column, x: Column) -> Column:
        end = a["at"] + F.length(x["text"])
        return F.struct(end.alias("at"), F.concat(a["units"], F.array(F.struct(a["at"].alias("u_start"), end.alias("u_end"), (x["kind"] != "text").alias("atomic")))).alias("units"))

    return texts.select(*keys, F.posexplode(F.aggregate(parts, zero, step, lambda a: a["units"])).alias("unit", "u")).select(*keys, "unit", "u.u_start", "u.u_end", "u.atomic")


def clip_atomic(marks: DataFrame, units: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, unit, start, end): the parts of marks inside each unit, in places of the text; an atomic unit goes whole to the first mark that touches it.

    Each unit meets the marks of its key; the first mark of a unit is a pre-aggregated minimum.
    """
    hit = marks.where(F.col("start") < F.col("end")).join(units, keys).where((F.col("start") < F.col("u_end")) & (F.col("end") > F.col("u_start")))
    split = hit.where(~F.col("atomic")).select(*keys, "id", "unit", F.greatest("start", "u_start").alias("start"), F.least("end", "u_end").alias("end"))
    whole = hit.where("atomic").groupBy(*keys, "unit", "u_start", "u_end").agg(F.min(F.struct("start", "id")).alias("m"))
    return split.unionByName(whole.select(*keys, F.col("m.id").alias("id"), "unit", F.col("u_start").alias("start"), F.col("u_end").alias("end")))


def exact_range(marks: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """For each wanted range the first mark that covers exactly it; null where one would have to be made."""
    held = marks.groupBy(*keys, "start", "end").agg(F.min("id").alias("mark"))
    return wanted.join(held, [*keys, "start", "end"], "left")


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix, by bisection: 31 comparisons of substrings whatever the length."""

    def measured(x: Column, y: Column) -> Column:
        zero = F.struct(F.lit(0).alias("low"), F.least(F.length(x), F.length(y)).alias("high"))

        def halve(s: Column, _: Column) -> Column:
            def cut(middle: Column) -> Column:
                same = F.substring(x, s["low"] + 1, middle - s["low"]) == F.substring(y, s["low"] + 1, middle - s["low"])
                return F.when(same, F.struct(middle.alias("low"), s["high"].alias("high"))).otherwise(F.struct(s["low"].alias("low"), (middle - 1).alias("high")))

            return F.when(s["low"] >= s["high"], s).otherwise(bound(((s["low"] + s["high"] + 1) / 2).cast("int"), cut))

        return F.aggregate(F.sequence(F.lit(1), F.lit(31)), zero, halve, lambda s: s["low"])

    return bound(a, lambda x: bound(b, lambda y: measured(x, y)))


def common_suffix(a: Column, b: Column) -> Column:
    return common_prefix(F.reverse(a), F.reverse(b))


def seams(old: Column, new: Column) -> tuple[Column, Column]:
    """What two texts share at their start, and at the end of what is left of both."""
    p = common_prefix(old, new)
    return p, common_suffix(F.substring(old, p + 1, F.length(old)), F.substring(new, p + 1, F.length(new)))


def remap(old: Column, new: Column, start: Column, end: Column, shared: tuple[Column, Column] | None = None) -> Column:
    """(s, e) of a range after an edit, or null where nothing of it is left.

    What the two texts share at both ends stays; an end of the range inside the replaced part is held to its seam. At a
    pure insertion, a start at the seam moves with the text after it and an end there doesn't. Where the text changed, a
    range that reaches beyond it is held to the new text.
    """
    if shared is None:  # the texts and what they share are computed once, not wherever the rules below name them
        both = lambda o, n: bound(F.struct(*[c.alias(k) for c, k in zip(seams(o, n), "pq", strict=True)]), lambda x: remap(o, n, start, end, (x["p"], x["q"])))
        return bound(old, lambda o: bound(new, lambda n: both(o, n)))
    p, q = shared
    a, b = F.length(old) - q, F.length(new) - q  # the replaced part is [p, a), and [p, b) in the new text
    shift = F.length(new) - F.length(old)
    s = F.when(start < p, start).when(start >= a, start + shift).otherwise(b)
    e = F.when(end <= p, end).when(end > a, end + shift).when((end == a) & (a > p), b).otherwise(p)
    low, high = F.when((start >= p) & (start < a), p).otherwise(s), F.when((end > p) & (end < a), p).otherwise(e)
    held = lambda c: F.when(old == new, c).otherwise(F.least(c, F.length(new)))
    low, high = held(low), held(high)
    whole = F.struct(low.cast("long").alias("s"), high.cast("long").alias("e"))
    return F.when((start < end) & (low < high) & ~((start >= p) & (end <= a) & (a > p) & (b == p)), whole)


def remap_blank(old: Column, new: Column, start: Column, end: Column) -> Column:
    """(s, e) of a range after an edit of white space alone, blanks at its ends left out; null otherwise.

    The n-th character that isn't blank is the same in both texts, so an end is found by counting them.
    """
    bare = lambda c: F.regexp_replace(c, r"\s", "")
    first, last = F.length(bare(F.substring(old, 1, start))), F.length(bare(F.substring(old, 1, end)))
    signs = F.split(new, "")
    kept = F.filter(F.transform(signs, lambda x, i: F.when(x.rlike(r"\S"), i)), lambda i: i.isNotNull())
    inside = (bare(old) == bare(new)) & (first < last)
    return F.when(inside, F.struct(F.get(kept, first).cast("long").alias("s"), (F.get(kept, last - 1) + 1).cast("long").alias("e")))


def ledger(anchors: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """Anchors after edits (old, new) of their blocks: moved, or dropped with their quote. Unedited blocks keep theirs."""
    measured = edits.withColumn("_p", common_prefix(F.col("old"), F.col("new")))  # once for each edit, not for each anchor
    rest = lambda c: F.substring(F.col(c), F.col("_p") + 1, F.length(c))
    measured = measured.withColumn("_q", common_suffix(rest("old"), rest("new")))
    joined = anchors.join(measured, keys, "left").withColumn("to", remap(F.col("old"), F.col("new"), F.col("start"), F.col("end"), (F.col("_p"), F.col("_q"))))
    fate = F.when(F.col("old").isNull(), "kept").when(F.col("to").isNull(), "dropped").otherwise("moved")
    at = lambda side, own: F.when(F.col("old").isNull(), F.col(own)).otherwise(F.col(f"to.{side}"))
    quote = F.when(fate == "dropped", F.substring(F.col("old"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")))
    return joined.select(*keys, "id", fate.alias("fate"), at("s", "start").alias("start"), at("e", "end").alias("end"), quote.alias("quote"))
