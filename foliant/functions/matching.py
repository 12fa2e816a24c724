"""Matching that needs offsets into the original text: title spans, title replacement.

Titles are matched in column expressions: both texts are folded by one pattern, the folded title is located in the folded
entry, and its place is mapped back through the lengths of what the pattern took out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.multisets import bound
from foliant.functions.text import CJK

#: A hyphen inside a word with the blanks after it, which goes, or blanks, which become one.
SEAM = r"(?<=[\p{L}\p{N}])-\s*(?=[\p{L}\p{N}])|\s+"
#: An address in a translated title; the largest part of an entry that its title may be; how far a translation may outgrow the title.
ADDRESS = r"(?i)https?://|doi\.org|\bdoi:\s*10\.|arxiv:"
WHOLE, GROWTH, SLACK = 0.9, 2.5, 60


def _lowered(c: Column) -> Column:
    """Lower case where it keeps the length."""
    return F.when(F.length(F.lower(c)) == F.length(c), F.lower(c)).otherwise(c)


def folded(c: Column) -> Column:
    """Lower case, blanks squeezed, hyphens inside words dropped with the blanks after them."""
    return _folded(_seams(c))


def _folded(seams: Column) -> Column:
    return F.array_join(F.transform(seams, lambda x: F.concat(_lowered(x["piece"]), x["joint"])), "")


def _seams(c: Column) -> Column:
    """(piece, joint, taken): what stands between seams, what a seam becomes, and how long it was."""
    taken = F.regexp_extract_all(c, F.lit(SEAM), F.lit(0))
    joint = lambda x: F.when(x.isNull() | x.startswith("-"), F.lit("")).otherwise(F.lit(" "))
    part = lambda piece, own: F.struct(piece.alias("piece"), joint(own).alias("joint"), F.coalesce(F.length(own), F.lit(0)).alias("taken"))
    return bound(taken, lambda t: F.transform(F.split(c, SEAM, -1), lambda piece, i: bound(F.get(t, i), lambda own: part(piece, own))))


def _origin(seams: Column, at: Column) -> Column:
    """Where sign `at` of the folded text stands in the text with these seams; both from 0."""
    start = F.struct(F.lit(0).alias("folded"), F.lit(0).alias("own"), F.lit(-1).alias("found"))

    def step(a: Column, x: Column) -> Column:
        n, more = F.length(x["piece"]), F.length(x["piece"]) + F.length(x["joint"])
        here = (at >= a["folded"]) & (at < a["folded"] + more)
        found = F.when(here, a["own"] + F.least(at - a["folded"], n)).otherwise(a["found"])
        return F.struct((a["folded"] + more).alias("folded"), (a["own"] + n + x["taken"]).alias("own"), found.alias("found"))

    return F.aggregate(seams, start, step, lambda a: a["found"])


def title_span_column(entry: Column, title: Column) -> Column:
    """(start, end) of a title in an entry, folding aside; nulls where it isn't there."""

    def found(seams: Column, want: Column, place: Column) -> Column:
        there = (F.length(want) > 0) & (place > 0)
        start, end = _origin(seams, place - 1), _origin(seams, place + F.length(want) - 2) + 1
        return F.struct(F.when(there, start).cast("long").alias("start"), F.when(there, end).cast("long").alias("end"))

    # each step is computed once: the seams of the entry, the folded title, its place
    within = lambda seams, want: bound(F.position(want, _folded(seams)), lambda place: found(seams, want, place))
    wanted = F.trim(folded(F.coalesce(title, F.lit(""))))
    return bound(entry, lambda e: bound(_seams(e), lambda seams: bound(wanted, lambda want: within(seams, want))))


def title_replaced_column(entry: Column, title: Column, translation: Column) -> Column:
    """(text, refused): the entry with its title replaced, or empty with everything that speaks against it, comma-joined."""
    squeezed = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))

    def judged(flat: Column, new: Column, x: Column) -> Column:
        start, end = x["start"], x["end"]
        n = end - start
        faults = {
            "no title": start.isNull(),
            "all of the entry": n > WHOLE * F.length(flat),
            "not Chinese": ~new.rlike(CJK),
            "an address": new.rlike(ADDRESS),
            "too long": F.length(new) > GROWTH * n + SLACK,
        }
        refused = F.array_join(F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in faults.items()]), lambda k: k.isNotNull()), ", ")
        text = F.concat(F.substring(flat, F.lit(1), start.cast("int")), new, F.substring(flat, end.cast("int") + 1, F.length(flat)))
        return F.struct(F.when(refused == "", text).otherwise("").alias("text"), refused.alias("refused"))

    spanned = lambda flat, new: bound(title_span_column(flat, title), lambda x: judged(flat, new, x))
    return bound(squeezed(entry), lambda flat: bound(squeezed(translation), lambda new: spanned(flat, new)))
