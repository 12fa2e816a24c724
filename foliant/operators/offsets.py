"""Piecewise offset maps: where the signs of a text stand after its blanks were squeezed, as a sorted array of pieces.

A piece (at, n, to) says that the n signs from `at` on now stand from `to` on. A place between pieces goes to the next
piece, a place behind the last one to its end. Offsets are code points from 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space in the sense of these maps: what regular expressions of the engine and of SQL agree on.
BLANK = "[ \\t\\n\\x0B\\f\\r]"


def squeezed(text: Column) -> Column:
    """Runs of blanks as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{BLANK}+", " "))


def squeeze_map(text: Column) -> Column:
    """The pieces of squeezed(text): its words, with the blank that follows each but the last."""
    words = F.split(text, BLANK, -1)
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("to"), F.array().cast("array<struct<at:int,n:int,to:int>>").alias("pieces"))

    def step(a: Column, word: Column) -> Column:
        n = F.length(word)
        to = a["to"] + F.when((n > 0) & (F.size(a["pieces"]) > 0), 1).otherwise(0)
        own = F.array(F.struct(a["at"].alias("at"), n.alias("n"), to.alias("to")))
        return F.struct((a["at"] + n + 1).alias("at"), F.when(n > 0, to + n).otherwise(a["to"]).alias("to"), F.when(n > 0, F.concat(a["pieces"], own)).otherwise(a["pieces"]).alias("pieces"))

    return F.aggregate(words, zero, step, lambda a: a["pieces"])


def moved(pieces: Column, place: Column) -> Column:
    """Where `place` goes; null without pieces."""
    onward = F.get(F.filter(pieces, lambda x: x["at"] + x["n"] > place), F.lit(0))
    last = F.get(pieces, F.size(pieces) - 1)
    return F.when(onward.isNull(), last["to"] + last["n"]).otherwise(onward["to"] + F.greatest(place - onward["at"], F.lit(0)))


def moved_range(pieces: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """Both ends of a range that isn't empty, by its first and last sign, held to the text."""
    last = F.get(pieces, F.size(pieces) - 1)
    return moved(pieces, start), F.least(moved(pieces, end - 1) + 1, last["to"] + last["n"])


def squeezed_place(text: Column, size: Column, place: Column) -> Column:
    """moved(squeeze_map(text), place) for a text that isn't blank, by squeezing what stands before the place; size: the length of squeezed(text)."""
    seam = F.when(F.substring(text, place + 1, F.lit(1)).rlike(BLANK), " #").otherwise("#")
    return F.least(F.length(squeezed(F.concat(F.substring(text, F.lit(1), place), seam))) - 1, size)


def squeezed_range(text: Column, size: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """moved_range() by squeezed_place()."""
    return squeezed_place(text, size, start), F.least(squeezed_place(text, size, end - 1) + 1, size)
