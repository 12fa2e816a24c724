"""Multisets of words: counted in Arrow batches, or in columns sorted once and read as runs; work grows with the words and not with their pairs."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def lost(was: str, now: str) -> list[str]:
    """The words between blanks, sorted and each once, of which `now` has fewer than `was`."""
    return [] if was == now else sorted(Counter(was.split()) - Counter(now.split()))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, though a lambda inside reads it again and again."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fewer(was: Column, now: Column) -> Column:
    """The words, sorted and each once, of which `now` has fewer than `was`.

    Both lists are merged and sorted with a side on each word; a run of one word and side begins where either changes,
    and of two runs of a word the lengths are compared.
    """
    tagged = F.array_sort(F.concat(F.transform(now, lambda w: F.struct(w.alias("w"), F.lit(0).alias("side"))), F.transform(was, lambda w: F.struct(w.alias("w"), F.lit(1).alias("side")))))

    def runs(t: Column) -> Column:
        placed = F.transform(t, lambda x, i: F.struct(x["w"].alias("w"), x["side"].alias("side"), i.alias("at"), (F.get(t, i - 1) != x).alias("fresh")))
        return F.concat(F.filter(placed, lambda x: F.coalesce(x["fresh"], F.lit(True))), F.array(F.struct(F.lit(None).cast("string").alias("w"), F.lit(2).alias("side"), F.size(t).alias("at"), F.lit(True).alias("fresh"))))

    def compared(r: Column) -> Column:
        def one(x: Column, k: Column) -> Column:
            before = F.get(r, k - 1)
            other = F.when(before["w"] == x["w"], x["at"] - before["at"]).otherwise(0)
            return F.when((x["side"] == 1) & (F.get(r, k + 1)["at"] - x["at"] > other), x["w"])

        return F.filter(F.transform(r, one), lambda w: w.isNotNull())

    return bound(tagged, lambda t: bound(runs(t), compared))
