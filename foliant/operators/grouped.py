"""Folds over the rows of a key in Python, many keys to a batch: one exchange and one sort, no group handed over alone."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame

from foliant.session import ship


def fold_groups(df: DataFrame, keys: list[str], values: list[str], fold: Callable[[tuple, list[tuple]], list[tuple]], schema: str, order: tuple[str, ...] = ()) -> DataFrame:
    """fold(key, rows of values) for each key; only the rows of one key are held beyond a batch."""
    n = len(keys)
    names = [f.strip().split(" ")[0] for f in schema.split(",")]

    def done(rows: list[tuple]) -> pd.DataFrame:
        out = [r for key, own in groupby(rows, key=lambda r: r[:n]) for r in fold(key, [r[n:] for r in own])]
        return pd.DataFrame(out, columns=names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []  # the rows of the key that is still coming
        for batch in batches:
            rows = list(batch.astype(object).where(batch.notna(), None).itertuples(index=False, name=None))
            cut = len(rows)
            while cut and rows[cut - 1][:n] == rows[-1][:n]:
                cut -= 1
            if cut or held and rows and held[-1][:n] != rows[0][:n]:
                yield done([*held, *rows[:cut]])
                held = []
            held += rows[cut:]
        if held:
            yield done(held)

    ship(df.sparkSession)
    return df.select(*keys, *values).repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
