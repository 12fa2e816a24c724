"""Reading progress as a stateful stream: each paper's progress, lock and first scroll, kept across batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from foliant.session import ship

OUT = "paper_id long, seq long, progress long, status string"
STATE = "progress long, locked boolean, status string"


def step(state: tuple[int, bool, str], kind: str, pct: int) -> tuple[int, bool, str]:
    """One event: a mark of read locks 100, of unread resets, an edit sets; a scroll only raises, and does nothing while locked."""
    progress, locked, status = state
    if kind == "mark_read":
        return 100, True, "read"
    if kind == "mark_unread":
        return 0, False, "unread"
    if kind == "user_edit":
        return pct, False, status if status != "read" else "reading"
    if locked:
        return state
    return max(progress, pct), False, "reading" if status == "unread" else status


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    own = state.get if state.exists else (0, False, "unread")
    rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
    out = []
    for r in rows.itertuples():
        own = step(tuple(own), r.kind, int(r.pct))
        out.append((key[0], int(r.seq), int(own[0]), own[2]))
    state.update(own)
    yield pd.DataFrame(out, columns=["paper_id", "seq", "progress", "status"])


def progress_stream(log: DataFrame) -> DataFrame:
    """(paper_id, seq, progress, status) after each event of a streaming log (paper_id, ts, seq, pct, kind)."""
    ship(log.sparkSession)
    return log.groupBy("paper_id").applyInPandasWithState(_advance, OUT, STATE, "append", "NoTimeout")
