"""The conversion queue with retries: deliveries at their due times, from a stream with timers or from a whole log.

A request is delivered at once; each failure waits longer before the next try, up to a number of tries. The rules are one
pure step over the events of a paper in order; a retry that is due before an event is delivered before it, so that what
comes out does not depend on how a stream was cut into batches. In the stream a timer of event time delivers a retry
when nothing else comes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from foliant.session import ship

#: Tries in all; the wait after try n is 2**n seconds, at most LONGEST_WAIT.
MOST, LONGEST_WAIT = 3, 30
FRESH = ("none", 0, 0)
DELIVERY = "paper_id long, try int, due timestamp, outcome string"


def wait_ms(tries: int) -> int:
    return min(2**tries, LONGEST_WAIT) * 1000


def due_before(state: tuple[str, int, int], ms: int) -> tuple[tuple[str, int, int], list[tuple[int, int, str]]]:
    """The state once a retry due by `ms` was delivered, and that delivery as (try, due, outcome)."""
    phase, tries, due = state
    if phase == "waiting" and due <= ms:
        return ("doing", tries + 1, 0), [(tries + 1, due, "delivered")]
    return state, []


def step(state: tuple[str, int, int], event: str, ms: int, most: int = MOST) -> tuple[tuple[str, int, int], list[tuple[int, int, str]]]:
    """One event at a time in milliseconds. A request is taken unless one is in hand; a failure of what is in hand waits or ends it."""
    (phase, tries, due), out = due_before(state, ms)
    if event == "enqueue" and phase != "doing":
        return ("doing", 1, 0), [*out, (1, ms, "delivered")]
    if event == "done" and phase == "doing":
        return ("done", tries, 0), [*out, (tries, ms, "done")]
    if event == "fail" and phase == "doing":
        if tries >= most:
            return ("failed", tries, 0), [*out, (tries, ms, "failed")]
        return ("waiting", tries, ms + wait_ms(tries)), out
    return (phase, tries, due), out


def _frame(paper: int, rows: list[tuple[int, int, str]]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["try", "due", "outcome"])
    return pd.DataFrame({"paper_id": paper, "try": out["try"].astype("int32"), "due": pd.to_datetime(out["due"].astype("int64"), unit="ms", utc=True), "outcome": out["outcome"].astype("object")})


class Retries(StatefulProcessor):
    """Value state (phase, tries, due) of a paper, and a timer for its next try."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "phase string, tries int, due long")

    def _put(self, old: tuple, new: tuple) -> None:
        if old[0] == "waiting" and old != new:
            self.handle.deleteTimer(old[2])
        if new[0] == "waiting" and old != new:
            self.handle.registerTimer(new[2])
        self.state.update(new)

    def _get(self) -> tuple[str, int, int]:
        return tuple(self.state.get()) if self.state.exists() else FRESH

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        old = state = self._get()
        out: list[tuple[int, int, str]] = []
        events = pd.concat(list(rows)).sort_values(["ts", "seq"])
        for ts, event in zip(events["ts"], events["event"], strict=True):
            state, made = step(state, event, round(ts.timestamp() * 1000))
            out += made
        self._put(old, state)
        yield _frame(key[0], out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        old = self._get()
        state, out = due_before(old, expiredTimerInfo.getExpiryTimeInMs())
        if out:
            self.state.update(state)
        yield _frame(key[0], out)

    def close(self) -> None:
        pass


def deliveries_stream(log: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """(paper_id, try, due, outcome) from a streaming log (paper_id, ts, seq, event) that comes in order of ts but for `delay`.

    Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    ship(log.sparkSession)
    timed = log.select("paper_id", F.col("ts").cast("timestamp").alias("ts"), "seq", "event").withWatermark("ts", delay)
    return timed.groupBy("paper_id").transformWithStateInPandas(Retries(), DELIVERY, "Append", "EventTime")


def deliveries(log: DataFrame, until: Column | None = None, most: int = MOST) -> DataFrame:
    """The same from a whole log, as a fold in columns; retries due by `until` are delivered though no event follows, all of them if it is None."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    events = log.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct(ms.alias("ms"), "seq", "event"))).alias("events"))
    last = F.struct((F.unix_millis(until) if until is not None else F.lit(2**62)).alias("ms"), F.lit(0).cast("long").alias("seq"), F.lit("").alias("event"))
    zero = F.struct(F.lit("none").alias("phase"), F.lit(0).alias("tries"), F.lit(0).cast("long").alias("due"), F.array().cast("array<struct<try:int,ms:bigint,outcome:string>>").alias("out"))

    def made(tries: Column, at: Column, outcome: str) -> Column:
        return F.array(F.struct(tries.cast("int").alias("try"), at.alias("ms"), F.lit(outcome).alias("outcome")))

    def fold(a: Column, x: Column) -> Column:
        late = (a["phase"] == "waiting") & (a["due"] <= x["ms"])
        phase, tries = F.when(late, "doing").otherwise(a["phase"]), a["tries"] + late.cast("int")
        out = F.when(late, F.concat(a["out"], made(tries, a["due"], "delivered"))).otherwise(a["out"])
        state = lambda p, n, d, o: F.struct(F.lit(p).alias("phase") if isinstance(p, str) else p.alias("phase"), n.cast("int").alias("tries"), d.cast("long").alias("due"), o.alias("out"))
        zero_ = F.lit(0)
        wait = F.least(F.pow(F.lit(2.0), tries).cast("long"), F.lit(LONGEST_WAIT)) * 1000
        doing = phase == "doing"
        return (
            F.when((x["event"] == "enqueue") & ~doing, state("doing", F.lit(1), zero_, F.concat(out, made(F.lit(1), x["ms"], "delivered"))))
            .when((x["event"] == "done") & doing, state("done", tries, zero_, F.concat(out, made(tries, x["ms"], "done"))))
            .when((x["event"] == "fail") & doing & (tries >= most), state("failed", tries, zero_, F.concat(out, made(tries, x["ms"], "failed"))))
            .when((x["event"] == "fail") & doing, state("waiting", tries, x["ms"] + wait, out))
            .otherwise(state(phase, tries, F.when(late, 0).otherwise(a["due"]), out))
        )

    folded = events.select("paper_id", F.explode(F.aggregate(F.concat("events", F.array(last)), zero, fold, lambda a: a["out"])).alias("d"))
    return folded.select("paper_id", F.col("d.try").alias("try"), F.timestamp_millis("d.ms").alias("due"), "d.outcome")
