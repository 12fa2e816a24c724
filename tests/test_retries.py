"""Retries of the queue: the stream equals the fold of the whole log, also when it is stopped and started again."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from foliant.streaming import retries as RT

START = datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def events(seed, n=120):
    rng = random.Random(seed)
    ts = START
    for seq in range(n):
        ts += timedelta(seconds=rng.choice((0, 1, 1, 2, 3, 9)))
        yield (rng.randrange(6), ts, seq, rng.choice(("enqueue", "fail", "fail", "fail", "done")))


def by_hand(rows, until):
    """Paper by paper, a millisecond at a time being too slow: events and due times in order."""
    out = []
    for paper in {r[0] for r in rows}:
        state = RT.FRESH
        for _, ts, _, event in sorted((r for r in rows if r[0] == paper), key=lambda r: r[1:3]):
            state, made = RT.step(state, event, round((ts - datetime(1970, 1, 1)).total_seconds() * 1000))
            out += [(paper, *m) for m in made]
        state, made = RT.due_before(state, until)
        out += [(paper, *m) for m in made]
    return sorted(out)


def flat(rows):
    return sorted((r.paper_id, r["try"], round(r.ms), r.outcome) for r in rows)


SCHEMA = "paper_id long, ts timestamp_ntz, seq long, event string"


def test_steps():
    s, out = RT.step(RT.FRESH, "enqueue", 0)
    assert s == ("doing", 1, 0) and out == [(1, 0, "delivered")]
    s, out = RT.step(s, "fail", 1000)
    assert s == ("waiting", 1, 3000) and out == []
    assert RT.step(s, "fail", 2999) == (("waiting", 1, 3000), [])
    s, out = RT.step(s, "fail", 3000)
    assert out == [(2, 3000, "delivered")] and s == ("waiting", 2, 7000)
    s, out = RT.step(s, "fail", 9000)
    assert s == ("failed", 3, 0) and out == [(3, 7000, "delivered"), (3, 9000, "failed")]
    assert RT.wait_ms(10) == 30_000 and RT.step(("waiting", 1, 9), "enqueue", 5) == (("doing", 1, 0), [(1, 5, "delivered")])


@pytest.mark.parametrize("seed", range(3))
def test_fold(spark, seed):
    rows = list(events(seed))
    log = spark.createDataFrame(rows, SCHEMA)
    got = RT.deliveries(log).select("*", F.unix_millis("due").alias("ms")).collect()
    assert flat(got) == by_hand(rows, 2**62)
    until = rows[60][1]
    early = RT.deliveries(log.where(F.col("seq") <= 60), F.lit(until).cast("timestamp")).select("*", F.unix_millis("due").alias("ms")).collect()
    assert flat(early) == by_hand(rows[:61], round((until - datetime(1970, 1, 1)).total_seconds() * 1000))


def test_stream_with_a_restart(rocks, tmp_path):
    """Four batches, the query stopped after two; a last event far off lets every timer run out."""
    rows = list(events(7, 80))
    rows.append((99, rows[-1][1] + timedelta(hours=1), 900, "enqueue"))
    parts = [rows[:25], rows[25:50], rows[50:80], rows[80:]]
    source, sink, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for k, part in enumerate(parts):
        rocks.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        if k in (1, 3):  # each run finds new files and the checkpoint of the one before
            stream = RT.deliveries_stream(rocks.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source))
            stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = rocks.read.parquet(sink).select("*", F.unix_millis("due").alias("ms")).collect()
    assert flat(got) == by_hand(rows, 2**62)
