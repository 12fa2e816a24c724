"""Streaming forms against the batch ones."""

from pyspark.sql import functions as F

from foliant.operators import stateful as ST
from foliant.sources import documents as D
from foliant.sources import views as V
from foliant.streaming import progress as P
from foliant.streaming import queue as Q

SF = "/root/testdata/sf0.001"


def stream(spark, df, path):
    df.write.parquet(str(path))
    return spark.readStream.schema(df.schema).parquet(str(path))


def drain(df, name, mode, tmp_path):
    df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.table(name)


def test_progress_stream_equals_batch(spark, tmp_path):
    log = V.progress_log(spark, SF).coalesce(1)
    want = {(r.paper_id, r.seq): r.progress for r in ST.progress(log).collect()}
    got = {(r.paper_id, r.seq): r.progress for r in drain(P.progress_stream(stream(spark, log, tmp_path / "in")), "progress", "append", tmp_path).collect()}
    assert got == want


def test_steps():
    s = (0, False, "unread")
    s = P.step(s, "scroll", 30)
    assert s == (30, False, "reading")
    assert P.step(s, "scroll", 10) == s
    assert P.step(P.step(s, "mark_read", 0), "scroll", 50) == (100, True, "read")
    assert P.step(s, "mark_unread", 0) == (0, False, "unread")


def test_claims_and_delivery(spark, tmp_path):
    requests = V.progress_log(spark, SF).select("paper_id", "ts", "seq").coalesce(1)
    claimed = drain(Q.claims_stream(stream(spark, requests, tmp_path / "in"), "400 days"), "claims", "append", tmp_path)
    assert claimed.count() == requests.select("paper_id").distinct().count()
    source = spark.readStream.schema(requests.schema).parquet(str(tmp_path / "in"))
    Q.deliver(source, str(tmp_path / "out"), str(tmp_path / "cp"), lambda df: df.withColumn("done", F.lit(True))).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == requests.count()


def test_windows(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").coalesce(1)
    n = drain(Q.tumbling(stream(spark, events, tmp_path / "in")), "tumbling", "complete", tmp_path)
    assert n.agg(F.sum("n")).first()[0] == events.count()


def test_blocks_at_rest(spark, tmp_path):
    b = V.blocks(spark, SF).where("paper_id < 20")
    path = str(tmp_path / "blocks")
    D.save_blocks(b, path)
    D.save_blocks(b.where("paper_id = 3 and ord < 2"), path)
    assert D.load_blocks(spark, path, 3).count() == 2
    assert D.load_blocks(spark, path, 4).count() == b.where("paper_id = 4").count()
    assert spark.read.parquet(path).count() == b.where("paper_id <> 3").count() + 2
