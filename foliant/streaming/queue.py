"""The conversion queue as a stream: requests claimed once, delivered first in first out, within a watermark.

Deliveries are written by batch id, so that a batch that runs again after a failure writes the same files anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_time(rows: DataFrame, column: str = "ts") -> DataFrame:
    """Watermarks need a timestamp with a time zone; the session's is UTC."""
    return rows.withColumn(column, F.col(column).cast("timestamp"))


def claims_stream(requests: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The first request for each paper within the watermark."""
    return event_time(requests).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["paper_id"])


def deliver(requests: DataFrame, path: str, checkpoint: str, runner: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Each batch in order of arrival through the runner into path; available input is drained, then the query ends."""

    def batch(df: DataFrame, batch_id: int) -> None:
        runner(df.orderBy("ts", "seq")).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Events of each kind in windows of event time; late ones count until the watermark closes a window."""
    return event_time(events).withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Events of each user in sessions that a gap ends."""
    return event_time(events).withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
