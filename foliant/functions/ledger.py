"""Calls of a model charged once: a ledger of answers that outlives the job that made them.

Every answered row is put into the ledger before it goes on, in files whose names follow from the keys of a slice of
rows, the try and the place in the slice; a failed task or job loses the rows but not the charge. A call's answers are
written at once if the model took a while, or if its next call fails; those of a quick model gather in one file for the
whole slice, so that files grow in number with the slices, or with the time, and not with the calls. Only a worker that
is killed outright loses the calls of its last HELD seconds. Who runs again, be it a retried task or another job, finds
the answers there and calls the model only for the rest. A read merges what was written twice: the first answer of a
row and try counts.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions.models import TextModel
from foliant.session import ship

SCHEMA = "key string, try int, answer string, tokens long, at timestamp"
ARROW = pa.schema([("key", pa.string()), ("try", pa.int32()), ("answer", pa.string()), ("tokens", pa.int64()), ("at", pa.timestamp("us", tz="UTC"))])
#: Rows that go to the model together; rows of a slice, whose answers may share a file; seconds for which answers may wait for one.
CALL_ROWS, SLICE_ROWS, HELD = 32, 4096, 0.5


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)


def _asked(model: TextModel, keys: list[str], texts: list[str], attempt: int, path: str) -> pa.Table:
    """The answers to a slice, in parts that follow each other: from a part's file if there is one, else from the model and then into it, in one move."""
    store, folder = _store(path)
    name = hashlib.sha256("\0".join([str(attempt), *keys]).encode()).hexdigest()
    done, held = [], []
    at, since = 0, time.monotonic()

    def charge() -> None:
        if held:
            done.append(pa.concat_tables(held))
            _put(store, f"{folder}/{name[:2]}", f"{name}-{at - len(done[-1])}.parquet", done[-1])
            held.clear()

    try:
        while at < len(keys):
            file = f"{folder}/{name[:2]}/{name}-{at}.parquet"
            if not held and store.get_file_info(file).type == pafs.FileType.File:
                with store.open_input_file(file) as f:
                    done.append(pq.read_table(f))
                at += len(done[-1])
                continue
            if not held:
                since = time.monotonic()
            own = keys[at : at + CALL_ROWS]
            got = model(texts[at : at + CALL_ROWS])
            now = pd.Timestamp.now(tz="UTC").floor("us")
            held.append(pa.table({"key": own, "try": [attempt] * len(own), "answer": [a for a, _ in got], "tokens": [t for _, t in got], "at": [now] * len(own)}, schema=ARROW))
            at += len(own)
            if time.monotonic() - since >= HELD:
                charge()
    finally:
        charge()
    return pa.concat_tables(done)


def _put(store: pafs.FileSystem, folder: str, name: str, table: pa.Table) -> None:
    store.create_dir(folder, recursive=True)
    with store.open_output_stream(f"{folder}/{name}.part") as f:
        pq.write_table(table, f)
    store.move(f"{folder}/{name}.part", f"{folder}/{name}")


def charges(spark: SparkSession, path: str) -> DataFrame:
    """(key, try, answer, tokens, at): each row's first answer of each try."""
    store, folder = _store(path)
    store.create_dir(folder, recursive=True)
    first = F.row_number().over(Window.partitionBy("key", "try").orderBy("at", "answer"))
    held = spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(path)
    return held.withColumn("_n", first).where("_n = 1").drop("_n")


def answered(rows: DataFrame, key: str, text: str, model: TextModel, path: str, attempt: int = 1) -> DataFrame:
    """rows with answer and tokens of a try; what the ledger at path holds isn't asked again. Keys are told apart by their text.

    Rows are grouped by key, so that those of one key share a partition, and sorted, so that a retry forms the same slices.
    """
    spark = rows.sparkSession
    ship(spark)
    known = charges(spark, path).where(F.col("try") == attempt).select(F.col("key").alias("_key"), "answer", "tokens")
    keyed = rows.withColumn("_key", F.col(key).cast("string"))
    todo = keyed.select("_key", F.coalesce(F.col(text), F.lit("")).alias("_text")).join(known, "_key", "left_anti").groupBy("_key").agg(F.min("_text").alias("_text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), SLICE_ROWS):
                part = batch.iloc[at : at + SLICE_ROWS]
                yield _asked(model, part["_key"].tolist(), part["_text"].tolist(), attempt, path).select(["key", "answer", "tokens"]).rename_columns(["_key", "answer", "tokens"]).to_pandas()

    new = todo.sortWithinPartitions("_key").mapInPandas(run, "_key string, answer string, tokens long")
    return keyed.join(known.unionByName(new), "_key", "left").drop("_key")


def spent(spark: SparkSession, path: str) -> DataFrame:
    """(try, calls, tokens) of all that was charged."""
    return charges(spark, path).groupBy("try").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("tokens"))
