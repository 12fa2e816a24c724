"""What the corpus operators share: scratch tables, ASCII case folding, row identity."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.session import give_back, scratch, ship, written

__all__ = ["give_back", "scratch", "ship", "written"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A table of at most so many bytes may be broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 32 << 20
#: Rows of a part of a batch of texts in Python.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shipped(df: DataFrame) -> DataFrame:
    """df, once the Python workers have this package. Spark itself bounds the bytes of a batch sent to them."""
    ship(df.sparkSession)
    return df


def slices(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches in parts of few rows: texts are long, and what is made of a part is held several times over."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    give_back()


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased and nothing else; lower() is used where a text is plain ASCII, since it is far quicker than translate()."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1 and so on: names that differ in case alone, or like ours, can't clash."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def picked(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns of exactly these names, each the first so named."""
    return numbered(df).select(*[F.col(f"c{df.columns.index(n)}").alias(n) for n in names])


def renamed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and text under names of our own, so that columns of the caller can't clash, and _row, which tells apart rows that share an id. Rows equal in both count once."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return picked(df, id_col, text_col).select(F.col(f"`{id_col}`").alias("_id"), text.alias("_text"), F.xxhash64(text).alias("_row"))
