"""Documents at rest: blocks of a paper as a partitioned table, and documents as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.session import written

BLOCK_TYPE = "array<struct<ord:bigint,id:string,type:string,en:string>>"


BUCKETS = 64


def _bucket(paper: Column, buckets: Column) -> Column:
    return F.pmod(F.xxhash64(paper.cast("long")), buckets).cast("int")


def save_blocks(blocks: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Replace the stored blocks of the papers in `blocks`, and of no others: whole bucket folders are rewritten.

    Papers share a bounded number of folders, so the table doesn't grow one folder a paper. The number is stored with the
    table, as a folder above its buckets; a table that is there keeps its own. What the folders will hold is written
    aside first: nothing is recomputed from a folder that is being replaced. Names of buckets are broadcast, never dealt by. A bucket is written by as many tasks as its
    size asks for.
    """
    spark = blocks.sparkSession
    there = _exists(spark, path)
    if there and (first := spark.read.parquet(path).select("buckets").first()) is not None:
        buckets = first.buckets
    bucketed = blocks.withColumns({"buckets": F.lit(buckets), "bucket": _bucket(F.col("paper_id"), F.lit(buckets))})
    if there:
        touched = bucketed.select("bucket").distinct()
        rest = spark.read.parquet(path).join(F.broadcast(touched), "bucket", "left_semi").join(blocks.select("paper_id").distinct(), "paper_id", "left_anti")
        bucketed = written(bucketed.unionByName(rest), "blocks")
    bucketed.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("buckets", "bucket").parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def load_blocks(spark: SparkSession, path: str, paper_id: int) -> DataFrame:
    """A paper's blocks in order; which folder they are in follows from its id and the number of buckets, so the scan is pruned."""
    own = F.col("bucket") == _bucket(F.lit(paper_id), F.col("buckets"))
    return spark.read.parquet(path).where(own & (F.col("paper_id") == paper_id)).orderBy("ord").drop("buckets", "bucket")


def load_block(spark: SparkSession, path: str, paper_id: int, block_id: str) -> DataFrame:
    """One block."""
    return load_blocks(spark, path, paper_id).where(F.col("id") == block_id)


def to_json(blocks: DataFrame) -> DataFrame:
    """(paper_id, doc): each paper as one JSON document."""
    parts = blocks.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("ord", "id", "type", "en"))).alias("blocks"))
    return parts.select("paper_id", F.to_json(F.struct("blocks")).alias("doc"))


def from_json(docs: DataFrame) -> DataFrame:
    """Blocks out of JSON documents; what doesn't parse gives none."""
    parsed = docs.select("paper_id", F.from_json("doc", f"struct<blocks:{BLOCK_TYPE}>").alias("d"))
    return parsed.select("paper_id", F.explode("d.blocks").alias("b")).select("paper_id", "b.*")


def json_or(c: Column, kind: str, default: Column) -> Column:
    """A JSON value of a type, or a default."""
    return F.coalesce(F.from_json(c, kind), default)
