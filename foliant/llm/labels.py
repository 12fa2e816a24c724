"""A bounded, documented sample of labelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import picked, written

#: Labelled rows that a classifier is fitted on at most: those of the smallest hashes of their ids.
MAX_LABELS = 12_000


def remainder(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: Column, limit: int = MAX_LABELS) -> DataFrame:
    """(_id, _text, _label) of at most `limit` labelled rows outside the held-out fold. held: of column _fold.

    Labels whose id or value is null are left out; an id labelled twice takes its smallest label, one with several texts its
    smallest text, so that `limit` bounds the rows.
    """
    given = picked(labels, "doc_id", label).select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_label")).where("_id is not null and _label in (0, 1)")
    open_ = given.withColumn("_fold", remainder(F.col("_id"), folds)).where(~held).groupBy("_id").agg(F.min("_label").alias("_label"))
    chosen = written(open_.orderBy(F.xxhash64("_id"), "_id").limit(limit), f"labels-{label}")
    texts = picked(docs, "doc_id", "text").select(F.col("doc_id").alias("_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    return texts.join(F.broadcast(chosen), "_id").groupBy("_id").agg(F.min("_text").alias("_text"), F.min("_label").alias("_label"))
