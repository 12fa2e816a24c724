"""A training corpus in five stages: quality, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; run() writes each result to the
shared scratch folder and reads it back as the next one's docs. All stages but the last return the columns of documents,
in order and under their names, further columns and names that differ in case alone included.

Defined results of every stage: an empty table gives an empty table; a null text counts as an empty one; rows are
judged one by one, so rows with a null id are kept or dropped by their text alone, and rows that repeat get equal
decisions, but where a stage is there to drop copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import decontam, line_dedup, minhash, packing, quality
from foliant.llm.common import numbered, picked, table, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. It is fitted on labels.quality outside the held-out fold.

    Null and empty texts have a score as any other; without labels of both kinds all rows get the share of label 1.
    """
    return quality.accepted(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that a document of a smaller id has; n_chars follows the text.

    A null text becomes an empty one. A null id comes after every other. Rows that share an id keep the same lines.
    """
    done = numbered(line_dedup.dedup_lines(docs))
    kept = F.col(f"c{len(docs.columns)}")
    new = {"text": kept, "n_chars": F.length(kept).cast("long")}
    return done.select(*[new.get(c, F.col(f"c{i}")).alias(f"c{i}") for i, c in enumerate(docs.columns)]).toDF(*docs.columns)


def unlike_others(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates: two-word shingles as the operator's contract has them, similarity 0.8.

    Documents without words and rows with a null id are all kept. Of rows equal in id and text one stays.
    """
    found = minhash.near_duplicates(docs, shingle=2)
    own, doc_id = numbered(docs), F.col(f"c{docs.columns.index('doc_id')}")
    kept = own.join(found.where(~F.col("kept")).select("doc_id").distinct(), doc_id == F.col("doc_id"), "left_anti")
    again = picked(docs, "doc_id").where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1)
    if not again.isEmpty():  # rows that repeat an id and its text are copies too
        hashed = kept.withColumn("_hash", F.xxhash64(f"c{docs.columns.index('text')}"))
        once = hashed.where(doc_id.isNotNull()).dropDuplicates([f"c{docs.columns.index('doc_id')}", "_hash"])
        kept = once.unionByName(hashed.where(doc_id.isNull())).drop("_hash")
    return kept.toDF(*docs.columns)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark: under a twentieth of their words lies in its windows.

    Documents without words are kept; an empty benchmark drops nothing.
    """
    found = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select("doc_id", "_row").distinct()
    own, doc_id = numbered(docs), F.col(f"c{docs.columns.index('doc_id')}")
    text = F.coalesce(F.col(f"c{docs.columns.index('text')}").cast("string"), F.lit(""))
    return own.join(found, doc_id.eqNullSafe(F.col("doc_id")) & (F.xxhash64(text) == F.col("_row")), "left_anti").toDF(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of at most 4096 tokens.

    A null or empty text is one piece, the end token. Rows that repeat are packed once each.
    """
    return packing.pack(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", unique_lines),
    ("MinHash near-dedup", unlike_others),
    ("benchmark decontamination", uncontaminated),
    ("best-fit packing", packed),
]

#: SQL can't express the classifier or the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
