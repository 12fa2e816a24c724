"""Assets of documents: whether a cached document's files may be used again, and what a new extraction throws away."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def verified(wanted: DataFrame, recorded: DataFrame, files: DataFrame) -> DataFrame:
    """(paper_id, name, status) of the assets (paper_id, name) that documents name.

    recorded: (paper_id, folder, name, digest), where the assets of a cached document were written and their digests then;
    files: (folder, name, content), what lies there now. A folder may since belong to another paper, so an asset is
    verified only if its bytes have the digest that was recorded: else it is refused (other bytes), missing (no file) or
    unrecorded.
    """
    now = files.select("folder", "name", F.sha2("content", 256).alias("_now"))
    both = wanted.join(recorded, ["paper_id", "name"], "left").join(now, ["folder", "name"], "left")
    status = F.when(F.col("digest").isNull() | F.col("folder").isNull(), "unrecorded").when(F.col("_now").isNull(), "missing").when(F.col("_now") == F.col("digest"), "verified").otherwise("refused")
    return both.select("paper_id", "name", "folder", status.alias("status"))


def reusable(statuses: DataFrame) -> DataFrame:
    """(paper_id, usable, n, why): a cached document is used again only with all of its assets; why names the others, in order."""
    bad = F.array_sort(F.collect_list(F.when(F.col("status") != "verified", F.concat("name", F.lit(": "), "status"))))
    return statuses.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n"), bad.alias("_bad")).select("paper_id", (F.size("_bad") == 0).alias("usable"), "n", F.array_join("_bad", ", ").alias("why"))


def copies(statuses: DataFrame) -> DataFrame:
    """(paper_id, name, folder) of the files to be copied: those of reusable documents, whole sets only."""
    whole = reusable(statuses).where("usable").select("paper_id")
    return statuses.join(whole, "paper_id", "left_semi").select("paper_id", "name", "folder")


def reextracted(papers: DataFrame, cache: DataFrame, notes: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cache, notes, marks) once papers (paper_id, fingerprint) are to be extracted anew: their cached documents, by fingerprint, and their own notes and marks are gone."""
    gone = papers.select("paper_id").distinct()
    stale = papers.where("fingerprint is not null").select("fingerprint").distinct()
    return cache.join(stale, "fingerprint", "left_anti"), notes.join(gone, "paper_id", "left_anti"), marks.join(gone, "paper_id", "left_anti")
