"""Benchmark decontamination: a prefix-filtered containment join with exact verification over item-sized windows.

Only DataFrame functions. A window is `window` consecutive words of an item, or the whole of a shorter item. A window
occurs in a document only if all its words do, so for containment the necessary prefix of its words, ordered by rarity
over the whole corpus, is one word: its rarest, the anchor. Each occurrence of an anchor proposes the span that the
window would take; spans outside the document are dropped by length and position, and what is left is compared word by
word. Nothing of the corpus is broadcast. The benchmark is, behind a check of its size; beyond it, the same joins run
by shuffle.

Defined results: null and empty texts have no words, hit nothing and are not contaminated. Null item ids are left out
of the items. Items of equal text all count. Rows that are equal in id and text get equal results. An empty benchmark
hits nothing; an empty table of documents gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import BROADCAST_BYTES, ascii_lower, picked, renamed, written

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), NOT_WORD), "")


def _windows(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """(wt, len, items): each distinct window text with the items that have it."""
    items = picked(benchmark, item_col, text_col).select(F.col(f"`{item_col}`").cast("string").alias("item"), words_of(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).alias("w")).where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(window))
    cut = items.select("item", "w", length.alias("len"), F.explode(F.sequence(F.lit(1), F.size("w") - length + 1)).alias("i"))
    return cut.groupBy(F.array_join(F.slice("w", F.col("i"), F.col("len")), " ").alias("wt"), "len").agg(F.collect_set("item").alias("items"))


def occurrences(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(_id, _row, start, len, items) of every place in docs where a window of the benchmark occurs; start from 0."""
    windows = written(_windows(benchmark, item_col, item_text_col, window), "windows")
    row_bytes = F.octet_length("wt") + F.aggregate("items", F.lit(64), lambda n, item: n + F.octet_length(item) + 16)
    small = (windows.agg(F.sum(row_bytes)).first()[0] or 0) <= broadcast_bytes  # the other tables sent have a part of these rows
    sent = F.broadcast if small else (lambda df: df)

    base = renamed(docs, id_col, text_col)
    words = base.select("_id", "_row", words_of(F.col("_text")).alias("w"))
    placed = windows.select("wt", "len", F.posexplode(F.split("wt", " ")).alias("off", "word")).withColumn("key", F.xxhash64("word"))

    # rarity over all documents, of the words that the benchmark has
    vocabulary = placed.select("key").distinct()
    seen = words.select(F.explode("w").alias("word")).select(F.xxhash64("word").alias("key"))
    counts = seen.join(sent(vocabulary), "key").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    rarity = placed.join(sent(written(counts, "rarity")), "key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    prefix = rarity.groupBy("wt", "len").agg(F.min(F.struct("n", "word", "off", "key")).alias("a")).where("a.n > 0")
    anchors = written(prefix.select(F.col("a.key").alias("key"), F.col("a.off").alias("off"), "len").distinct(), "anchors")

    inside = (F.col("pos") >= F.col("off")) & (F.col("pos") - F.col("off") + F.col("len") <= F.col("n_words"))
    tokens = words.withColumn("n_words", F.size("w")).select("_id", "_row", *["w"] * small, "n_words", F.posexplode("w").alias("pos", "word")).withColumn("key", F.xxhash64("word")).drop("word")
    proposed = tokens.join(sent(anchors), "key").where(inside)
    if not small:
        whole = words.toDF("_own", "_own_row", "w")
        proposed = proposed.join(whole, F.col("_id").eqNullSafe(F.col("_own")) & (F.col("_row") == F.col("_own_row")))
    start = F.greatest(F.col("pos") - F.col("off"), F.lit(0))  # the optimizer may evaluate this before the bounds are checked
    spans = proposed.select("_id", "_row", start.alias("start"), "len", F.array_join(F.slice("w", start + 1, F.col("len")), " ").alias("wt"))
    return spans.join(sent(windows.select("wt", "items")), "wt").select("_id", "_row", "start", "len", "items")


def covered(spans: Column) -> Column:
    """How many positions a sorted array of (start, len) covers."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    return F.aggregate(spans, zero, lambda a, s: F.struct(F.greatest(a["end"], s["start"] + s["len"]).alias("end"), (a["n"] + F.greatest(F.lit(0), s["start"] + s["len"] - F.greatest(a["end"], s["start"]))).alias("n")), lambda a: a["n"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, _row, n_words, n_hit, n_items, items, contaminated) for each row of docs."""
    found = occurrences(docs, benchmark, id_col, text_col, **options)
    hits = found.groupBy("_id", "_row").agg(F.sort_array(F.collect_set(F.struct("start", "len"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    hits = hits.select(F.col("_id").alias("_hit_id"), F.col("_row").alias("_hit_row"), covered(F.col("spans")).alias("n_hit"), "items")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    counted = picked(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("_id"), F.xxhash64(text).alias("_row"), F.size(words_of(text)).cast("long").alias("n_words"))
    joined = counted.join(hits, F.col("_id").eqNullSafe(F.col("_hit_id")) & (F.col("_row") == F.col("_hit_row")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(F.col("_id").alias(id_col), "_row", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"))


def query(spark, sf_dir: str) -> DataFrame:
    from foliant.llm.common import table

    done = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return done.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS wt
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM bw
), dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS wt
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), hits AS (SELECT DISTINCT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.wt = bw.wt AND dw.n = bw.n
), hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id
), item AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN item ON d.doc_id = item.doc_id
"""
