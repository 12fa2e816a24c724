"""Line dedup: hashes range-partitioned, sorted by document and position, first occurrences streamed, compressed keep bitmaps returned.

Only DataFrame functions. A line's key is the line without white space of ASCII at its ends and with A-Z lower-cased.
A key of min_chars code points or more loses all its lines except in the smallest document that holds it.

Defined results: a null or empty text is one empty line, and nothing is dropped from it. Rows that share an id are one
document; each keeps its own bitmap. A null id sorts after every other. An empty table gives an empty table. Other
columns of the input are neither read nor needed, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import ascii_lower, numbered, renamed, shuffle_partitions, written

SPACE = " \t\n\x0b\x0c\r"
#: Keys handled apart, for each range partition. The most frequent 4N keys leave no other with over 1/4N of the lines.
HOT_PER_PARTITION = 4


def line_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """(_id, _row, pos, h1, h2) of each line whose key is long enough: 128 bits of hash instead of text."""
    lines = renamed(docs, id_col, text_col).select("_id", "_row", F.posexplode(F.split(ascii_lower(F.col("_text")), "\n", -1)).alias("pos", "line"))
    keyed = lines.select("_id", "_row", "pos", F.btrim("line", F.lit(SPACE)).alias("key")).where(F.length("key") >= min_chars)
    return keyed.select("_id", "_row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def repeats(lines: DataFrame, partitions: int) -> DataFrame:
    """(_id, _row, pos) of the lines to drop.

    The most frequent keys (a stated number, so their table may be broadcast) are settled by a pre-aggregated minimum;
    no range partition then holds over a quarter of a mean partition's lines of any one key.
    """
    hot = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("owner")).where("n > 1")
    hot = hot.orderBy(F.desc("n"), "h1", "h2").limit(HOT_PER_PARTITION * partitions).select("h1", "h2", "owner", F.lit(True).alias("hot"))
    marked = lines.join(F.broadcast(written(hot, "hot-lines")), ["h1", "h2"], "left")
    settled = marked.where(F.col("hot") & ~F.col("_id").eqNullSafe(F.col("owner")))
    streamed = Window.partitionBy("h1", "h2").orderBy(F.asc_nulls_last("_id"), "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranged = marked.where("hot is null").select("_id", "_row", "pos", "h1", "h2").repartitionByRange(partitions, "h1", "h2")
    later = ranged.withColumn("owner", F.first("_id").over(streamed)).where(~F.col("_id").eqNullSafe(F.col("owner")))
    return settled.select("_id", "_row", "pos").unionByName(later.select("_id", "_row", "pos"))


def _runs(dropped: Column) -> Column:
    """Sorted positions as run-length pairs (start, length)."""
    starts = F.filter(dropped, lambda x, i: (i == 0) | (F.get(dropped, i - 1) != x - 1))
    ends = F.filter(dropped, lambda x, i: (i == F.size(dropped) - 1) | (F.get(dropped, i + 1) != x + 1))
    return F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), (e - s + 1).alias("length")))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """(_id, _row, drop_runs, n_dropped): a run-length coded bitmap for each document that loses lines."""
    lines = written(line_table(docs, id_col, text_col, min_chars), "lines")
    dropped = repeats(lines, shuffle_partitions(docs.sparkSession)).distinct()
    grouped = dropped.groupBy("_id", "_row").agg(F.sort_array(F.collect_list("pos")).alias("p"))
    return grouped.select("_id", "_row", _runs(F.col("p")).alias("drop_runs"), F.size("p").cast("long").alias("n_dropped"))


def kept_text(lines: Column, drop_runs: Column) -> Column:
    """The lines outside the runs, joined by line feeds; time in proportion to the text if `lines` is a column."""
    last = F.struct(F.size(lines).alias("start"), F.lit(0).alias("length"))
    gaps = F.zip_with(F.concat(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("length"))), drop_runs), F.concat(drop_runs, F.array(last)), lambda a, b: F.slice(lines, a["start"] + a["length"] + 1, b["start"] - a["start"] - a["length"]))
    return F.array_join(F.flatten(gaps), "\n")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """docs with _kept (the text left), _n_lines and _n_dropped added; one row for each row given."""
    bitmaps = keep_bitmaps(docs, id_col, text_col, min_chars)
    own, doc_id = numbered(docs), F.col(f"c{docs.columns.index(id_col)}")
    text = F.coalesce(F.col(f"c{docs.columns.index(text_col)}").cast("string"), F.lit(""))
    left = own.withColumn("_hash", F.xxhash64(text))
    joined = left.join(bitmaps, doc_id.eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_row")), "left")
    joined = joined.withColumn("_lines", F.when(F.col("drop_runs").isNotNull(), F.split(text, "\n", -1)))
    kept = F.when(F.col("drop_runs").isNull(), text).otherwise(kept_text(F.col("_lines"), F.col("drop_runs")))
    n_lines = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    done = joined.select(*own.columns, kept.alias("_kept"), n_lines.alias("_n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("_n_dropped"))
    return done.toDF(*docs.columns, "_kept", "_n_lines", "_n_dropped")


def query(spark, sf_dir: str) -> DataFrame:
    from foliant.llm.common import table

    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("_kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(range(1, len(parts) + 1)) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), owners AS (SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE owner <> doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE owner IS NULL OR owner = doc_id), '')) AS kept_sha256
FROM keyed k LEFT JOIN owners o ON k.key = o.key
GROUP BY k.doc_id
"""
