"""Hard-negative mining by distributed radix selection over integer scores.

Vectors become whole numbers, floor(scale * x); a score is an integer inner product. Anchors meet all rows in blocks: a
pair of a block of anchors and one of candidates is a group, and each row moves once for each block of the other kind.
An anchor's positives are the best of its label; each positive opens a window of scores for negatives of other labels.

In every window the k best scores are found without sorting them: a round counts the candidates of each group by one
digit of their distance from the window's upper end, these histograms are added up, and the running sum shows in which
bucket the kth candidate lies; the next round takes that bucket apart by the next digit. A group sends a histogram only
as far as it reaches k. In the end the kth score is known, and a group sends only rows above it and, of those at it, the
first by id that are still wanted. Scores are computed anew in each round, since they are too many to keep. Positives are
selected in the same way, in a window of all scores that the lengths of the vectors allow.

Blocks are bounded by bytes (BLOCK_BYTES), whatever the dimension, and rows are dealt to them by number, so that neither
a common label nor many copies of a vector make a large group.

Defined results: rows with a null label, a null vector, or a null or non-finite component take no part. All others are
candidates, each for itself where ids or vectors repeat; a row is no positive of its own. A null id is no anchor and
comes last among ties. Vectors of different dimension are compared over the dimensions both have. A window without rows
gives none, and fewer than k rows are all returned. Scores beyond 2**61 count as 2**61. An empty table, or no anchor,
gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import picked, ship, shuffle_partitions, written
from foliant.llm.topk import _floor, _lengths, _matrix

#: Bytes of the vectors of a block, as doubles.
BLOCK_BYTES = 32 << 20
#: Candidates of a block at least, where there are so many: each block sends histograms of its own.
LEAST_ROWS = 4096
#: Anchors whose scores against a block of candidates are held at once.
PART = 64
#: Bits of a digit, so 1024 buckets in a histogram.
DIGIT_BITS = 10
LARGEST = 1 << 61


def quantized(vectors: DataFrame, is_anchor: Column, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """(row, id, label, anchor, v, norm) of every row that takes part. is_anchor: of column id."""
    base = picked(vectors, id_col, vector_col, label_col).toDF("_id", "_x", "_label")
    base = base.select(F.col("_id").cast("long").alias("id"), F.col("_x").cast("array<double>").alias("x"), F.col("_label").cast("long").alias("label")).where("x is not null and label is not null")
    finite = base.where(~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))))
    whole = finite.select(F.monotonically_increasing_id().alias("row"), "id", "label", F.coalesce(is_anchor, F.lit(False)).alias("anchor"), F.transform("x", lambda c: _floor(c * scale).cast("double")).alias("v"))
    return whole.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)))


def scores(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """All inner products of whole-numbered doubles, exact: by doubles where these hold every partial sum, else by unbounded integers."""
    largest = float(np.abs(anchors).max(initial=0)) * float(np.abs(candidates).max(initial=0)) * max(1, anchors.shape[1])
    if largest < 2.0**53:
        return (anchors @ candidates.T).astype(np.int64)
    a, c = (np.array([[int(x) for x in row] for row in m.tolist()], dtype=object).reshape(m.shape) for m in (anchors, candidates))
    total = sum((a[:, d, None] * c[None, :, d] for d in range(a.shape[1])), np.zeros((len(a), len(c)), dtype=object))
    return np.clip(total, -LARGEST, LARGEST).astype(np.int64)


def _grouped(visit: Callable[[np.ndarray, dict, pa.Table], list[tuple]], same: bool, names: list[tuple[str, pa.DataType]]):
    """A group's work: visit(distance of each eligible candidate, its window, the places of the candidates) for each window of each anchor."""

    def run(key: tuple, anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        candidates = candidates.select(["row", "id", "label", "v"]).sort_by("id")  # null last
        width = max(int(_lengths(t.column("v")).max(initial=0)) for t in (anchors, candidates))
        left, right = _matrix(anchors.column("v"), width), _matrix(candidates.column("v"), width)
        labels, rows, ids = (candidates.column(c).to_numpy(zero_copy_only=False) for c in ("label", "row", "id"))
        own_rows, own_labels, windows = anchors.column("row").to_pylist(), anchors.column("label").to_pylist(), anchors.column("windows").to_pylist()
        out: list[tuple] = []
        for at in range(0, len(left), PART):
            part = scores(left[at : at + PART], right)
            for i, line in enumerate(part, at):
                fits = np.flatnonzero(((labels == own_labels[i]) & (rows != own_rows[i])) if same else labels != own_labels[i])
                picked_ = line[fits]
                for w in windows[i]:
                    distance = w["hi"] - picked_
                    out += [(own_rows[i], w["w"], *x) for x in visit(distance, w, fits)]
        columns = list(zip(*out, strict=True)) or [()] * len(names)
        table = {n: pa.array(c, t) for (n, t), c in zip(names, columns, strict=True)}
        if "place" in table:  # of a candidate, in the order of ids
            place = table.pop("place")
            table |= {"cand": pa.array(rows).take(place), "id": candidates.column("id").combine_chunks().take(place)}
        return pa.table(table)

    return run


def _counted(k: int):
    def visit(distance: np.ndarray, w: dict, fits: np.ndarray) -> list[tuple]:
        inside = (distance >= w["base"]) & (distance <= w["last"])
        n = np.bincount((distance[inside] - w["base"]) >> w["shift"])
        digits = np.flatnonzero(n)
        reach = int(np.searchsorted(np.cumsum(n[digits]), w["need"])) + 1
        return [(int(d), int(n[d])) for d in digits[:reach]]

    return visit


def _gathered(distance: np.ndarray, w: dict, fits: np.ndarray) -> list[tuple]:
    above = np.flatnonzero((distance >= 0) & (distance < w["base"]))
    at = np.flatnonzero(distance == w["base"])[: w["need"]] if w["exact"] else np.flatnonzero((distance >= w["base"]) & (distance <= w["last"]))
    return [(int(fits[p]), int(w["hi"] - distance[p])) for p in (*above, *at)]


class Selection:
    """Radix selections among the same rows: anchors and candidates dealt to blocks of bounded bytes."""

    def __init__(self, rows: DataFrame) -> None:
        self.rows = rows
        self.anchors = written(rows.where("anchor"), "anchors")
        size = rows.agg(F.max(F.size("v")), F.count(F.lit(1)), F.count_if("anchor"), F.max("norm")).first()
        dimension, n, n_anchors, self.longest = size[0] or 1, size[1], size[2], size[3] or 0.0
        held = max(1, BLOCK_BYTES // (8 * dimension))
        self.n_a = max(1, -(-n_anchors // held))
        wanted = min(-(-shuffle_partitions(rows.sparkSession) // self.n_a), -(-n // LEAST_ROWS))
        self.n_c = max(1, -(-n // held), wanted)

    def _met(self, windows: DataFrame, visit, same: bool, schema: str, names: list[tuple[str, pa.DataType]]) -> DataFrame:
        part = lambda n: F.pmod(F.xxhash64("row"), F.lit(n))
        each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
        of = windows.groupBy("row").agg(F.collect_list(F.struct(*[c for c in windows.columns if c != "row"])).alias("windows"))
        left = self.anchors.join(of, "row").select("row", "label", "v", "windows", part(self.n_a).alias("ab"), each(self.n_c).alias("cb"))
        right = self.rows.select("row", "id", "label", "v", each(self.n_a).alias("ab"), part(self.n_c).alias("cb"))
        return left.groupBy("ab", "cb").cogroup(right.groupBy("ab", "cb")).applyInArrow(_grouped(visit, same, names), schema)

    def best(self, windows: DataFrame, k: int, same: bool) -> DataFrame:
        """(row, w, rank, cand, id, score): the k best candidates of each window (row, w, lo, hi) of an anchor, of its label or of others."""
        whole = windows.where("lo <= hi")
        state = written(whole.select("row", "w", "hi", F.lit(0).cast("long").alias("base"), (F.col("hi") - F.col("lo")).alias("last"), F.lit(k).alias("need"), F.lit(True).alias("exact")), "windows")
        widest = state.agg(F.max("last")).first()[0] or 0
        for shift in range((max(1, widest.bit_length()) - 1) // DIGIT_BITS * DIGIT_BITS, -1, -DIGIT_BITS):
            state = written(self._refined(state, k, same, shift), "windows")
        names = [("row", pa.int64()), ("w", pa.int32()), ("place", pa.int64()), ("score", pa.int64())]
        found = self._met(state, _gathered, same, "row long, w int, score long, cand long, id long", names)
        rank = F.row_number().over(Window.partitionBy("row", "w").orderBy(F.desc("score"), F.asc_nulls_last("id"), "cand"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    def _refined(self, state: DataFrame, k: int, same: bool, shift: int) -> DataFrame:
        """Windows narrowed to the bucket, by the digit at shift, that holds their kth candidate; one with too few candidates stays as it is, and isn't exact."""
        open_ = state.where("exact").withColumn("shift", F.lit(shift))
        names = [("row", pa.int64()), ("w", pa.int32()), ("digit", pa.int64()), ("n", pa.int64())]
        counts = self._met(open_, _counted(k), same, "row long, w int, digit long, n long", names).groupBy("row", "w", "digit").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("row", "w").orderBy("digit"))
        sums = counts.join(open_.select("row", "w", "need"), ["row", "w"]).withColumn("upto", upto)
        held = sums.where("upto >= need and upto - n < need").select("row", "w", "digit", (F.col("upto") - F.col("n")).alias("passed"))
        both = state.join(held, ["row", "w"], "left")
        found, start = F.col("digit").isNotNull(), F.col("base") + F.shiftleft("digit", shift)
        last = F.when(found, F.least("last", start + ((1 << shift) - 1))).otherwise(F.col("last"))
        return both.select("row", "w", "hi", F.when(found, start).otherwise(F.col("base")).alias("base"), last.alias("last"), (F.col("need") - F.coalesce("passed", F.lit(0))).cast("int").alias("need"), (F.col("exact") & found).alias("exact"))


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, k: int = 10, low: int = 30, high: int = 90, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and positive the k best rows of other labels whose score is low to high percent of the positive's."""
    ship(vectors.sparkSession)
    rows = written(quantized(vectors, is_anchor, id_col, vector_col, label_col, scale), "vectors")
    chosen = Selection(rows)
    bound = F.least(F.ceil(F.col("norm") * F.lit(chosen.longest) * (1 + 1e-9)) + 1, F.lit(LARGEST)).cast("long")
    whole = chosen.anchors.select("row", F.lit(0).alias("w"), (-bound).alias("lo"), bound.alias("hi"))
    best = written(chosen.best(whole, positives, True), "positives")
    pairs = best.select("row", (F.col("rank") - 1).cast("int").alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    share = lambda p: F.col("positive_score").cast("decimal(20,0)") * F.lit(p).cast("decimal(5,0)") / F.lit(100).cast("decimal(3,0)")
    windows = pairs.select("row", "w", F.ceil(share(low)).cast("long").alias("lo"), F.floor(share(high)).cast("long").alias("hi"))
    found = chosen.best(windows, k, False).select("row", "w", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = found.join(pairs, ["row", "w"]).join(chosen.anchors.select("row", F.col("id").alias("anchor_id")), "row")
    return named.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def query(spark, sf_dir: str) -> DataFrame:
    from foliant.llm.common import table

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label")), F.expr("id % 100 = 0"))


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.r AS a, a.vec_id AS anchor_id, c.r AS c, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.r <> c.r
), p AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, c) AS w FROM s WHERE same),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.w ORDER BY s.score DESC, s.vec_id, s.c) AS INTEGER) AS rank, s.vec_id AS negative_id,
    p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON p.a = s.a AND p.w <= 5 AND NOT s.same AND 100 * s.score BETWEEN 30 * p.score AND 90 * p.score
)
SELECT * FROM n WHERE rank <= 10
"""
