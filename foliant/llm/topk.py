"""Exact top-k search: exhaustive term-at-a-time accumulation of integer inner products.

A vector's components become floor(scale * x). Rows are numbered, and queries and candidates are dealt by number to
blocks of bounded size; a pair of blocks is one group: for each dimension with a weight in some query, the weighted
postings of the candidates (their nonzero components there) are added to dense score arrays, for a bounded part of the
queries at a time. Each pair of blocks yields the k best of each query by partition selection; these are merged by a
window. All candidates are scored for all queries.

A candidate moves once for each block of queries and a query once for each block of candidates. The blocks are as large
as a task's memory allows (QUERY_BLOCK and CANDIDATE_BLOCK vectors, and of long vectors only as many as BLOCK_BYTES hold
as doubles), so that few copies move. A task holds its two blocks a few times over, and PART rows of scores.

Scores are exact. Where components are so large that a sum could leave 63 bits, unbounded integers are used, and a score
outside the range of a long is set to its nearest end.

Defined results: null vectors and those with a null or non-finite component take no part. Every other row is a candidate
for every query but itself, and every row that is_query chooses is a query: rows that share an id, or repeat a vector,
count each for itself, and a null id is a candidate, named null. Vectors of another dimension than a query's are compared
over the dimensions both have. Fewer than k candidates are all returned. Ties go to the smaller id, null last. An empty
table, or no query, gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import picked, ship, shuffle_partitions, written

QUERY_BLOCK, CANDIDATE_BLOCK, BLOCK_BYTES = 16_384, 65_536, 32 << 20
#: Queries whose scores against a block of candidates are held at once.
PART = 128
#: Queries and candidates whose scores are accumulated at once, to stay in a core's cache.
TILE_Q, TILE_C = 64, 2048


def quantized(vectors: DataFrame, is_query: Column, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(row, id, query, v): every finite vector as whole numbers, under a number of its row. is_query: of column id."""
    base = picked(vectors, id_col, vector_col).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("x")).where("x is not null")
    finite = ~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    whole = F.transform("x", lambda c: F.expr("double(1)") * _floor(c * scale)).alias("v")
    return base.where(finite).select(F.monotonically_increasing_id().alias("row"), "id", F.coalesce(is_query, F.lit(False)).alias("query"), whole)


def _floor(c):
    """floor() as a double: beyond 2**53 a double is whole already."""
    return F.when(F.abs(c) >= F.lit(2.0**53), c).otherwise(F.floor(c).cast("double"))


def _lengths(column: pa.ChunkedArray) -> np.ndarray:
    return pc.list_value_length(column).to_numpy().astype(np.int64)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    out[np.arange(width) < _lengths(column)[:, None]] = pc.list_flatten(column).to_numpy()
    return out


def accumulate(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """All inner products, a term at a time. Whole-numbered doubles in; int64 out, or objects where 63 bits may not do."""
    terms = [d for d in range(queries.shape[1]) if queries[:, d].any() and candidates[:, d].any()]
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(candidates).max(initial=0)) * max(1, queries.shape[1])
    if bound >= 2.0**62:
        q, c = (np.array([[int(x) for x in row] for row in m.tolist()], dtype=object).reshape(m.shape) for m in (queries, candidates))
        total = np.zeros((len(q), len(c)), dtype=object)
        for d in terms:
            total += q[:, d, None] * c[None, :, d]
        return np.clip(total, -(2**63), 2**63 - 1).astype(np.int64)
    kind = np.int32 if bound < 2.0**31 else np.int64
    scores = np.zeros((len(queries), len(candidates)), kind)
    q, postings = queries.astype(kind), np.ascontiguousarray(candidates.T).astype(kind)
    scratch = np.empty((TILE_Q, TILE_C), kind)
    for i in range(0, len(q), TILE_Q):
        for j in range(0, len(candidates), TILE_C):
            tile = scores[i : i + TILE_Q, j : j + TILE_C]
            own = scratch[: tile.shape[0], : tile.shape[1]]
            for d in terms:
                np.multiply(q[i : i + TILE_Q, d, None], postings[d, None, j : j + TILE_C], out=own)
                tile += own
    return scores


def _best(scores: np.ndarray, own: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row of scores, the places of its k highest ones, the lowest places among ties, without place own (-1: none)."""
    n = scores.shape[1]
    cut = np.partition(scores, n - k - 1, axis=1)[:, n - k - 1] if n > k + 1 else None
    out = []
    for i, row in enumerate(scores):
        if cut is None:
            at = np.arange(n)
        else:
            at = np.concatenate([np.flatnonzero(row > cut[i]), np.flatnonzero(row == cut[i])])
        out.append(at[at != own[i]][:k] if cut is not None else at[at != own[i]])
    return out


def _select(k: int):
    def run(key: tuple, queries: pa.Table, candidates: pa.Table) -> pa.Table:
        # by id, null last, so that ties go to the smaller id
        candidates = candidates.select(["row", "id", "v"]).sort_by("id")
        rows, ids = candidates.column("row").to_numpy(), candidates.column("id").combine_chunks()
        q_rows, q_ids = queries.column("row").to_numpy(), queries.column("id").to_numpy()
        width = max(int(_lengths(t.column("v")).max(initial=0)) for t in (queries, candidates))
        weights, postings = _matrix(queries.column("v"), width), _matrix(candidates.column("v"), width)
        by_row = np.argsort(rows)
        found = np.searchsorted(rows, q_rows, sorter=by_row)
        own = by_row[np.minimum(found, len(rows) - 1)]
        own = np.where(rows[own] == q_rows, own, -1)
        out_q, out_c, out_s = [], [], []
        for at in range(0, len(q_rows), PART):
            scores = accumulate(weights[at : at + PART], postings)
            for i, best in enumerate(_best(scores, own[at : at + PART], k)):
                out_q.append(np.full(len(best), at + i)), out_c.append(best), out_s.append(scores[i, best].astype(np.int64))
        which, place, score = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (out_q, out_c, out_s))
        return pa.table({"row": pa.array(q_rows[which], pa.int64()), "query_id": pa.array(q_ids[which], pa.int64()), "vec_id": ids.take(pa.array(place, pa.int64())), "score": pa.array(score, pa.int64())})

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows that is_query, a condition on column id, chooses. Ids are longs."""
    ship(vectors.sparkSession)
    rows = written(quantized(vectors, is_query, id_col, vector_col, scale), "vectors")
    queries = rows.where("query")
    size = rows.agg(F.count_if("query"), F.count(F.lit(1)), F.max(F.size("v"))).first()
    held = lambda most: max(1, min(most, BLOCK_BYTES // (8 * max(1, size[2] or 1))))
    n_q = max(1, -(-size[0] // held(QUERY_BLOCK)))
    n_c = max(-(-size[1] // held(CANDIDATE_BLOCK)), -(-shuffle_partitions(vectors.sparkSession) // n_q))
    part = lambda n: F.pmod(F.xxhash64("row"), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = queries.select("row", "id", "v", part(n_q).alias("qb"), each(n_c).alias("cb"))
    right = rows.select("row", "id", "v", each(n_q).alias("qb"), part(n_c).alias("cb"))
    best = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(_select(k), "row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    from foliant.llm.common import table

    return top_k(table(spark, sf_dir, "embeddings"), F.expr("id % 50 = 0"))


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r AS q, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.r <> q.r
), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""
