"""Exact top-k search by inner product, with multi-resolution segment statistics.

Vectors are cut into segments.  For a segment of m components with means a, b and
deviations s, t, the squared distance is at least m * ((a - b)**2 + (s - t)**2).
With the vectors' norms this lower bound on the distance is an upper bound on the
score, (|q|**2 + |v|**2 - distance**2) / 2.  Bounds come from few long segments
first, from more short ones for what is left, and exact scores are computed only
for vectors that can still reach the k-th best score found so far.

Queries are worked off in blocks of a bounded size, each against all vectors; a
task keeps the best k of its vectors per query, and these are ranked per query.

Vectors that are null or hold a null or non-finite component take no part; so do
ids that are null.  A vector that ends earlier counts as 0 behind its end.  Ties
go to the smaller id.  Rows that repeat an id count as that id's own, so they
don't answer each other.  Scores are exact below 2**53.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from widemargin.llm.common import small_batches, staged

#: Queries in one block.
BLOCK = 2048
_LEVELS = (4, 16)


def scaled(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component of the vectors that take part."""
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return (vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(~bad)
            .select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v")))


def _matrix(lists, width: int | None = None) -> np.ndarray:
    sizes = [len(x) for x in lists]
    width = max([*sizes, 1]) if width is None else width
    out = np.zeros((len(lists), width))
    for row, x in zip(out, lists):
        row[:len(x)] = x
    return out


def statistics(rows: np.ndarray, segments: int) -> np.ndarray:
    """Per segment the mean and the deviation, times the root of its length: their product bounds the inner product."""
    parts = np.array_split(rows, min(segments, rows.shape[1]), axis=1)
    return np.concatenate([np.stack([p.mean(1), p.std(1)], 1) * np.sqrt(p.shape[1]) for p in parts], axis=1)


def best(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, kept=None):
    """Adds ``rows`` to ``kept``, the (scores, ids) of the best k per query, and returns it."""
    if kept is None:
        kept = np.full((len(queries), k), -np.inf), np.full((len(queries), k), np.iinfo(np.int64).max)
    width = max(queries.shape[1], rows.shape[1])
    queries = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
    rows = np.pad(rows, ((0, 0), (0, width - rows.shape[1])))
    norm_q, norm_v = (queries ** 2).sum(1), (rows ** 2).sum(1)
    alive = np.ones((len(queries), len(rows)), bool)
    for segments in _LEVELS:
        a, b = statistics(queries, segments), statistics(rows, segments)
        distance = (a ** 2).sum(1)[:, None] + (b ** 2).sum(1)[None] - 2 * (a @ b.T)
        bound = (norm_q[:, None] + norm_v[None] - distance) / 2
        slack = 1e-9 * (norm_q[:, None] + norm_v[None]) + 1e-6
        alive &= bound + slack >= kept[0][:, -1:]
    alive &= ids[None] != query_ids[:, None]
    for q in np.flatnonzero(alive.any(1)):
        own = np.flatnonzero(alive[q])
        score = np.concatenate([kept[0][q], rows[own] @ queries[q]])
        name = np.concatenate([kept[1][q], ids[own]])
        order = np.lexsort((name, -score))[:k]
        kept[0][q], kept[1][q] = score[order], name[order]
    return kept


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ids divisible by ``every``, against all other ids."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = scaled(vectors, scale)
    queries = staged(rows.where(F.col("vec_id") % every == 0).withColumn("turn", F.xxhash64("vec_id", "v")))
    blocks = max(1, -(-queries.count() // BLOCK))
    schema, out = "query_id long, vec_id long, score long", None

    def with_queries(names, matrix):
        def run(batches):
            import pyarrow as pa
            kept = None
            for batch in batches:
                lists = batch.column("v").to_pylist()
                if lists:
                    kept = best(matrix, names, _matrix(lists), batch.column("vec_id").to_numpy(), k, kept)
            if kept is not None:
                q, j = np.nonzero(kept[0] > -np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(names[q]), pa.array(kept[1][q, j]), pa.array(kept[0][q, j].astype(np.int64))],
                                                 ["query_id", "vec_id", "score"])
        return run

    for number in range(blocks):
        own = queries.where(F.pmod("turn", F.lit(blocks)) == number).select("vec_id", "v").collect()
        if own:
            part = rows.mapInArrow(with_queries(np.array([r["vec_id"] for r in own], np.int64), _matrix([r["v"] for r in own])), schema)
            out = part if out is None else out.union(part)
    if out is None:
        out = spark.createDataFrame([], schema)
    # a few rows per query and task; equal rows of one id answer once each
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
