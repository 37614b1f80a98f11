"""Approximate nearest neighbours: probed lists, scanned by an adaptive number of dimensions.

Fit.  Centres of at most ``LISTS`` lists come from Lloyd rounds on a sample of at most ``SAMPLE`` rows (all rows, if fewer);
every row of the table is then put into the list of its nearest centre.  ``CALIBRATION`` sampled rows are searched by brute
force over all rows, and the number of lists that a query probes is the smallest that meets ``target`` of their neighbours.

Search.  Vectors of a list are turned by one random rotation, so that any block of columns is a fair sample of a distance.
A list is scanned in blocks of 16 columns: after each block a hypothesis test compares the partial distance, scaled
up to all dimensions, with the query's k-th distance so far, and pairs that are surely further are abandoned.  Pairs
that survive all columns are measured on the original vectors in double precision.  The nearest list comes first; its k-th
distance is what the tests of all other lists compare with.  A query that finds fewer than k rows in its lists
goes through the remaining ones.

Layout.  The driver holds the sample and one number per list.  Rows are dealt by (list, slice), queries follow them as copies
sorted behind the rows of the slice; a list is cut into slices of about ``SLICE`` rows, whatever its size, and a task holds one
slice and one batch of queries.

Vectors that are null or zero or hold a null or non-finite component take no part, nor do null ids.  A vector that ends
earlier counts as 0 behind its end.  A query doesn't find rows of its own id; repeated rows of other ids are found each, and
a repeated query is answered each time.  Ties go to the smaller id.  Other columns are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from widemargin.llm.common import small_batches, staged
from widemargin.llm.vectors import first_per_group, matrix, usable

SAMPLE = 16_384
LISTS = 1024
CALIBRATION = 128
SLICE = 1024
_ROUNDS = 8
_COLUMNS = 16
# width of the hypothesis test; a pair within the threshold fails it with a chance far below a thousandth
_WIDTH = 2.1
FOUND = "query long, query_id long, vec_id long, score double"


@dataclass
class Index:
    rows: DataFrame         # slot, vec_id, v, list
    centres: np.ndarray
    rotation: np.ndarray
    slices: np.ndarray      # per list
    probes: int

    @property
    def width(self) -> int:
        return self.rotation.shape[0]


def participants(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    return (vectors.where(F.col("vec_id").isNotNull() & usable("embedding"))
            .where(F.exists("embedding", lambda x: x != 0))
            .select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")))


def lloyd(sample: np.ndarray, lists: int, rounds: int = _ROUNDS) -> np.ndarray:
    """Centres of a sample; a centre that loses all its rows stays where it is."""
    rng = np.random.default_rng(0)
    centres = sample[rng.choice(len(sample), lists, replace=False)]
    for _ in range(rounds):
        own = nearest(sample, centres)
        count = np.bincount(own, minlength=lists)
        total = np.zeros_like(centres)
        np.add.at(total, own, sample)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


def _far(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances to all centres, without the rows' own length."""
    return (centres ** 2).sum(1) - 2 * (rows @ centres.T)


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([_far(rows[k:k + 4096], centres).argmin(1) for k in range(0, len(rows), 4096)] or [np.zeros(0, int)])


def lists_for(n: int) -> int:
    """About 512 rows a list; small tables get shorter lists."""
    return int(np.clip(n // 512, min(16, max(1, n // 16)), LISTS))


def fit_index(rows: DataFrame, k: int = 10, target: float = 0.96) -> Index | None:
    """Index of (vec_id, v); None for an empty table."""
    spark = rows.sparkSession
    small_batches(spark)
    numbered = staged(rows.withColumn("slot", F.monotonically_increasing_id()))
    facts = numbered.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
    n, width = facts["n"], facts["width"]
    if not n:
        return None
    some = numbered if n <= SAMPLE else numbered.sample(False, SAMPLE / n, 11).limit(2 * SAMPLE)
    sample = some.select("slot", "vec_id", "v").toArrow().combine_chunks()
    points = matrix(sample.column("v").combine_chunks(), width)
    centres = lloyd(points, min(lists_for(n), len(points)))
    rotation = np.linalg.qr(np.random.default_rng(1).standard_normal((width, width)))[0]

    def assign(batches):
        import pyarrow as pa
        for batch in batches:
            own = nearest(matrix(batch.column("v"), width), centres)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32))], [*batch.schema.names, "list"])

    kind = numbered.schema["v"].dataType.simpleString()
    listed = staged(numbered.select("slot", "vec_id", "v").mapInArrow(assign, f"slot long, vec_id long, v {kind}, list int"))
    count = np.zeros(len(centres), np.int64)
    for r in listed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect():
        count[r["list"]] = r["n"]
    index = Index(listed, centres, rotation, np.maximum(1, -(-count // SLICE)), len(centres))
    asked = np.random.default_rng(2).permutation(len(points))[:CALIBRATION]
    index.probes = _probes(index, points[asked], sample.column("vec_id").to_numpy()[asked], k, target)
    return index


def _probes(index: Index, queries: np.ndarray, ids: np.ndarray, k: int, target: float) -> int:
    """The fewest lists that meet ``target`` of the neighbours that brute force over all rows finds."""
    centres, width = index.centres, index.width
    places = _far(queries, centres).argsort(1, kind="stable").argsort(1)

    def run(batches):
        import pyarrow as pa
        kept = tuple(np.zeros(0, t) for t in (np.int64, np.float64, np.int64, np.int64))
        for batch in batches:
            x, own = matrix(batch.column("v"), width), batch.column("vec_id").to_numpy()
            far = (x ** 2).sum(1)[None] - 2 * (queries @ x.T)
            q, j = np.nonzero(own[None] != ids[:, None])
            kept = tuple(np.concatenate(p) for p in zip(kept, (q, far[q, j], own[j], places[q, batch.column("list").to_numpy()[j]])))
            at = first_per_group(kept[0], kept[1], kept[2], k=k)
            kept = tuple(p[at] for p in kept)
        yield pa.RecordBatch.from_arrays([pa.array(p) for p in kept], ["q", "far", "vec_id", "place"])

    near = Window.partitionBy("q").orderBy("far", "vec_id")
    found = (index.rows.mapInArrow(run, "q long, far double, vec_id long, place long").withColumn("rank", F.row_number().over(near))
             .where(F.col("rank") <= k).groupBy("place").agg(F.count(F.lit(1)).alias("n")).collect())
    met = np.zeros(len(centres))
    for r in found:
        met[r["place"]] = r["n"]
    if not met.sum():
        return len(centres)
    return int(np.searchsorted(np.cumsum(met) / met.sum(), target - 1e-12) + 1)


def adaptive_scan(queries, rows, limits, blocks, width):
    """Pairs (query, row) that no test abandons: rotated queries against rotated rows, ``limits`` squared per query.

    Returns (query, row, squared distance by rotated columns).
    """
    q = j = None
    far = np.zeros((len(queries), len(rows)))
    slack = 1e-12 * ((queries ** 2).sum(1) + (rows ** 2).sum(1).max(initial=0))
    for low, high in blocks:
        a, b = queries[:, low:high], rows[:, low:high]
        if q is None:
            far += (a ** 2).sum(1)[:, None] + (b ** 2).sum(1)[None] - 2 * (a @ b.T)
        else:
            far += ((a[q] - b[j]) ** 2).sum(1)
        test = 1.0 if high == width else (1 + _WIDTH / np.sqrt(high)) ** 2 * high / width
        bound = np.minimum(limits * test * (1 + 1e-9) + slack, np.finfo(float).max)
        if q is None:
            alive = far <= bound[:, None]
            far[~alive] = np.inf
            if high == blocks[-1][1] or alive.mean() < 0.1:  # few pairs: go on pair by pair
                q, j = np.nonzero(alive)
                far = far[q, j]
        else:
            alive = far <= bound[q]
            q, j, far = q[alive], j[alive], far[alive]
    return q, j, far


def best_of_slice(queries, limits, ids, rows, row_ids, rotation, k):
    """(query position, row position, distance) of at most k rows per query, within its limit."""
    width = len(rotation)
    blocks = [(low, min(width, low + _COLUMNS)) for low in range(0, width, _COLUMNS)]
    q, j, far = adaptive_scan(queries @ rotation, rows @ rotation, limits ** 2, blocks, width)
    other = row_ids[j] != ids[q]
    q, j, far = q[other], j[other], far[other]
    # rows that rounding cannot tell from the k-th stay for the exact distance
    at = first_per_group(q, far, k=k)
    edge = np.full(len(queries), -1.0)
    np.maximum.at(edge, q[at], far[at])
    stay = far <= edge[q] * (1 + 1e-8) + 1e-12 * (1 + np.einsum("ij,ij->i", queries, queries))[q]
    q, j = q[stay], j[stay]
    score = np.concatenate([np.sqrt(((queries[q[p:p + 65536]] - rows[j[p:p + 65536]]) ** 2).sum(1)) for p in range(0, len(q), 65536)] or [np.zeros(0)])
    at = first_per_group(q, score, row_ids[j], k=k)
    return q[at], j[at], score[at]


def _copies(index: Index, queries: DataFrame, first: int, last: int) -> DataFrame:
    """(list, slice, query, query_id, v, limit): each query once per slice of its lists ``first`` to ``last`` - 1 by nearness."""
    centres, slices, width = index.centres, index.slices, index.width
    kind = index.rows.schema["v"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for k in range(0, len(batch), 100):
                part = batch.slice(k, 100)
                order = _far(matrix(part.column("v"), width), centres).argsort(1, kind="stable")[:, first:last]
                lists, at = order.ravel(), np.repeat(np.arange(len(part)), order.shape[1])
                copies = slices[lists]
                part = part.take(pa.array(np.repeat(at, copies)))
                number = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(lists, copies).astype(np.int32)), pa.array(number.astype(np.int32)), *part.columns],
                                                 ["list", "slice", *part.schema.names])

    return queries.select("query", "query_id", "v", "limit").mapInArrow(
        run, f"list int, slice int, query long, query_id long, v {kind}, limit double")


def probe(index: Index, queries: DataFrame, first: int, last: int, k: int) -> DataFrame:
    """(query, query_id, vec_id, score): at most k rows per query and slice of the lists ``first`` to ``last`` - 1.

    ``queries`` is (query, query_id, v, limit); rows beyond the limit are not found.
    """
    spark, slices = index.rows.sparkSession, index.slices
    cuts = spark.createDataFrame([(i, int(s)) for i, s in enumerate(slices)], "list int, cuts int")
    # one number per list, at most LISTS
    rows = index.rows.join(F.broadcast(cuts), "list").select(
        "list", F.pmod(F.xxhash64("slot"), F.col("cuts")).cast("int").alias("slice"), F.lit(None).cast("long").alias("query"),
        F.col("vec_id").alias("query_id"), "v", F.lit(None).cast("double").alias("limit"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = (rows.unionByName(_copies(index, queries, first, last)).repartition(parts, "list", "slice")
             .sortWithinPartitions("list", "slice", F.col("query").asc_nulls_first()))
    rotation, width = index.rotation, index.width

    def run(batches):
        import pyarrow as pa
        key, vectors, names = None, [], []
        for batch in batches:
            lists, cut = batch.column("list").to_numpy(), batch.column("slice").to_numpy()
            edges = np.flatnonzero((np.diff(lists) != 0) | (np.diff(cut) != 0)) + 1
            for low, high in zip([0, *edges], [*edges, len(batch)]):
                if low == high:
                    continue
                if (lists[low], cut[low]) != key:
                    key, vectors, names = (lists[low], cut[low]), [], []
                part = batch.slice(low, high - low)
                own = part.column("query").null_count
                v, ids = matrix(part.column("v"), width), part.column("query_id").to_numpy()
                if own:
                    vectors.append(v[:own])
                    names.append(ids[:own])
                if own == len(part) or not vectors:
                    continue
                if len(vectors) > 1:
                    vectors, names = [np.concatenate(vectors)], [np.concatenate(names)]
                limits = part.column("limit").slice(own).to_numpy()
                q, j, score = best_of_slice(v[own:], limits, ids[own:], vectors[0], names[0], rotation, k)
                yield pa.RecordBatch.from_arrays([part.column("query").slice(own).take(pa.array(q)), pa.array(ids[own:][q]),
                                                  pa.array(names[0][j]), pa.array(score)], ["query", "query_id", "vec_id", "score"])

    return dealt.mapInArrow(run, FOUND)


def search(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score) of (vec_id, v, slot) rows: the k nearest rows found."""
    lists = len(index.centres)
    near = Window.partitionBy("query").orderBy("score", "vec_id")

    def ranked(found):
        return found.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k)

    def limited(found):
        """The queries with their k-th distance so far; without one, any distance will do."""
        kth = found.where(F.col("rank") == k).select("query", F.col("score").alias("limit"))
        return asked.join(kth, "query", "left").withColumn("limit", F.coalesce("limit", F.lit(float("inf"))))

    asked = queries.select(F.col("slot").alias("query"), F.col("vec_id").alias("query_id"), "v")
    found = staged(ranked(probe(index, asked.withColumn("limit", F.lit(float("inf"))), 0, 1, k)))
    if index.probes > 1:
        more = probe(index, limited(found), 1, index.probes, k)
        found = staged(ranked(found.drop("rank").unionByName(more)))
    if index.probes < lists:
        short = limited(found).where(F.col("limit") == float("inf"))
        if short.limit(1).count():
            found = ranked(found.drop("rank").unionByName(probe(index, short, index.probes, lists, k)))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest_neighbours(vectors: DataFrame, every: int = 100, k: int = 10, target: float = 0.96) -> DataFrame:
    """The k nearest rows of every row whose id is divisible by ``every``, among all rows of other ids."""
    index = fit_index(participants(vectors), k, target)
    if index is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return search(index, index.rows.where(F.col("vec_id") % every == 0), k)
