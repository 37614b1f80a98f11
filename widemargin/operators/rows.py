"""Rows packed for repeated passes: each pass is one map over cached blocks and one sum."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

BLOCK_SCHEMA = "ids binary, y binary, starts binary, ks binary, zs binary"
# dense working memory of one task
_CHUNK_BYTES = 32 << 20
# packed bytes worth a task of their own
_TASK_BYTES = 4 << 20
# partial sums up to this size are added on the driver, larger ones by a shuffle
_DRIVER_BYTES = 32 << 20


class PackedRows:
    """Cached blocks of rows; ``release`` frees the cache."""

    def __init__(self, cached: DataFrame, tasks: int):
        self._cached = cached
        self.tasks = tasks
        self.blocks = cached.coalesce(tasks)

    def release(self):
        self._cached.unpersist()


def row_cells(z: DataFrame) -> DataFrame:
    """(row_id, ks, zs) from entries (row_id, k, z): at most one entry per pool column and row."""
    cells = z.groupBy("row_id").agg(F.collect_list(F.struct("k", "z")).alias("c"))
    return cells.select("row_id", F.col("c.k").alias("ks"), F.col("c.z").alias("zs"))


def label_rows(labels: DataFrame, z: DataFrame) -> DataFrame:
    """(row_id, y, ks, zs): every labelled row, with its entries if it has any."""
    return labels.select("row_id", "y").join(row_cells(z), "row_id", "left")


def extend_rows(rows: DataFrame, z: DataFrame) -> DataFrame:
    """Append the entries of new columns; ``rows`` keeps its partitioning by row_id."""
    more = row_cells(z).withColumnsRenamed({"ks": "_ks", "zs": "_zs"})

    def both(a, b, kind):
        none = F.array().cast(kind)
        return F.concat(F.coalesce(a, none), F.coalesce(b, none))

    return rows.join(more, "row_id", "left").select(
        "row_id", "y", both("ks", "_ks", "array<int>").alias("ks"), both("zs", "_zs", "array<double>").alias("zs"))


def pack_rows(rows: DataFrame) -> PackedRows:
    """Cached blocks of rows (row_id, y, ks, zs).

    Every pass returns one partial sum per partition, so there are at most as
    many partitions as cores, and fewer for small inputs.
    """
    def to_blocks(batches):
        for batch in batches:
            if len(batch) == 0:
                continue
            ks = [np.empty(0, "int32") if v is None else np.asarray(v, "int32") for v in batch["ks"]]
            zs = [np.empty(0) if v is None else np.asarray(v, float) for v in batch["zs"]]
            starts = np.concatenate([[0], np.cumsum([len(v) for v in ks])]).astype("int64")
            yield pd.DataFrame({"ids": [batch["row_id"].to_numpy("int64").tobytes()],
                                "y": [batch["y"].to_numpy(float).tobytes()], "starts": [starts.tobytes()],
                                "ks": [np.concatenate(ks).tobytes()], "zs": [np.concatenate(zs).tobytes()]})

    cores = rows.sparkSession.sparkContext.defaultParallelism
    blocks = rows.mapInPandas(to_blocks, BLOCK_SCHEMA).persist(StorageLevel.MEMORY_AND_DISK)
    size = blocks.agg(F.sum(F.length("zs") + F.length("y"))).first()[0] or 0
    return PackedRows(blocks, int(min(cores, max(1, size // _TASK_BYTES))))


def pack_blocks(labels: DataFrame, z: DataFrame) -> PackedRows:
    """Blocks of rows (row_id, y) with their sparse entries (row_id, k, z); a row without entries scores b."""
    return pack_rows(label_rows(labels, z))


def block_chunks(block, size: int):
    """(ids, y, dense Z) pieces of one block, each within the working memory."""
    ids, y = np.frombuffer(block.ids, "int64"), np.frombuffer(block.y)
    starts, ks, zs = np.frombuffer(block.starts, "int64"), np.frombuffer(block.ks, "int32"), np.frombuffer(block.zs)
    step = max(1, _CHUNK_BYTES // (8 * max(1, size)))
    for lo in range(0, len(y), step):
        hi = min(len(y), lo + step)
        dense = np.zeros((hi - lo, size))
        part = slice(starts[lo], starts[hi])
        dense[np.repeat(np.arange(hi - lo), np.diff(starts[lo:hi + 1])), ks[part]] = zs[part]
        yield ids[lo:hi], y[lo:hi], dense


def hinge_terms(z, y, points, eps, weight=None, curvature=True):
    """Sums over rows at candidate ``points`` (m x (K+1), bias last).

    Exact and smoothed hinge sums for every point; at the first point also the
    dual mass and dual-weighted row sums per class and the curvature matrix.
    """
    slack = 1.0 - y[:, None] * (z @ points[:, :-1].T + points[:, -1])
    weight = np.ones(len(y)) if weight is None else weight
    share = np.clip(slack / eps, 0.0, 1.0)
    smooth = share * (slack - 0.5 * eps * share)
    mass = share[:, 0] * weight
    pos = y > 0
    out = [weight @ np.maximum(slack, 0.0), weight @ smooth,
           [mass[pos].sum(), mass[~pos].sum()], mass[pos] @ z[pos], mass[~pos] @ z[~pos]]
    if curvature:
        bend = (slack[:, 0] > 0) & (slack[:, 0] < eps)
        rows = np.hstack([z[bend], np.ones((bend.sum(), 1))])
        matrix = rows.T @ (rows * (weight[bend] / eps)[:, None])
        out.append(matrix[np.triu_indices(matrix.shape[0])])
    return np.concatenate([np.ravel(o) for o in out])


def split_terms(flat, n_points: int, size: int):
    """Names for the flat sums of ``hinge_terms``."""
    cuts = np.cumsum([n_points, n_points, 2, size, size])
    hinge, smooth, mass, pos, neg, bend = np.split(flat, cuts)
    matrix = None
    if len(bend):
        matrix = np.zeros((size + 1, size + 1))
        matrix[np.triu_indices(size + 1)] = bend
        matrix = matrix + np.triu(matrix, 1).T
    return {"hinge": hinge, "smooth": smooth, "mass": mass, "pos": pos, "neg": neg, "curvature": matrix}


def block_evaluator(packed: PackedRows, size: int, columns: np.ndarray | None = None):
    """A function (points, eps, next_eps) -> sums, each call one pass over the blocks.

    With ``next_eps`` the sums of the first point at that width come along as "next".
    """
    used = size if columns is None else len(columns)
    blocks, tasks = packed.blocks, packed.tasks

    def evaluate(points, eps, next_eps=None):
        points = np.atleast_2d(points)
        asked = [(points, eps)] + ([(points[:1], next_eps)] if next_eps else [])
        lengths = [2 * len(p) + 2 + 2 * used + (used + 1) * (used + 2) // 2 for p, _ in asked]
        length = sum(lengths)

        def total(batches):
            out = np.zeros(length)
            for batch in batches:
                for block in batch.itertuples(index=False):
                    for _, y, z in block_chunks(block, size):
                        z = z if columns is None else z[:, columns]
                        out += np.concatenate([hinge_terms(z, y, p, e) for p, e in asked])
            return out

        if tasks * length * 8 <= _DRIVER_BYTES:
            parts = blocks.mapInPandas(lambda it: [pd.DataFrame({"v": [total(it).tobytes()]})], "v binary").collect()
            flat = sum((np.frombuffer(r["v"]) for r in parts), np.zeros(length))
        else:
            slots = blocks.mapInPandas(
                lambda it: [pd.DataFrame({"slot": np.arange(length, dtype="int32"), "value": total(it)})],
                "slot int, value double")
            sums = slots.groupBy("slot").agg(F.sum("value").alias("value")).toPandas()
            flat = np.zeros(length)
            flat[sums["slot"].to_numpy()] = sums["value"].to_numpy()
        sums = split_terms(flat[:lengths[0]], len(points), used)
        if next_eps:
            sums["next"] = split_terms(flat[lengths[0]:], 1, used)
        return sums

    return evaluate


def block_scores(packed: PackedRows, size: int, point: np.ndarray) -> DataFrame:
    """(row_id, y, score) of the packed rows at one point."""
    def score(batches):
        for batch in batches:
            for block in batch.itertuples(index=False):
                for ids, y, z in block_chunks(block, size):
                    yield pd.DataFrame({"row_id": ids, "y": y.astype("int32"), "score": z @ point[:-1] + point[-1]})
    return packed.blocks.mapInPandas(score, "row_id long, y int, score double")
