"""Many small models on feature blocks and row samples, trained in one job.

Each model is a set of features (model_id, feature_id) and optionally a bag of
rows.  The cells of all models are shuffled once by model; models whose cells
fit one task are solved there, the others as distributed jobs of their own.
"""

from __future__ import annotations

from collections import deque
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from widemargin.functions.skew import hot_keys, salted_join, with_slice
from widemargin.operators import features as B
from widemargin.operators.ascent import StoredMatrix
from widemargin.operators.master import MasterState
from widemargin.operators.newton import Regulariser, combination_bound, combination_set, minimise, squared_bound
from widemargin.operators.pool import POOL_SCHEMA, active_columns, normalize_columns, prune_weights, zero_column
from widemargin.operators.rows import hinge_terms, split_terms
from widemargin.operators.svm import NARROW_FEATURES, conic_svm, linear_svm
from widemargin.session import bucketed, cut_lineage

# A model is solved inside one task up to this many dense cells and features.
MAX_TASK_CELLS = 8_000_000
MAX_TASK_FEATURES = 1_500
# Models too large for a task that are fitted at the same time.
LARGE_AT_ONCE = 8

FIT_SCHEMA = ("model_id string, feature_id long, weight double, b double, xi_sum double, objective double, "
              "lower double, n_features int, status string, solver string, error_msg string")


@dataclass
class BlockFits:
    pool: DataFrame      # one column per solved model
    pool_w: DataFrame
    log: DataFrame       # model_id, status, solver, n_features, bias, xi_sum, objective, lower, gap, error_msg


def _places(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct ids, place of each id among them), in 4 bytes a place."""
    known = np.unique(ids)
    return known, np.searchsorted(known, ids).astype("int32")


def local_fit(model: str, cells: dict[str, np.ndarray], counts: tuple[int, int], norm: str, cost: float, tol: float) -> pd.DataFrame:
    """Fit one model from its cells (row_id, y, feature_id, value); ``counts`` = rows per class (+1, -1).

    Rows without a cell in the block are all equal, so they enter as one
    weighted zero row per class.
    """
    try:
        features, j = _places(cells["feature_id"])
        rows, i = _places(cells["row_id"])
        size = len(features)
        y = np.append(np.zeros(len(rows)), [1.0, -1.0])
        y[i] = cells["y"]
        z = np.zeros((len(rows) + 2, size))
        np.add.at(z, (i, j), cells["value"])
        del i, j
        cells.clear()
        weight = np.ones(len(y))
        weight[-2:] = counts[0] - (y[:-2] > 0).sum(), counts[1] - (y[:-2] < 0).sum()
        if min(weight[-2:]) < 0:
            raise ValueError("more rows than the class counts allow")

        basis = None
        if size > len(rows):
            # the model lies in the span of the rows: work in an orthonormal basis of it
            left, spread, basis = np.linalg.svd(z, full_matrices=False)
            keep = spread > 1e-10 * max(spread[0], 1e-300)
            z, basis = left[:, keep] * spread[keep], basis[keep]
        inner = z.shape[1]

        def evaluate(points, width, after=None):
            points = np.atleast_2d(points)
            return split_terms(hinge_terms(z, y, points, width, weight), len(points), inner)

        rays, eye = np.zeros(inner, bool), np.eye(inner)
        bound = squared_bound(cost) if norm == "squared" else combination_bound(eye, "libre", rays)
        found = minimise(evaluate, Regulariser(eye, kind=norm), combination_set("libre", rays), np.zeros(inner + 1),
                         cost, bound, tol, 200)
        w = found.point[:-1] if basis is None else found.point[:-1] @ basis
        keep = np.abs(w) > 0
        if not keep.any():
            features, w, keep = np.array([-1], dtype="int64"), np.zeros(1), np.ones(1, bool)
        out = pd.DataFrame({"model_id": model, "feature_id": features[keep], "weight": w[keep]})
        return out.assign(b=found.point[-1], xi_sum=found.hinge, objective=found.objective, lower=found.lower,
                          n_features=size, status="success", solver=found.status, error_msg=None)
    except Exception as error:  # a failing model becomes a row of the log
        return pd.DataFrame({"model_id": [model], "feature_id": [-1], "weight": [0.0], "b": [None], "xi_sum": [None],
                             "objective": [None], "lower": [None], "n_features": [0], "status": ["error"],
                             "solver": [None], "error_msg": [str(error)[:500]]})


def fit_blocks(matrix: DataFrame, labels: DataFrame, groups: DataFrame, bags: DataFrame | None = None,
               cost: float = 1.0, norm: str = "norm", tol: float = 1e-3, origin: str = "block",
               hot: DataFrame | None = None, max_cells: int = MAX_TASK_CELLS) -> BlockFits:
    """Train one model per feature group, all in one job.

    ``groups`` is (model_id, feature_id); ``bags`` is (model_id, row_id) when the
    models see a sample of the rows only.  ``norm`` is "norm" for the conic model
    or "squared" for the linear one.
    """
    spark = matrix.sparkSession
    sizes = groups.groupBy("model_id").agg(F.countDistinct("feature_id").alias("n_features"))
    if bags is None:
        per_class = labels.agg(F.sum((F.col("y") > 0).cast("long")).alias("n_pos"),
                               F.sum((F.col("y") <= 0).cast("long")).alias("n_neg"))
        sizes = sizes.withColumn("_one", F.lit(1)).join(F.broadcast(per_class.withColumn("_one", F.lit(1))), "_one").drop("_one")
    else:
        in_bags = bags.join(labels.select("row_id", "y"), "row_id")
        per_class = in_bags.groupBy("model_id").agg(F.sum((F.col("y") > 0).cast("long")).alias("n_pos"),
                                                    F.sum((F.col("y") <= 0).cast("long")).alias("n_neg"))
        sizes = sizes.join(per_class, "model_id")
    sizes = sizes.withColumn("large", ((F.col("n_pos") + F.col("n_neg")) * F.col("n_features") > max_cells)
                             | (F.col("n_features") > MAX_TASK_FEATURES))
    # one row per model
    known = cut_lineage(sizes)
    # labels first: a matrix that is already partitioned by row needs no shuffle for them
    cells = matrix.join(labels.select("row_id", "y"), "row_id")
    if bags is not None:
        cells = cells.join(bags.select("row_id").distinct(), "row_id", "left_semi")
    labelled = (salted_join(cells, groups, "feature_id", "row_id", hot)
                .select("model_id", "row_id", "y", "feature_id", "value"))
    if bags is not None:
        labelled = labelled.join(bags, ["model_id", "row_id"], "left_semi")
    small = known.where(~F.col("large")).select("model_id", "n_pos", "n_neg")
    # only models below the cell limit are gathered; the cogroup keeps a model without any cell
    task_input = labelled.join(F.broadcast(small.select("model_id")), "model_id", "left_semi").select(
        "model_id", "row_id", F.col("y").cast("byte").alias("y"), "feature_id", F.col("value").cast("double").alias("value"))

    schema = to_arrow_schema(StructType.fromDDL(FIT_SCHEMA))

    def fit(facts, cells):
        import pyarrow as pa
        facts = facts.to_pylist()[0]
        columns = {n: cells.column(n).to_numpy() for n in ("row_id", "y", "feature_id", "value")}
        found = local_fit(facts["model_id"], columns, (facts["n_pos"], facts["n_neg"]), norm, cost, tol)
        return pa.Table.from_pandas(found, schema=schema, preserve_index=False)

    fits = cut_lineage(small.groupBy("model_id").cogroup(task_input.groupBy("model_id")).applyInArrow(fit, FIT_SCHEMA))
    large = iter(known.where("large").select("model_id", "n_features").toLocalIterator())
    first = next(large, None)
    if first is not None:
        # the cells of all large models, stored once as the fits read them
        hot = cut_lineage(hot_keys(matrix, "feature_id") if hot is None else hot)
        theirs = labelled.join(F.broadcast(known.where("large").select("model_id")), "model_id", "left_semi").drop("y")
        stored = bucketed(with_slice(theirs, "feature_id", "row_id", hot), "feature_id", "_slice")

        @inheritable_thread_target(spark)
        def fit_one(row):
            return _fit_large(stored, hot, labels, bags, row, cost, norm, tol)
        with ThreadPoolExecutor(LARGE_AT_ONCE) as workers:
            waiting, done = deque([workers.submit(fit_one, first)]), []
            for row in large:
                if len(waiting) >= 2 * LARGE_AT_ONCE:
                    done.append(waiting.popleft().result())
                waiting.append(workers.submit(fit_one, row))
            done += [f.result() for f in waiting]
        for found in done:
            fits = fits.unionByName(found)
    heads = fits.dropDuplicates(["model_id"])
    pool = heads.where(F.col("status") == "success").select(
        F.concat(F.lit("p_"), F.col("model_id")).alias("col_id"), F.lit("point").alias("kind"),
        F.lit(origin).alias("origin"), F.lit(0).alias("born_iter"), "b")
    pool_w = fits.where((F.col("status") == "success") & (F.col("weight") != 0)).select(
        F.concat(F.lit("p_"), F.col("model_id")).alias("col_id"), "feature_id", "weight")
    # success: there is a model; solver and gap tell how far it was solved
    gap = (F.col("objective") - F.col("lower")) / F.greatest(F.lit(1.0), F.abs("objective"))
    log = heads.select("model_id", "status", "solver", "n_features", F.col("b").alias("bias"), "xi_sum", "objective", "lower",
                       gap.alias("gap"), "error_msg")
    return BlockFits(pool, pool_w, log)


def _fit_large(stored, hot, labels, bags, row, cost, norm, tol) -> DataFrame:
    """A model too large for one task: the distributed fit on its cells of ``stored``."""
    spark = stored.sparkSession
    name = row["model_id"]
    # a filter keeps the buckets
    part, rows = stored.where(F.col("model_id") == name).drop("model_id"), labels
    if bags is not None:
        rows = labels.join(bags.where(F.col("model_id") == name).select("row_id"), "row_id", "left_semi")
    try:
        if norm == "norm" and row["n_features"] <= NARROW_FEATURES:
            model = conic_svm(part.drop("_slice"), rows, cost, tol)
        else:
            held = StoredMatrix(part, rows, hot, by_feature=part)
            model = conic_svm(part, rows, cost, tol, narrow=0, stored=held) if norm == "norm" else linear_svm(part, rows, cost, tol, stored=held)
        facts = (float(model.b), float(model.sum_xi), float(model.objective), float(model.lower), int(row["n_features"]))
        weights = model.weights.where(F.col("weight") != 0)
        head = spark.createDataFrame([(-1, 0.0)], "feature_id long, weight double")
        out = weights.unionByName(head)
        status, solver, error = "success", model.status, None
    except Exception as problem:
        out = spark.createDataFrame([(-1, 0.0)], "feature_id long, weight double")
        facts, status, solver, error = (None, None, None, None, int(row["n_features"])), "error", None, str(problem)[:500]
    names = ("b", "xi_sum", "objective", "lower", "n_features")
    kinds = ("double", "double", "double", "double", "int")
    return out.select(F.lit(name).alias("model_id"), "feature_id", "weight",
                      *[F.lit(v).cast(k).alias(n) for n, v, k in zip(names, facts, kinds)],
                      F.lit(status).alias("status"), F.lit(solver).cast("string").alias("solver"), F.lit(error).cast("string").alias("error_msg"))


def block_svms_contiguous(matrix, labels, features, parts: int, **options) -> BlockFits:
    """One conic model per contiguous feature block."""
    n = features.count()
    return fit_blocks(matrix, labels, B.contiguous_blocks(features, n, parts), **options)


def random_groups(features, n_features: int, parts: int, seed, overlap: bool) -> DataFrame:
    if overlap:
        return B.overlapping_feature_groups(features, n_features, parts, max(1, n_features // parts), seed)
    return B.disjoint_feature_groups(features, n_features, parts, seed)


def block_svms_random(matrix, labels, features, parts: int, seed=0, overlap: bool = False, **options) -> BlockFits:
    """One conic model per random feature group: equal shares of a shuffle, or overlapping draws."""
    return fit_blocks(matrix, labels, random_groups(features, features.count(), parts, seed, overlap), **options)


@dataclass
class Forest:
    pool: DataFrame
    pool_w: DataFrame
    log: DataFrame
    iterations: list[dict]


def forest_pool(matrix: DataFrame, labels: DataFrame, features: DataFrame, iterations: int, parts: int,
                seed: int = 1, overlap: bool = True, sample_rows: int | None = None, norm: str = "norm",
                chunk: int | None = None, unit_length: bool = False, prune_tol: float | None = None,
                include_zero: bool = True, cost: float = 1.0, tol: float = 1e-6, gap: float = 1e-2,
                hot: DataFrame | None = None) -> Forest:
    """Pool of candidates from random blocks, filtered by one convex master per iteration.

    All iterations x parts models are one job.  ``sample_rows`` trains every
    iteration on a stratified bag of rows, while the masters see all rows.
    """
    spark = matrix.sparkSession
    n = features.count()
    groups, bags = None, None
    for i in range(iterations):
        drawn = (B.overlapping_feature_groups(features, n, parts, chunk or max(1, n // parts), i * seed) if overlap
                 else B.disjoint_feature_groups(features, n, parts, i * seed))
        drawn = drawn.withColumn("model_id", F.concat(F.lit(f"i{i}_"), F.col("model_id")))
        groups = drawn if groups is None else groups.unionByName(drawn)
    groups = cut_lineage(groups)
    if sample_rows is not None:
        bag_rows = B.stratified_row_bags(labels, [i * seed for i in range(iterations)], sample_rows)
        owners = groups.select("model_id").distinct().withColumn(
            "bag", F.regexp_extract("model_id", r"^i(\d+)_", 1).cast("int") * seed)
        bags = owners.join(bag_rows.select("bag", "row_id"), "bag").select("model_id", "row_id")
    fits = fit_blocks(matrix, labels, groups, bags, cost, norm, origin="forest", hot=hot)
    pool, pool_w = fits.pool, fits.pool_w
    if unit_length:
        pool_w = normalize_columns(pool_w)
    if prune_tol is not None:
        pool, pool_w = prune_weights(pool, pool_w, prune_tol)
    state = MasterState(matrix, labels, cost, hot)
    state.add(pool, pool_w)
    kept, log = {}, []
    for i in range(iterations):
        mine = {c["col_id"] for c in state.columns if c["col_id"].startswith(f"p_i{i}_")}
        if not mine:
            log.append({"iter": i, "status": "no_columns"})
            continue
        found = state.solve("convexo", tol=gap, only=mine)
        used = {k: v for k, v in found.coefficients.items() if k in mine and abs(v) > tol}
        kept |= used
        log.append({"iter": i, "status": found.status, "ub": found.objective, "lb": found.lower, "n_active": len(used)})
    theta = spark.createDataFrame([(k, v) for k, v in kept.items()], "col_id string, coef double")
    pool, pool_w = active_columns(*state.frames(), theta, tol)
    state.release()
    if include_zero:
        pool = zero_column(spark).unionByName(pool.select(*POOL_SCHEMA.names))
    return Forest(pool, pool_w, fits.log, log)


def forest_pool_bagged(matrix, labels, features, iterations, parts, sample_rows, **options) -> Forest:
    """forest_pool on stratified row bags."""
    return forest_pool(matrix, labels, features, iterations, parts, sample_rows=sample_rows, **options)


def forest_pool_fast(matrix, labels, features, iterations, subspaces, feature_ratio: float = 0.1,
                     sample_rows: int | None = None, prune_tol: float = 1e-5, seed: int = 42,
                     include_zero: bool = False, **options) -> Forest:
    """Squared-norm blocks on ratio-sized draws, columns at unit length and pruned before the master."""
    n = features.count()
    return forest_pool(matrix, labels, features, iterations, subspaces, seed=seed, overlap=True,
                       sample_rows=sample_rows, norm="squared", chunk=max(1, int(n * feature_ratio)),
                       unit_length=True, prune_tol=prune_tol, include_zero=include_zero, **options)
