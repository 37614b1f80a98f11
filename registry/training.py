"""Queries: trained models and loops, reported with their proven bounds.

The optimum of these problems has no closed SQL form, so most queries report an
upper bound (the objective reached) and a lower bound recomputed from duals.
Where a result can be stated in SQL it has its own query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from registry.base import (TEXT_CTES, VECTOR_CTES, clean_vector_pool, labelled_texts, pool_theta, query, rounded,
                           text_split, vector_features, vector_labels, vector_matrix)
from registry.features import TFIDF
from widemargin.operators import (blocks as K, bounds as D, features as B, master as P, metrics as M, pool as C,
                                  pricing as R, svm as V)
from widemargin.operators.terms import fitted_tfidf
from widemargin.plans import column_generation as G
from widemargin.session import cut_lineage

COST = 1.0
# centroid weights are small against a margin of 1
SCALE = 100.0


def _report(spark, rows: list[dict]):
    return spark.createDataFrame(pd.DataFrame(rows))


def _vectors(spark, sf_dir):
    return vector_matrix(spark, sf_dir), vector_labels(spark, sf_dir)


def _texts(spark, sf_dir):
    """(matrix, labels, features): tf-idf of the training texts, written once, as the fits read it many times."""
    train = cut_lineage(text_split(spark, sf_dir).where("part = 'train'").select("row_id", "y"))
    read = labelled_texts(spark, sf_dir).join(train.select("row_id"), "row_id").select("row_id", "clean_data")
    # the texts of one id beside each other
    tokens = B.tokenize(read.repartition("row_id").sortWithinPartitions("row_id"))
    matrix, features = fitted_tfidf(tokens, train.count(), 3, 0.95)
    return cut_lineage(matrix), train, features


def scaled_pool(spark, sf_dir):
    pool, pool_w = clean_vector_pool(spark, sf_dir)
    return pool, pool_w.withColumn("weight", F.col("weight") * SCALE)


# ---------------------------------------------------------------- D1, D2
@query("linear_svm")
def _(spark, sf_dir):
    matrix, labels = _vectors(spark, sf_dir)
    m = V.linear_svm(matrix, labels, COST)
    scored = M.margins_slacks(M.predict(M.scores(labels, matrix, m.weights, m.b), zero_as=-1))
    return rounded(M.fit_summary(scored, m.weights, scored, COST).withColumns({
        "squared_objective": F.lit(m.objective), "lb": F.lit(m.lower), "gap": F.lit(m.gap), "status": F.lit(m.status)}),
        "squared_objective", "lb", "gap", "obj_val", "norm_w", "sum_xi")


@query("conic_svm")
def _(spark, sf_dir):
    matrix, labels = _vectors(spark, sf_dir)
    m = V.conic_svm(matrix, labels, COST, tol=5e-3)
    # the lower bound once more, from the tables of duals and cells
    check = V.certificate(m, matrix, COST)
    return check.select(F.lit(m.objective).alias("ub"), F.lit(m.lower).alias("lb"), "lb_conic", "feasible", "max_pi",
                        F.lit(m.gap).alias("gap"), F.lit(m.passes).alias("passes"), F.lit(m.status).alias("status"))


@query("conic_svm_wide")
def _(spark, sf_dir):
    matrix, labels, _ = _texts(spark, sf_dir)
    m = V.conic_svm(matrix, labels, COST, tol=1e-2)
    return _report(spark, [{"ub": m.objective, "lb": m.lower, "gap": m.gap, "passes": m.passes, "status": m.status}])


# ---------------------------------------------------------------- D3 to D7
@query("block_svms_contiguous")
def _(spark, sf_dir):
    matrix, labels = _vectors(spark, sf_dir)
    return K.block_svms_contiguous(matrix, labels, vector_features(spark, sf_dir), 8, tol=1e-2).log


@query("block_svms_random")
def _(spark, sf_dir):
    matrix, labels = _vectors(spark, sf_dir)
    return K.block_svms_random(matrix, labels, vector_features(spark, sf_dir), 8, seed=3, tol=1e-2).log


TEXT_BLOCKS = """nv AS (SELECT count(*) AS n FROM vocab),
blk AS (SELECT 'block_' || (((feature_id + 1) * 12 - 1) // n + 1) AS model_id, feature_id FROM vocab, nv)"""


@query("subproblem_log", f"""WITH {TEXT_CTES}, {TEXT_BLOCKS}
SELECT model_id, 'success' AS status, count(DISTINCT feature_id)::INT AS n_features
FROM blk JOIN (SELECT DISTINCT term, feature_id FROM terms JOIN vocab USING (term)) USING (feature_id) GROUP BY model_id""")
def _(spark, sf_dir):
    matrix, labels, features = _texts(spark, sf_dir)
    fits = K.block_svms_contiguous(matrix, labels, features, 12, tol=0.1)
    return fits.log.select("model_id", "status", "n_features")


def _forest_rows(spark, forest):
    weights = forest.pool_w.groupBy("col_id").agg(F.count(F.lit(1)).alias("n_weights"),
                                                  F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return rounded(forest.pool.join(weights, "col_id", "left").select(
        "col_id", "origin", F.coalesce("n_weights", F.lit(0)).alias("n_weights"), F.coalesce("norm", F.lit(0.0)).alias("norm")), "norm")


@query("forest_pool")
def _(spark, sf_dir):
    matrix, labels = _vectors(spark, sf_dir)
    return _forest_rows(spark, K.forest_pool(matrix, labels, vector_features(spark, sf_dir), 2, 6))


@query("forest_pool_bagged")
def _(spark, sf_dir):
    matrix, labels = _vectors(spark, sf_dir)
    size = labels.count() // 2
    return _forest_rows(spark, K.forest_pool_bagged(matrix, labels, vector_features(spark, sf_dir), 2, 6, size))


@query("forest_pool_fast")
def _(spark, sf_dir):
    matrix, labels = _vectors(spark, sf_dir)
    size = labels.count() // 2
    return _forest_rows(spark, K.forest_pool_fast(matrix, labels, vector_features(spark, sf_dir), 2, 6, 0.2, size))


# ---------------------------------------------------------------- D8
def _solution_row(name, s):
    return {"name": name, "ub": round(s.objective, 6), "lb": round(s.lower, 6), "gap": round(s.gap, 6),
            "norm_w": round(s.norm_w, 6), "sum_xi": round(s.sum_xi, 6), "status": s.status, "passes": s.passes}


@query("solve_master")
def _(spark, sf_dir):
    matrix, labels = _vectors(spark, sf_dir)
    state = P.MasterState(matrix, labels, COST)
    state.add(*scaled_pool(spark, sf_dir))
    rows = [_solution_row(kind, state.solve(kind, tol=5e-3)) for kind in D.COMBINATIONS]
    state.release()
    return _report(spark, rows)


@query("master_unit_rays")
def _(spark, sf_dir):
    """All unit rays of the text features, both signs, as one pool."""
    matrix, labels, features = _texts(spark, sf_dir)
    both = features.withColumn("sign", F.explode(F.array(F.lit(1), F.lit(-1))))
    s = P.solve_unit_master(matrix, labels, *C.unit_columns(both, "ray"), "conico", COST, tol=2e-2)
    facts = s.theta.agg(F.count(F.lit(1)).alias("n_columns"), F.count(F.when(F.col("coef") > 0, 1)).alias("n_active"),
                        F.min("coef").alias("min_coef")).first()
    return _report(spark, [_solution_row("conico", s) | facts.asDict()])


# one column: theta is 1 under the convex type, so only the bias is free and the best bias is a breakpoint
@query("solve_master_one_column", f"""WITH {VECTOR_CTES},
c1 AS (SELECT feature_id, weight * {SCALE} AS weight FROM pool_w WHERE col_id = 'p_c1'),
s AS (SELECT ey.row_id, y, coalesce(sum(value * weight), 0) AS s FROM ey LEFT JOIN em USING (row_id) LEFT JOIN c1 USING (feature_id) GROUP BY 1, 2),
hinge AS (SELECT cand.b, sum(greatest(0, 1 - s.y * (s.s + cand.b))) AS h FROM s, (SELECT DISTINCT y - s AS b FROM s) cand GROUP BY cand.b)
SELECT 'convexo' AS combination, round((SELECT sqrt(sum(weight * weight)) FROM c1) + min(h), 2) AS objective FROM hinge""")
def _(spark, sf_dir):
    matrix, labels = _vectors(spark, sf_dir)
    pool, pool_w = scaled_pool(spark, sf_dir)
    one = F.col("col_id") == "p_c1"
    s = P.solve_master(matrix, labels, pool.where(one), pool_w.where(one), "convexo", COST, None, ridge=0.0, tol=1e-6)
    return _report(spark, [{"combination": "convexo", "objective": round(s.objective, 2)}])


@query("master_box")
def _(spark, sf_dir):
    """All five types under a box that the plain solutions leave."""
    matrix, labels = _vectors(spark, sf_dir)
    state = P.MasterState(matrix, labels, COST)
    state.add(*scaled_pool(spark, sf_dir))
    rows = []
    for kind in D.COMBINATIONS:
        s = state.solve(kind, 1.0, tol=2e-2)
        box = D.box_check(s.weights, 1.0 + 1e-9).first()
        rows.append(_solution_row(kind, s) | {"max_abs_w": round(box["max_abs_w"], 6), "within": box["within"]})
    state.release()
    return _report(spark, rows)


@query("ridge_term")
def _(spark, sf_dir):
    """The reported objective leaves the ridge out, so a heavier ridge can only raise it."""
    matrix, labels = _vectors(spark, sf_dir)
    state = P.MasterState(matrix, labels, COST)
    state.add(*scaled_pool(spark, sf_dir))
    rows = [_solution_row(f"ridge_{r:g}", state.solve("conico", ridge=r, tol=5e-3)) for r in (0.0, 1e-6, 10.0)]
    state.release()
    return _report(spark, rows)


def _pool_slacks(spark, sf_dir):
    """(col_id, row_id, xi) of every pool column with its own bias."""
    matrix, labels = _vectors(spark, sf_dir)
    pool, pool_w = clean_vector_pool(spark, sf_dir)
    pool_w = pool_w.withColumn("weight", F.col("weight") * 10)
    z = C.project_rows(matrix, pool_w)
    columns = pool.select("col_id").limit(C.MAX_GRAM_COLUMNS + 1).collect()
    if len(columns) > C.MAX_GRAM_COLUMNS:
        raise ValueError(f"the pool has more than {C.MAX_GRAM_COLUMNS} columns")
    # every column meets every row once: the pool is a small table
    pairs = labels.withColumn("col_id", F.explode(F.array(*[F.lit(r["col_id"]) for r in columns])))
    scored = pairs.join(z, ["row_id", "col_id"], "left").join(pool.select("col_id", "b"), "col_id")
    xi = F.greatest(F.lit(0.0), 1 - F.col("y") * (F.coalesce("z", F.lit(0.0)) + F.col("b")))
    return pool, pool_w, scored.select("col_id", "row_id", xi.alias("xi")).where(F.col("xi") > 0)


@query("master_stored_slack")
def _(spark, sf_dir):
    theta, ub, lb = P.solve_master_stored_slack(*_pool_slacks(spark, sf_dir), COST)
    return rounded(theta.withColumn("ub", F.lit(ub)).withColumn("lb", F.lit(lb)), "coef", "ub", "lb")


@query("hull_membership")
def _(spark, sf_dir):
    pool, pool_w = scaled_pool(spark, sf_dir)
    even = pool_w.groupBy("feature_id").agg((F.sum("weight") / 11).alias("weight"))
    far = even.withColumn("weight", F.col("weight") * 40)
    rows = []
    for name, column in (("mean", even), ("far", far)):
        for kind in ("convexo", "afin", "conico", "libre"):
            inside, left = P.hull_membership(column, pool, pool_w, kind)
            rows.append({"column": name, "combination": kind, "inside": inside, "outside_by": round(left, 4)})
    return _report(spark, rows)


# ---------------------------------------------------------------- D11
def _priced(spark, sf_dir, cut, m_box, tol=1e-2):
    matrix, labels = _vectors(spark, sf_dir)
    s = P.solve_master(matrix, labels, *scaled_pool(spark, sf_dir), "convexo", COST, None, tol=1e-2)
    gradient = D.choose_gradient(D.master_gradient(matrix, D.equalised_duals(s.duals), s.weights), "alpha_only")
    c = R.price_column(matrix, labels, gradient, COST, m_box, cut, tol=tol)
    against = c.weights.join(gradient, "feature_id").agg(F.sum(F.col("weight") * F.col("grad")).alias("v")).first()["v"]
    # without a bound: null
    lower = round(c.lower, 6) if np.isfinite(c.lower) else None
    return spark.createDataFrame([(round(c.objective, 6), lower, round(c.norm_w, 6), round(against or 0.0, 6), c.status, c.passes)],
                                 "ub double, lb double, norm_w double, g_dot_w double, status string, passes long")


@query("price_column")
def _(spark, sf_dir):
    return _priced(spark, sf_dir, None, 10.0)


@query("price_column_unboxed")
def _(spark, sf_dir):
    return _priced(spark, sf_dir, None, None)


@query("price_column_halfspace")
def _(spark, sf_dir):
    return _priced(spark, sf_dir, "halfspace", 10.0)


@query("price_column_sign")
def _(spark, sf_dir):
    return _priced(spark, sf_dir, "sign", 10.0)


@query("price_column_wide")
def _(spark, sf_dir):
    """Pricing over all text features."""
    matrix, labels, _ = _texts(spark, sf_dir)
    start = D.equalised_duals(labels.select("row_id", "y", F.lit(0.0).alias("margin"), F.lit(COST).alias("pi")))
    gradient = D.dual_feature_sums(matrix, start).withColumnRenamed("s", "grad")
    c = R.price_column(matrix, labels, D.scale_gradient(gradient, 1e-8), COST, 10.0, tol=1e-2)
    return _report(spark, [{"ub": round(c.objective, 6), "lb": round(c.lower, 6), "norm_w": round(c.norm_w, 6),
                            "gap": round((c.objective - c.lower) / abs(c.objective), 6), "status": c.status}])


# ---------------------------------------------------------------- E: loops
def _start(spark, sf_dir):
    pool, pool_w = scaled_pool(spark, sf_dir)
    return (*_vectors(spark, sf_dir), pool, pool_w)


# loops end by a stopping rule: a step that changes the objective, some 380, by less than tol
LOOP = dict(cost=COST, m_box=10.0, master_tol=5e-3, pricing_tol=2e-2, tol=0.5, max_iter=30)


def _iterations(run):
    return rounded(run.run_iterations().withColumn("status", F.lit(run.status)), "ub", "lb")


@query("column_generation")
def _(spark, sf_dir):
    return _iterations(G.column_generation(*_start(spark, sf_dir), G.Settings(**LOOP, idle_periods=2, check_every=2)))


@query("column_generation_hybrid")
def _(spark, sf_dir):
    return _iterations(G.column_generation_hybrid(*_start(spark, sf_dir), G.Settings(**LOOP, pricing_every=2, screen_k=10)))


@query("column_generation_points_rays")
def _(spark, sf_dir):
    return _iterations(G.column_generation_points_rays(*_start(spark, sf_dir), G.Settings(**LOOP, max_rays=10)))


@query("column_generation_basic")
def _(spark, sf_dir):
    return _iterations(G.column_generation_basic(*_start(spark, sf_dir), G.Settings(**LOOP, gradient="alpha_only")))


@query("column_generation_texts")
def _(spark, sf_dir):
    """The text run: block models as start pool, then screening and pricing steps over the whole vocabulary."""
    matrix, labels, features = _texts(spark, sf_dir)
    fits = K.block_svms_contiguous(matrix, labels, features, 12, tol=5e-2)
    pool = C.zero_column(spark).unionByName(fits.pool)
    # ends by the stopping rule, with steps that change the objective, some 20, by less than what its masters leave open
    settings = G.Settings(combination="conico", cost=COST, m_box=None, pricing_box=10.0, master_tol=1e-2, pricing_tol=2e-2, tol=0.2,
                          max_iter=1000, screen_k=50)
    return _iterations(G.column_generation_hybrid(matrix, labels, pool, fits.pool_w, settings))


@query("pool_prefilter")
def _(spark, sf_dir):
    matrix, labels, pool, pool_w = _start(spark, sf_dir)
    units = C.sample_unit_columns(vector_features(spark, sf_dir), 0.1)
    kept, kept_w, _ = G.pool_prefilter(matrix, labels, [(pool, pool_w), units], cost=COST, gap=5e-3)
    return kept.join(kept_w.groupBy("col_id").agg(F.count(F.lit(1)).alias("n_weights")), "col_id", "left")


@query("final_refit")
def _(spark, sf_dir):
    matrix, labels, pool, pool_w = _start(spark, sf_dir)
    active = C.active_columns(pool, pool_w, pool_theta(pool))
    s = G.final_refit(matrix, labels, *active, "libre", COST, None, 5e-3)
    return rounded(s.weights.withColumn("b", F.lit(s.b)), "weight", "b", digits=4)


@query("experiment_runner")
def _(spark, sf_dir):
    """A grid of masters, one of an unknown type: that run is stored with its error, and a second call runs nothing."""
    import uuid

    from widemargin.plans import experiments as X
    from widemargin.session import ensure_checkpoint_dir
    matrix, labels = _vectors(spark, sf_dir)
    state = P.MasterState(matrix, labels, COST)
    state.add(*scaled_pool(spark, sf_dir))
    grid = X.with_filename(X.experiment_grid(X.axes_frame(spark, tipo=["convexo", "conico", "otro"], tolerance=[2e-2, 5e-3])))
    calls = []

    def run(row):
        calls.append(row["filename"])
        s = state.solve(row["tipo"], tol=row["tolerance"])
        return {"final_obj": s.objective, "iterations": s.passes, "status": s.status}

    folder = f"{ensure_checkpoint_dir(spark)}/grid/{uuid.uuid4().hex}"
    X.run_grid(grid, run, folder)
    first = len(calls)
    stored = X.run_grid(grid, run, folder)
    state.release()
    return rounded(stored.select("filename", "tipo", "tolerance", "final_obj", "status", "error_msg")
                   .withColumn("run_again", F.lit(len(calls) - first)), "final_obj", digits=3)


@query("run_once")
def _(spark, sf_dir):
    matrix, labels = _vectors(spark, sf_dir)
    parts = B.stratified_split(labels, seed=2)
    sides = []
    for part in ("train", "test"):
        rows = parts.where(F.col("part") == part).select("row_id", "y")
        sides.append((matrix.join(rows.select("row_id"), "row_id", "left_semi"), rows))
    return G.run_once(*sides, G.Settings(**{**LOOP, "combination": "conico"}),
                      pool=scaled_pool(spark, sf_dir))
