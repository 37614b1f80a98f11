"""Trained models against brute force, certificates and planted answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from widemargin.operators import blocks as K, bounds as D, master as P, pool as C, pricing as R, svm as V
from widemargin.operators.newton import Regulariser, combination_bound, combination_set, minimise
from widemargin.operators.rows import hinge_terms, split_terms
from widemargin.plans import column_generation as G
from widemargin.sources.artifacts import last_checkpoint

N, FEATURES = 120, 6


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(N, FEATURES))
    y = np.where(x[:, 2] - x[:, 4] + 0.4 * rng.normal(size=N) > 0, 1, -1)
    cells = [(int(i), int(j), float(x[i, j])) for i in range(N) for j in range(FEATURES) if abs(x[i, j]) > 0.1]
    matrix = spark.createDataFrame(cells, "row_id long, feature_id long, value double").persist()
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "row_id long, y int").persist()
    dense = np.zeros((N, FEATURES))
    for i, j, v in cells:
        dense[i, j] = v
    return matrix, labels, dense, y.astype(float)


@pytest.fixture(scope="module")
def pool(spark):
    weights = [("p_a", 2, 1.0), ("p_b", 4, -1.0), ("p_b", 0, 0.2), ("p_c", 1, 1.0), ("r_d", 2, 1.0)]
    names = [("p_a", "point"), ("p_b", "point"), ("p_c", "point"), ("p_zero", "point"), ("r_d", "ray")]
    return (spark.createDataFrame([(n, k, "test", 0, 0.0) for n, k in names], C.POOL_SCHEMA),
            spark.createDataFrame(weights, C.POOL_W_SCHEMA))


def optimum(dense, y, size):
    def evaluate(points, width, after=None):
        points = np.atleast_2d(points)
        return split_terms(hinge_terms(dense, y, points, width), len(points), size)
    rays = np.zeros(size, bool)
    return minimise(evaluate, Regulariser(np.eye(size)), combination_set("libre", rays), np.zeros(size + 1), 1.0,
                    combination_bound(np.eye(size), "libre", rays), 1e-5, 500)


def test_conic_svm_and_its_certificate(planted):
    matrix, labels, dense, y = planted
    model = V.conic_svm(matrix, labels, tol=1e-3)
    exact = optimum(dense, y, FEATURES)
    assert model.gap <= 1e-3 and exact.lower - 1e-6 <= model.objective
    assert abs(V.certificate(model, matrix).first()["lb_conic"] - model.lower) < 1e-6
    w = {r["feature_id"]: r["weight"] for r in model.weights.collect()}
    assert w[2] > 0 > w[4] and abs(w[2]) > 3 * abs(w.get(1, 0.0))


def test_wide_path_reaches_the_narrow_one(planted):
    matrix, labels, _, _ = planted
    narrow = V.conic_svm(matrix, labels, tol=1e-3)
    wide = V.conic_svm(matrix, labels, tol=1e-2, narrow=0)
    assert wide.status == "optimal" and wide.gap <= 1e-2
    assert wide.lower <= narrow.objective + 1e-6 and wide.objective >= narrow.lower - 1e-6
    assert abs(V.certificate(wide, matrix).first()["lb_conic"] - wide.lower) < 1e-6


def test_linear_svm_objective(planted):
    matrix, labels, dense, y = planted
    model = V.linear_svm(matrix, labels)
    assert model.status == "optimal" and model.lower <= model.objective <= model.lower + 1e-3 * max(1, model.objective)
    w = np.zeros(FEATURES)
    for r in model.weights.collect():
        w[r["feature_id"]] = r["weight"]
    assert abs(0.5 * w @ w + np.maximum(0, 1 - y * (dense @ w + model.b)).sum() - model.objective) < 1e-6
    assert (np.sign(dense @ w + model.b) == y).mean() > 0.8


def test_one_class_needs_no_weights(spark, planted):
    matrix, labels, _, _ = planted
    model = V.conic_svm(matrix, labels.withColumn("y", F.lit(1)), tol=1e-2)
    assert model.objective <= 0.2


@pytest.mark.parametrize("kind", D.COMBINATIONS)
def test_master_types(planted, pool, kind):
    found = P.solve_master(*planted[:2], *pool, kind, tol=5e-3)
    theta = {r["col_id"]: r["coef"] for r in found.theta.collect()}
    points = np.array([theta[c] for c in ("p_a", "p_b", "p_c", "p_zero")])
    assert theta["r_d"] >= -1e-9 and found.lower <= found.objective
    if kind in ("convexo", "afin"):
        assert abs(points.sum() - 1) < 1e-6
    if kind in ("convexo", "conico", "mayor_uno"):
        assert points.min() >= -1e-9
    if kind == "mayor_uno":
        assert points.sum() >= 1 - 1e-6
    _, _, dense, y = planted
    w = np.zeros(FEATURES)
    for r in found.weights.collect():
        w[r["feature_id"]] = r["weight"]
    value = np.linalg.norm(w) + np.maximum(0, 1 - y * (dense @ w + found.b)).sum()
    assert abs(value - found.objective) < 1e-6


def test_more_columns_are_never_worse_and_box_holds(planted, pool):
    matrix, labels, _, _ = planted
    state = P.MasterState(matrix, labels)
    state.add(*[d.where("col_id = 'p_a'") for d in pool])
    one = state.solve("conico", tol=1e-3)
    state.add(*pool)
    every = state.solve("conico", tol=1e-3)
    assert every.objective <= one.objective + 1e-3 * one.objective
    boxed = state.solve("libre", m_box=0.3, tol=1e-2)
    assert D.box_check(boxed.weights, 0.3 + 1e-6).first()["within"] and boxed.objective >= every.lower - 1e-6
    state.release()


def test_gradient_matches_finite_differences(planted, pool):
    """grad is minus the derivative of the smoothed objective."""
    matrix, labels, dense, y = planted
    found = P.solve_master(matrix, labels, *pool, "conico", tol=1e-2)
    duals = found.duals.toPandas().sort_values("row_id")
    grad = D.master_gradient(matrix, found.duals, found.weights).toPandas().set_index("feature_id")["grad"]
    w = np.zeros(FEATURES)
    for r in found.weights.collect():
        w[r["feature_id"]] = r["weight"]
    expected = -w / np.linalg.norm(w) + dense.T @ (y * duals["pi"].to_numpy())
    assert np.allclose(grad.reindex(range(FEATURES)).fillna(0), expected, atol=1e-8)


@pytest.mark.parametrize("cut", (None, "halfspace", "sign"))
def test_priced_columns(spark, planted, cut):
    matrix, labels, dense, y = planted
    g = np.array([0.3, -0.2, 0.5, 0.0, -0.6, 0.1])
    gradient = spark.createDataFrame([(j, float(v)) for j, v in enumerate(g)], "feature_id long, grad double")
    found = R.price_column(matrix, labels, gradient, 1.0, 4.0, cut, tol=1e-2)
    w = np.zeros(FEATURES)
    for r in found.weights.collect():
        w[r["feature_id"]] = r["weight"]
    value = np.maximum(0, 1 - y * (dense @ w + found.b)).sum() - g @ w
    assert abs(value - found.objective) < 1e-6 and found.lower <= value + 1e-6
    assert np.abs(w).max() <= 4.0 + 1e-9
    if cut == "halfspace":
        assert g @ w <= 1e-6
    if cut == "sign":
        assert (g * w).max() <= 1e-9


@pytest.mark.parametrize("cut", (None, "halfspace", "sign"))
def test_wide_pricing_reaches_the_narrow_one(spark, planted, cut):
    """The gradient is shorter than the features, and one of its features has no cells."""
    matrix, labels, dense, y = planted
    gradient = spark.createDataFrame([(2, 0.4), (4, -0.3), (99, 0.2)], "feature_id long, grad double")
    narrow = R.price_column(matrix, labels, gradient, 1.0, 2.0, cut, tol=1e-3)
    wide = R.price_column(matrix, labels, gradient, 1.0, 2.0, cut, tol=1e-2, narrow=0)
    assert wide.status == "optimal" and wide.objective - wide.lower <= 1e-2 * max(1.0, abs(wide.objective))
    assert wide.lower <= narrow.objective + 1e-6 and wide.objective >= narrow.lower - 1e-6
    w, g = np.zeros(100), np.zeros(100)
    g[[2, 4, 99]] = 0.4, -0.3, 0.2
    for r in wide.weights.collect():
        w[r["feature_id"]] = r["weight"]
    value = np.maximum(0, 1 - y * (dense @ w[:FEATURES] + wide.b)).sum() - g @ w
    assert abs(value - wide.objective) < 1e-6 and np.abs(w).max() <= 2.0 + 1e-9
    if cut == "halfspace":
        assert g @ w <= 1e-6
    if cut == "sign":
        assert (g * w).max() <= 1e-9


def test_feature_without_cells_counts_in_the_price(spark, planted):
    matrix, labels, _, _ = planted
    gradient = spark.createDataFrame([(2, 0.4), (99, 0.5)], "feature_id long, grad double")
    rows = R.UnitRows(matrix, labels, np.arange(FEATURES))
    found = R.price_column(matrix, labels, gradient, 1.0, 2.0, tol=1e-3, unit_rows=rows)
    assert found.weights.where("feature_id = 99").first()["weight"] == pytest.approx(2.0, abs=1e-2)


def test_unboxed_pricing_claims_no_bound(spark, planted):
    matrix, labels, _, _ = planted
    gradient = spark.createDataFrame([(2, 500.0)], "feature_id long, grad double")
    found = R.price_column(matrix, labels, gradient, 1.0, None, tol=1e-2, max_passes=30)
    assert found.status == "unbounded_suspected" and found.lower == -np.inf


def test_blocks_in_tasks_and_as_jobs_agree(spark, planted):
    matrix, labels, _, _ = planted
    features = spark.range(FEATURES).select(F.col("id").alias("feature_id"))
    inside = K.block_svms_contiguous(matrix, labels, features, 3, tol=1e-3).log.orderBy("model_id").collect()
    alone = K.block_svms_contiguous(matrix, labels, features, 3, tol=1e-3, max_cells=1).log.orderBy("model_id").collect()
    assert [r["status"] for r in inside] == ["success"] * 3
    for a, b in zip(inside, alone):
        assert a["model_id"] == b["model_id"] and a["n_features"] == b["n_features"] == 2
        assert abs(a["objective"] - b["objective"]) <= 2e-3 * a["objective"]


def test_large_blocks_are_fitted_at_the_same_time(spark, planted, monkeypatch):
    """Each of two fits waits for the other: one after another they would end as errors."""
    import threading
    matrix, labels, _, _ = planted
    both, fit = threading.Barrier(2, timeout=120), K.conic_svm

    def waiting(*args, **options):
        both.wait()
        return fit(*args, **options)
    monkeypatch.setattr(K, "conic_svm", waiting)
    features = spark.range(FEATURES).select(F.col("id").alias("feature_id"))
    log = K.block_svms_contiguous(matrix, labels, features, 2, tol=1e-2, max_cells=1).log.collect()
    assert [r["status"] for r in log] == ["success"] * 2


def test_memory_of_a_task_per_cell():
    """A model holds its cells in a few plain arrays; frames with a text and the counts on each cell took about twice as much."""
    import tracemalloc
    rng = np.random.default_rng(5)
    rows, size = 30_000, 8
    y = np.where(rng.random(rows) < 0.5, 1, -1).astype("int8")
    cells = {"row_id": np.repeat(np.arange(rows), size), "y": np.repeat(y, size), "feature_id": np.tile(np.arange(size), rows),
             "value": rng.normal(size=rows * size) + 0.3 * np.repeat(y, size)}
    tracemalloc.start()
    fit = K.local_fit("m", cells, (int((y > 0).sum()), int((y < 0).sum())), "norm", 1.0, 1e-2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert fit["status"].iloc[0] == "success" and peak <= 130 * rows * size, peak / rows / size


def test_failed_block_becomes_a_log_row(spark, planted):
    matrix, labels, _, _ = planted
    doubled = labels.unionByName(labels.withColumn("row_id", F.col("row_id") + 1000))
    groups = spark.createDataFrame([("bad", 2), ("good", 4)], "model_id string, feature_id long")
    broken = matrix.withColumn("value", F.when(F.col("feature_id") == 2, F.lit(float("nan"))).otherwise(F.col("value")))
    fits = K.fit_blocks(broken, doubled, groups, tol=1e-2)
    states = {r["model_id"]: r["status"] for r in fits.log.collect()}
    assert states["good"] == "success" and fits.pool.where("col_id = 'p_good'").count() == 1


def test_forest_keeps_active_columns_and_zero(spark, planted):
    matrix, labels, _, _ = planted
    features = spark.range(FEATURES).select(F.col("id").alias("feature_id"))
    forest = K.forest_pool(matrix, labels, features, 2, 3, sample_rows=80)
    ids = [r["col_id"] for r in forest.pool.collect()]
    assert "p_zero" in ids and 2 <= len(ids) <= 7 and len(forest.iterations) == 2
    fast = K.forest_pool_fast(matrix, labels, features, 1, 3, 0.5)
    norms = [r["norm"] for r in C.column_norms(fast.pool_w).collect()]
    assert "p_zero" not in [r["col_id"] for r in fast.pool.collect()] and np.allclose(norms, 1.0, atol=1e-6)


def test_hull(spark, pool):
    points, w = [d.where("col_id in ('p_a', 'p_c')") for d in pool]
    middle = spark.createDataFrame([(2, 0.5), (1, 0.5)], "feature_id long, weight double")
    assert P.hull_membership(middle, points, w, "convexo")[0]
    outside = spark.createDataFrame([(2, 2.0), (1, 0.5)], "feature_id long, weight double")
    assert not P.hull_membership(outside, points, w, "convexo")[0]
    assert P.hull_membership(outside, points, w, "conico")[0]
    assert not P.hull_membership(spark.createDataFrame([(3, 1.0)], "feature_id long, weight double"), points, w, "libre")[0]


SETTINGS = dict(m_box=5.0, master_tol=1e-2, pricing_tol=5e-2, max_iter=2)


@pytest.mark.parametrize("loop", (G.column_generation, G.column_generation_hybrid, G.column_generation_points_rays,
                                  G.column_generation_basic))
def test_loops_improve_and_never_rise(planted, pool, tmp_path, loop):
    matrix, labels, dense, y = planted
    run = loop(matrix, labels, *pool, settings=G.Settings(**SETTINGS, screen_k=3), run_id="t", state_dir=str(tmp_path))
    ubs = [r["ub"] for r in run.iterations]
    best = optimum(dense, y, FEATURES)
    assert all(b <= a + 1e-6 for a, b in zip(ubs, ubs[1:]))
    assert ubs[-1] >= best.lower - 1e-6 and all(r["lb"] <= best.objective + 1e-6 for r in run.iterations)
    assert run.run_iterations().count() == len(ubs) and run.theta_history().where("coef is not null").count() > 0


def test_convex_loop_comes_close_to_the_optimum(planted, pool):
    matrix, labels, dense, y = planted
    run = G.column_generation(matrix, labels, *pool, G.Settings(**{**SETTINGS, "max_iter": 3}))
    assert run.iterations[-1]["ub"] <= 1.15 * optimum(dense, y, FEATURES).objective


def test_idle_columns_leave_the_pool(planted, pool):
    run = G.column_generation(*planted[:2], *pool, G.Settings(**{**SETTINGS, "combination": "conico"}, idle_periods=1, check_every=1))
    left = {r["col_id"] for r in run.pool.collect()}
    assert run.removed and not left & set(run.removed)


def test_prefilter_and_refit(planted, pool):
    matrix, labels, _, _ = planted
    kept, kept_w, first = G.pool_prefilter(matrix, labels, [pool])
    again = G.final_refit(matrix, labels, kept, kept_w, "conico")
    assert kept.count() <= 5 and abs(again.objective - first.objective) <= 5e-3 * first.objective


def test_run_once_reports_one_row(planted, pool):
    matrix, labels, _, _ = planted
    row = G.run_once((matrix, labels), (matrix, labels), G.Settings(**{**SETTINGS, "max_iter": 1}), pool=pool).collect()
    assert len(row) == 1 and 0.7 <= row[0]["accuracy"] <= 1.0 and row[0]["n_columns_init"] == 5


def test_stopped_run_goes_on_to_the_same_end(spark, planted, pool, tmp_path):
    matrix, labels, _, _ = planted
    plan = {**SETTINGS, "max_iter": 3, "combination": "conico"}
    whole = G.column_generation(matrix, labels, *pool, G.Settings(**plan), run_id="w", state_dir=str(tmp_path))
    assert last_checkpoint(spark, str(tmp_path), "none") is None
    # the state after step 1, as a run that failed in step 2 leaves it
    again = G.column_generation(matrix, labels, *pool, G.Settings(**plan), run_id="w",
                                resume_from=f"{tmp_path}/run_id=w/iter=1")
    ids = lambda run: sorted(r["col_id"] for r in run.pool.collect())
    assert ids(again) == ids(whole) and again.generated == whole.generated and again.status == whole.status
    assert [r["iter"] for r in again.iterations] == [r["iter"] for r in whole.iterations]
    assert again.iterations[:2] == whole.iterations[:2]
    assert again.iterations[-1]["ub"] == pytest.approx(whole.iterations[-1]["ub"], rel=1e-2)
    # an ended run repeats its last step, and goes further where it may
    more = G.column_generation(matrix, labels, *pool, G.Settings(**{**plan, "max_iter": 4}), run_id="w",
                               resume_from=last_checkpoint(spark, str(tmp_path), "w"))
    assert more.iterations[:3] == whole.iterations[:3] and len(more.iterations) >= len(whole.iterations)
    assert more.iterations[-1]["ub"] <= whole.iterations[-1]["ub"] * (1 + 1e-2)


def test_box_takes_every_feature_that_leaves_it(spark, planted):
    matrix, labels, _, _ = planted
    units, units_w = C.unit_columns(spark.range(FEATURES).select(F.col("id").alias("feature_id")))
    state = P.MasterState(matrix, labels)
    state.add(units, units_w)
    free = state.solve("libre", tol=1e-3)
    limit = 0.5 * min(abs(r["weight"]) for r in free.weights.orderBy(F.abs("weight").desc()).limit(2).collect())
    boxed = state.solve("libre", m_box=limit, tol=1e-2)
    assert boxed.weights.agg(F.max(F.abs("weight"))).first()[0] <= limit * (1 + 1e-6)
    assert boxed.status == "box_active" and boxed.objective >= free.lower - 1e-6
    state.release()


def test_stored_slack_keeps_every_column(spark, sf_dir, monkeypatch):
    from registry import training
    monkeypatch.setattr(training.C, "MAX_GRAM_COLUMNS", 1)
    monkeypatch.setattr(training, "clean_vector_pool", lambda *_: (
        spark.createDataFrame([(1, 0.0), (2, 0.0)], "col_id long, b double"), spark.createDataFrame([(1, 1, 1.0), (2, 1, 1.0)], "col_id long, feature_id long, weight double")))
    with pytest.raises(ValueError):
        training._pool_slacks(spark, sf_dir)


# ---------------------------------------------------------------- unit columns, failures, grids
def test_unit_rays_as_one_pool(spark, planted):
    """All unit rays allow every weight; half of them keep signs, which the Newton master on the same pool confirms."""
    matrix, labels, dense, y = planted
    features = spark.createDataFrame([(j, s) for j in range(FEATURES) for s in (1, -1)], "feature_id long, sign int")
    every = P.solve_unit_master(matrix, labels, *C.unit_columns(features, "ray"), "conico", tol=1e-2)
    free = V.conic_svm(matrix, labels, tol=1e-3)
    assert every.status == "optimal" and every.lower <= free.objective + 1e-6 and every.objective >= free.lower - 1e-6
    some = features.where("(feature_id = 2 and sign < 0) or feature_id = 1 or (feature_id in (0, 3) and sign > 0)")
    pool, pool_w = C.unit_columns(some, "ray")
    # columns need not have length 1
    pool_w = pool_w.withColumn("weight", F.col("weight") * (F.col("feature_id") + 1))
    pool = pool.unionByName(C.zero_column(spark))
    found = P.solve_unit_master(matrix, labels, pool, pool_w, "conico", tol=1e-2)
    exact = P.solve_master(matrix, labels, pool, pool_w, "conico", ridge=0.0, m_box=None, tol=1e-3)
    assert found.status == "optimal" and found.lower <= exact.objective + 1e-6 and found.objective >= exact.lower - 1e-6
    theta = {r["col_id"]: r["coef"] for r in found.theta.collect()}
    assert min(theta.values()) >= 0 and theta["p_zero"] == 0 and len(theta) == 6
    w = np.zeros(FEATURES)
    for r in pool_w.collect():
        w[r["feature_id"]] += r["weight"] * theta[r["col_id"]]
    assert w[2] <= 0 and w[4] == w[5] == 0
    value = np.linalg.norm(w) + np.maximum(0, 1 - y * (dense @ w + found.b)).sum()
    assert value == pytest.approx(found.objective, abs=1e-8)
    with pytest.raises(ValueError):
        P.solve_unit_master(matrix, labels, pool, pool_w.withColumn("col_id", F.lit("p_zero")), "conico")


def test_a_failing_master_keeps_what_the_run_has(tmp_path, planted, pool, monkeypatch):
    matrix, labels, _, _ = planted
    solve, calls = P.MasterState.solve, []

    def failing(self, *a, **k):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("no convergence")
        return solve(self, *a, **k)

    settings = G.Settings(combination="conico", m_box=5.0, master_tol=1e-2, pricing_tol=5e-2, max_iter=4)
    monkeypatch.setattr(P.MasterState, "solve", failing)
    run = G.column_generation(matrix, labels, *pool, settings, state_dir=str(tmp_path), run_id="broken")
    assert run.status == "MASTER_FAILURE" and "no convergence" in run.error and len(run.iterations) == 3
    assert run.iterations[-1]["status"] == "MASTER_FAILURE" and run.solution.objective == run.iterations[1]["ub"]
    assert run.run_iterations().count() == 3 and len(run.generated) >= 1
    monkeypatch.setattr(P.MasterState, "solve", solve)
    again = G.column_generation(matrix, labels, *pool, settings, run_id="broken", resume_from=last_checkpoint(planted[0].sparkSession, str(tmp_path), "broken"))
    assert again.error is None and [r["iter"] for r in again.iterations][:3] == [0, 1, 2] and again.iterations[2]["ub"] <= run.iterations[1]["ub"] + 1e-6


def test_a_failing_first_master_and_a_failing_pricing(planted, pool, monkeypatch):
    matrix, labels, _, _ = planted
    settings = G.Settings(combination="conico", m_box=5.0, master_tol=1e-2, max_iter=1)

    def broken(*a, **k):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(G, "price_column", broken)
        run = G.column_generation(matrix, labels, *pool, settings)
    assert run.iterations[0]["step"] == "screening_after_failure" and "lost" in run.error and run.iterations[0]["n_added"] > 0
    with monkeypatch.context() as m:
        m.setattr(P.MasterState, "solve", broken)
        run = G.column_generation(matrix, labels, *pool, settings)
    assert run.status == "MASTER_FAILURE" and run.solution is None and len(run.iterations) == 1


@pytest.mark.parametrize("kind", D.COMBINATIONS)
def test_box_with_a_bound(planted, pool, kind):
    """A box that binds: the point keeps it, the bound meets the objective, and both agree with pricing where they must."""
    matrix, labels, dense, y = planted
    state = P.MasterState(matrix, labels)
    state.add(*pool)
    free = state.solve(kind, tol=1e-3)
    peak = free.weights.agg(F.max(F.abs("weight"))).first()[0] or 0.0
    m_box = 0.6 * peak
    found = state.solve(kind, m_box=m_box, tol=5e-3)
    w = np.zeros(FEATURES)
    for r in found.weights.collect():
        w[r["feature_id"]] = r["weight"]
    assert np.abs(w).max() <= m_box * (1 + 1e-9)
    assert found.status == "box_active" and found.gap <= 5e-3
    assert found.objective >= free.lower - 1e-6
    assert found.objective == pytest.approx(np.linalg.norm(w) + np.maximum(0, 1 - y * (dense @ w + found.b)).sum(), abs=1e-6)
    theta = {r["col_id"]: r["coef"] for r in found.theta.collect()}
    points = np.array([theta[c] for c in ("p_a", "p_b", "p_c", "p_zero")])
    if kind in ("convexo", "afin"):
        assert abs(points.sum() - 1) < 1e-6
    if kind == "libre":
        # random allowed points are never better than the bound
        rng = np.random.default_rng(0)
        for _ in range(300):
            t = rng.normal(size=4) * 0.5
            t[3] = abs(t[3])
            v = np.zeros(FEATURES)
            v[2], v[4], v[0], v[1] = t[0] + t[3], -t[1], 0.2 * t[1], t[2]
            v *= min(1.0, m_box / max(np.abs(v).max(), 1e-12))
            b = min((np.maximum(0, 1 - y * (dense @ v + c)).sum() for c in np.linspace(-1, 1, 21)))
            assert np.linalg.norm(v) + b >= found.lower - 1e-9
    state.release()
