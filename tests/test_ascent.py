"""Dual ascent by row blocks: several blocks, hot features, odd rows, proven gaps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from widemargin.functions import skew
from widemargin.operators import ascent as A, bounds as D

N, FEATURES = 200, 40


@pytest.fixture(scope="module")
def texts(spark):
    """Sparse non-negative rows of length 1, more features than a row has cells; some rows have none."""
    rng = np.random.default_rng(3)
    y = np.where(rng.random(N) < 0.3, -1, 1)
    cells = []
    for i in range(N):
        if i % 50 == 7:
            continue
        js = rng.choice(FEATURES, 8, replace=False)
        js = np.unique(np.append(js, 0 if y[i] > 0 else 1))
        v = rng.random(len(js)) + 0.2
        cells += [(i, int(j), float(x)) for j, x in zip(js, v / np.linalg.norm(v))]
    dense = np.zeros((N, FEATURES))
    for i, j, v in cells:
        dense[i, j] = v
    matrix = spark.createDataFrame(cells, "row_id long, feature_id long, value double").persist()
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "row_id long, y int").persist()
    return matrix, labels, dense, y.astype(float)


def weights_of(found, size=FEATURES):
    w = np.zeros(size)
    for r in found.weights.collect():
        w[r["feature_id"]] = r["weight"]
    return w


@pytest.mark.parametrize("squared", [False, True])
@pytest.mark.parametrize("cells", [1 << 20, 600])
def test_norms(texts, squared, cells):
    matrix, labels, dense, y = texts
    stored = A.StoredMatrix(matrix, labels, block_cells=cells)
    assert stored.blocks == (1 if cells > 600 else 3)
    found = A.fit_norm(stored, 1.0, 4e-2, squared, max_epochs=60)
    w = weights_of(found)
    length = w @ w / 2 if squared else np.linalg.norm(w)
    assert found.status == "optimal"
    assert found.objective == pytest.approx(length + np.maximum(0, 1 - y * (dense @ w + found.b)).sum(), abs=1e-8)
    duals = found.duals.toPandas().set_index("row_id").reindex(range(N))
    pi = duals["pi"].to_numpy()
    v = dense.T @ (y * pi)
    assert pi.min() >= 0 and pi.max() <= 1 + 1e-12 and abs(y @ pi) < 1e-9
    bound = pi.sum() - v @ v / 2 if squared else pi.sum()
    assert squared or np.linalg.norm(v) <= 1 + 1e-9
    assert found.lower == pytest.approx(bound, abs=1e-8)
    assert np.allclose(duals["margin"], y * (dense @ w + found.b))


def test_price_in_blocks_without_a_bias_in_reach(spark, texts):
    matrix, labels, dense, y = texts
    g = np.random.default_rng(5).normal(size=FEATURES) * 0.2
    gradient = spark.createDataFrame([(j, float(v)) for j, v in enumerate(g)], "feature_id long, grad double")
    one = A.fit_price(A.StoredMatrix(matrix, labels), gradient, 1.0, 5.0, None, 1e-2, max_epochs=60)
    more = A.fit_price(A.StoredMatrix(matrix, labels, block_cells=600), gradient, 1.0, 5.0, None, 0.1, max_epochs=80)
    assert one.status == more.status == "optimal" and more.blocks == 3
    assert max(one.lower, more.lower) <= min(one.objective, more.objective) + 1e-6
    w = weights_of(more)
    assert more.objective == pytest.approx(np.maximum(0, 1 - y * (dense @ w + more.b)).sum() - g @ w, abs=1e-8)


def test_price_of_one_class(spark, texts):
    """No slack is needed: the bound is that of the box alone."""
    matrix, labels, dense, _ = texts
    gradient = spark.createDataFrame([(0, 0.5), (3, -0.25)], "feature_id long, grad double")
    found = A.fit_price(A.StoredMatrix(matrix, labels.withColumn("y", F.lit(-1))), gradient, 1.0, 4.0, None, 1e-6)
    assert found.objective == pytest.approx(-3.0) and found.lower == pytest.approx(-3.0) and found.sum_xi == 0


def test_one_class_and_no_cells(spark, texts):
    matrix, labels, _, _ = texts
    found = A.fit_norm(A.StoredMatrix(matrix, labels.withColumn("y", F.lit(1))))
    assert (found.objective, found.lower, found.b) == (0.0, 0.0, 1.0)
    none = matrix.limit(0)
    found = A.fit_norm(A.StoredMatrix(none, labels), tol=1e-6)
    few = min(r["count"] for r in labels.groupBy("y").count().collect())
    assert found.objective == pytest.approx(2 * few) and found.lower == pytest.approx(2 * few)


def test_hot_features_are_sliced(monkeypatch, texts):
    monkeypatch.setattr(skew, "ROWS_PER_SLICE", 20)
    matrix, labels, _, _ = texts
    hot = skew.hot_keys(matrix, "feature_id", 20)
    stored = A.StoredMatrix(matrix, labels, hot)
    assert stored.by_feature.select("_slice").distinct().count() > 3
    assert A.fit_norm(stored, 1.0, 2e-2).status == "optimal"


def test_the_bound_is_that_of_the_tables(texts):
    matrix, labels, _, _ = texts
    found = A.fit_norm(A.StoredMatrix(matrix, labels), 1.0, 2e-2)
    row = D.dual_bound(matrix, found.duals, 1.0).first()
    assert row["feasible"] and row["lb_conic"] == pytest.approx(found.lower, abs=1e-8)


def test_epoch_leaves_the_matrix_where_it_is(texts):
    """The stored cells meet the feature table without a shuffle of their own."""
    matrix, labels, _, _ = texts
    stored = A.StoredMatrix(matrix, labels)
    lookup = matrix.select("feature_id").distinct().withColumn("u", F.lit(0.0))
    spark = matrix.sparkSession
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = skew.salted_join(stored.by_feature, lookup, "feature_id", "row_id", F.broadcast(stored.hot), "left")
    text = plan._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "Bucketed: true" in text


def test_blocks_follow_the_length(spark):
    """Long lists of words, nearly separable: the weights are long, and the duals of several blocks must shrink to them."""
    rng = np.random.default_rng(4)
    n, words = 400, 30
    cells = {}
    for i, js in enumerate(np.minimum((rng.pareto(0.6, (n, words)) * 3).astype(int), 2999)):
        for j in js:
            cells[i, int(j)] = cells.get((i, int(j)), 0.0) + 1 / np.sqrt(words)
    matrix = spark.createDataFrame([(i, j, float(v)) for (i, j), v in cells.items()], "row_id long, feature_id long, value double")
    labels = spark.createDataFrame([(i, -1 if i % 7 == 0 else 1) for i in range(n)], "row_id long, y int")
    found = A.fit_norm(A.StoredMatrix(matrix, labels, block_cells=-(-len(cells) // 4)), 1.0, 1e-2, max_epochs=25)
    # 0.18 before the duals were rescaled
    assert found.blocks == 4 and found.gap <= 0.1


def test_price_works_on_the_rows_that_hold_the_step(spark):
    """Words of nearly separable texts in several blocks: few rows hold a step, so few epochs meet the bound; a repeated row keeps its own slack."""
    rng = np.random.default_rng(4)
    n, words = 400, 30
    cells = {}
    for i, js in enumerate(np.minimum((rng.pareto(0.6, (n, words)) * 3).astype(int), 2999)):
        for j in js:
            cells[i, int(j)] = cells.get((i, int(j)), 0.0) + 1 / np.sqrt(words)
    y = np.where(np.arange(n) % 7 == 0, -1, 1)
    dense = np.zeros((n, 3000))
    for (i, j), v in cells.items():
        dense[i, j] = v
    g = dense.T @ np.where(y > 0, (y < 0).sum() / (y > 0).sum(), -1.0)
    g /= np.linalg.norm(g)
    matrix = spark.createDataFrame([(i, j, float(v)) for (i, j), v in cells.items()], "row_id long, feature_id long, value double")
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)] + [(0, -1)], "row_id long, y int")
    gradient = spark.createDataFrame([(j, float(v)) for j, v in enumerate(g) if v], "feature_id long, grad double")
    found = A.fit_price(A.StoredMatrix(matrix, labels, block_cells=-(-len(cells) // 4)), gradient, 1.0, 10.0, None, 1e-2, max_epochs=12)
    assert found.blocks == 4 and found.status == "optimal"
    # the second row of id 0 has no cells
    w, b = weights_of(found, 3000), found.b
    slack = np.maximum(0, 1 - y * (dense @ w + b)).sum() + max(0.0, 1 + b)
    assert found.objective == pytest.approx(slack - g @ w, abs=1e-8)
    pi = found.duals.toPandas()
    assert len(pi) == n + 1 and pi["pi"].between(0, 1 + 1e-12).all() and abs((pi["y"] * pi["pi"]).sum()) < 1e-9
