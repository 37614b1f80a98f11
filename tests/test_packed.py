"""Packed matrices: the joint block, what passes leave alone, tf-idf on word codes, and the loop over texts as a whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from widemargin.operators import ascent as A, features as B, packed as P, terms as W


@pytest.fixture(scope="module")
def words(spark):
    """Long lists of words, nearly separable."""
    rng = np.random.default_rng(4)
    n, size = 400, 30
    cells = {}
    for i, js in enumerate(np.minimum((rng.pareto(0.6, (n, size)) * 3).astype(int), 2999)):
        for j in js:
            cells[i, int(j)] = cells.get((i, int(j)), 0.0) + 1 / np.sqrt(size)
    matrix = spark.createDataFrame([(i, j, float(v)) for (i, j), v in cells.items()], "row_id long, feature_id long, value double").persist()
    labels = spark.createDataFrame([(i, -1 if i % 7 == 0 else 1) for i in range(n)], "row_id long, y int").persist()
    dense = np.zeros((n, 3000))
    for (i, j), v in cells.items():
        dense[i, j] = v
    return matrix, labels, dense, len(cells)


def test_joint_block_keeps_objective_and_duals(words):
    """What the joint block moves reaches the rows, the features and the sums alike."""
    matrix, labels, dense, n_cells = words
    found = A.fit_norm(A.StoredMatrix(matrix, labels, block_cells=-(-n_cells // 2)), 1.0, 1e-4, max_epochs=3)
    assert found.blocks == 2
    w = np.zeros(3000)
    for r in found.weights.collect():
        w[r["feature_id"]] = r["weight"]
    y = np.array([r["y"] for r in labels.orderBy("row_id").collect()], float)
    assert found.objective == pytest.approx(np.linalg.norm(w) + np.maximum(0, 1 - y * (dense @ w + found.b)).sum(), abs=1e-8)
    pi = found.duals.orderBy("row_id").toPandas()["pi"].to_numpy()
    assert found.lower == pytest.approx(pi.sum(), abs=1e-8) and np.linalg.norm(dense.T @ (y * pi)) <= 1 + 1e-9


def test_fits_need_no_copy_by_feature(spark, words):
    """Before, each epoch joined the cells, stored by feature, with a table and shuffled them; now they stay in their blocks."""
    matrix, labels, _, n_cells = words
    stored = A.StoredMatrix(matrix, labels, block_cells=-(-n_cells // 2))
    gradient = spark.createDataFrame([(0, 0.5), (3, -0.25), (7000, 0.5)], "feature_id long, grad double")
    A.fit_price(stored, gradient, 1.0, 5.0, None, 0.1, max_epochs=2)
    A.fit_norm(stored, 1.0, 0.1, max_epochs=2)
    assert "by_feature" not in vars(stored)


def test_repeated_cells_count_together_and_strange_rows_are_left_out(spark, monkeypatch):
    monkeypatch.setattr(P, "PIECE_CELLS", 4)
    monkeypatch.setattr(P, "PART_CELLS", 3)
    cells = [(1, 5, 1.0), (1, 5, 2.0), (2, -7, 1.5), (2, 9, 0.5), (3, 9, 1.0), (8, 9, 4.0)]
    matrix = spark.createDataFrame(cells, "row_id long, feature_id long, value double")
    labels = spark.createDataFrame([(1, 1), (2, -1), (2, 1), (3, 1), (4, -1)], "row_id long, y int")
    packed = P.Packed(matrix, labels, 2, len(cells))
    values = spark.createDataFrame([(5, 1.0), (-7, 10.0), (9, 100.0), (11, 7.0)], "feature_id long, v double")
    sent = packed.messages(values, ["v"])
    found = {r["row_id"]: (r["cells"], r["z"]) for r in packed.scores(sent, {"z": "a"}).collect()}
    assert found == {1: (1, 3.0), 2: (2, 65.0), 3: (1, 100.0)}
    some = packed.cells_of(labels.where("row_id = 2").select("row_id"), sent, {"v": "a"}).collect()
    assert sorted(map(tuple, some)) == [(2, -7, 1.5, 10.0), (2, 9, 0.5, 100.0)]


@pytest.mark.parametrize("n_max", [1, 2])
def test_tfidf_on_word_codes_is_that_of_the_terms(spark, monkeypatch, n_max):
    """Several chunks and parts, empty texts, words that are prefixes of others, ids that come twice."""
    monkeypatch.setattr(W, "CHUNK_WORDS", 40)
    monkeypatch.setattr(W, "CHUNKS_A_PART", 1)
    rng = np.random.default_rng(2)
    names = ["aa", "aab", "a1", "a_", "zz", "éé", "日本", "b2b", "b2", "bb"]
    rows = [(i // 2 if i < 10 else i, " ".join(rng.choice(names, rng.integers(0, 12), p=np.arange(10, 0, -1) / 55))) for i in range(60)]
    rows += [(100, ""), (101, None), (102, "x . y")]
    texts = spark.createDataFrame(rows, "row_id long, clean_data string").fillna("")
    tokens = B.tokenize(texts.repartition(3, "row_id").sortWithinPartitions("row_id"))
    matrix, features = W.fitted_tfidf(tokens, 63, 3, 0.6, n_max)
    terms = B.term_counts(B.tokenize(texts), 1, n_max)
    vocab = B.fit_vocabulary(terms, 63, 3, 0.6)
    want = B.tfidf_matrix(terms, vocab)
    sides = [sorted((r["row_id"], r["feature_id"], r["value"]) for r in t.collect()) for t in (matrix, want)]
    assert [s[:2] for s in sides[0]] == [s[:2] for s in sides[1]] and len(sides[0]) > 100
    assert np.allclose([s[2] for s in sides[0]], [s[2] for s in sides[1]], rtol=1e-12)
    assert sorted(r[0] for r in features.collect()) == sorted(r[0] for r in vocab.select("feature_id").collect())


def test_tfidf_without_words(spark):
    tokens = B.tokenize(spark.createDataFrame([(1, "")], "row_id long, clean_data string"))
    matrix, features = W.fitted_tfidf(tokens, 1, 1, 1.0)
    assert matrix.count() == 0 and features.count() == 0


def test_the_text_loop_is_not_cut(spark, monkeypatch):
    """It runs to its stopping rule, with pricing steps; before, it ended after two screening steps."""
    from __spark_entry__ import queries
    from registry import training as R
    seen = []
    none = spark.createDataFrame([], "feature_id long")
    monkeypatch.setattr(R, "_texts", lambda spark, sf_dir: (None, None, none))
    fits = type("Fits", (), {"pool": R.C.zero_column(spark), "pool_w": None})
    monkeypatch.setattr(R.K, "block_svms_contiguous", lambda *a, **k: fits)
    monkeypatch.setattr(R.G, "column_generation_hybrid", lambda m, l, p, w, settings: seen.append(settings))
    monkeypatch.setattr(R, "_iterations", lambda run: none)
    queries()["column_generation_texts"](spark, "")
    assert seen[0].max_iter >= 1000 and seen[0].pricing_every > 0 and 0 < seen[0].tol <= 0.2
