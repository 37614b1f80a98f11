"""Edge cases and skew behaviour of the relational operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from widemargin.functions.ranking import distributed_rank, take_per_group
from widemargin.functions.hashing import hash32
from widemargin.functions.skew import hot_keys, salted_join
from widemargin.operators import bounds as D, features as B, history as H, metrics as M, pool as C, screening as S
from widemargin.plans import experiments as X
from widemargin.sources import artifacts, tables as A


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(1, ""), (2, "Alpha"), (3, "alpha beta a alpha beta"), (4, "¡Ñandú_9 beta!")],
                                 "row_id long, clean_data string")


def test_tokens_and_ngrams_of_short_texts(texts):
    tokens = {r["row_id"]: r["tokens"] for r in B.tokenize(texts).collect()}
    assert tokens == {1: [], 2: ["alpha"], 3: ["alpha", "beta", "alpha", "beta"], 4: ["ñandú_9", "beta"]}
    counts = rows(B.term_counts(B.tokenize(texts), 1, 2), "row_id", "term", "tf")
    assert counts == [(2, "alpha", 1), (3, "alpha", 2), (3, "alpha beta", 2), (3, "beta", 2), (3, "beta alpha", 1),
                      (4, "beta", 1), (4, "ñandú_9", 1), (4, "ñandú_9 beta", 1)]
    assert counts == rows(B.count_terms(B.ngrams(B.tokenize(texts), 1, 2)), "row_id", "term", "tf")


def test_vocabulary_limits_and_order(texts):
    terms = B.term_counts(B.tokenize(texts), 1, 1)
    vocab = B.fit_vocabulary(terms, 4)
    assert rows(vocab, "feature_id", "term", "df") == [(0, "alpha", 2), (1, "beta", 2), (2, "ñandú_9", 1)]
    assert B.fit_vocabulary(terms, 4, min_df=2).count() == 2
    # a term in too many texts is dropped
    assert B.fit_vocabulary(terms, 4, max_df=0.25).count() == 1


def test_tfidf_rows_have_unit_length(texts):
    terms = B.term_counts(B.tokenize(texts), 1, 2)
    matrix = B.tfidf_matrix(terms, B.fit_vocabulary(terms, 4))
    for r in matrix.groupBy("row_id").agg(F.sum(F.col("value") ** 2).alias("s")).collect():
        assert abs(r["s"] - 1) < 1e-9


def test_constant_features_are_divided_by_one(spark):
    matrix = spark.createDataFrame([(r, 0, 5.0) for r in range(4)] + [(0, 1, 2.0)], "row_id long, feature_id long, value double")
    moments = B.feature_moments(matrix, 4)
    assert {r["feature_id"]: round(r["std"], 6) for r in moments.collect()} == {0: 0.0, 1: 0.866025}
    scaled = {(r["row_id"], r["feature_id"]): r["value"] for r in B.standard_scale(matrix, moments).collect()}
    assert scaled[(0, 0)] == 5.0 and abs(scaled[(0, 1)] - 2 / 0.8660254) < 1e-6
    zero = spark.createDataFrame([(0, 3, 0.0)], "row_id long, feature_id long, value double")
    assert B.maxabs_scale(zero, B.feature_maxabs(zero)).first()["value"] == 0.0


def test_features_unseen_in_training_keep_their_values(spark):
    train = spark.createDataFrame([(0, 1, 2.0), (1, 1, 4.0)], "row_id long, feature_id long, value double")
    both = train.unionByName(spark.createDataFrame([(2, 9, 5.0)], train.schema))
    assert B.standard_scale(both, B.feature_moments(train, 2)).where("feature_id = 9").first()["value"] == 5.0
    assert B.maxabs_scale(both, B.feature_maxabs(train)).where("feature_id = 9").first()["value"] == 5.0


def test_draws_depend_on_the_seed():
    assert B.draw_steps(100, 4, 1) == B.draw_steps(100, 4, 1) != B.draw_steps(100, 4, 2)
    assert all(np.gcd(step, 100) == 1 and 0 <= start < 100 for _, step, start in B.draw_steps(100, 4, 3))


def test_salted_join_equals_plain_join_with_hot_keys(spark):
    # one key holds most rows
    big = spark.range(600).select((F.when(F.col("id") < 400, 7).otherwise(F.col("id") % 5)).alias("k"), F.col("id").alias("r"))
    other = spark.createDataFrame([(0, "a"), (1, "b"), (7, "c"), (9, "d")], "k long, v string")
    hot = hot_keys(big, "k", rows_per_slice=50)
    assert rows(hot, "k", "slices") == [(7, 8)]
    got = salted_join(big, other, "k", "r", hot)
    assert rows(got, "k", "r", "v") == rows(big.join(other, "k"), "k", "r", "v")
    left = salted_join(big, other, "k", "r", hot, how="left")
    assert left.count() == 600
    # the hot key is spread over several slices
    from widemargin.functions.skew import with_slice
    assert with_slice(big, "k", "r", hot).where("k = 7").select("_slice").distinct().count() == 8


def test_distributed_rank_matches_a_sort(spark):
    df = spark.range(1000).select(hash32("x", "id").alias("h"), "id")
    got = rows(distributed_rank(df, ["h", "id"], "rank", partitions=7), "rank", "id")
    assert [i for _, i in got] == [r["id"] for r in df.orderBy("h", "id").collect()]


def test_quota_sample_matches_a_sort(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 10 == 0, 1).otherwise(-1).alias("y"), hash32("q", "id").alias("h"))
    quotas = spark.createDataFrame([(1, 37), (-1, 901)], "y int, quota long")
    got = take_per_group(df, ["y"], "h", "id", quotas, bits=4)
    want = [r["id"] for y, n in ((1, 37), (-1, 901)) for r in df.where(F.col("y") == y).orderBy("h", "id").limit(n).collect()]
    assert sorted(r["id"] for r in got.collect()) == sorted(want)


def test_quota_sample_with_all_hashes_in_one_bucket(spark, monkeypatch):
    """The boundary rows are ranked over all tasks, also when they are the whole group and share one hash."""
    from widemargin.functions import ranking
    seen, rank = [], ranking.distributed_rank

    def watched(df, *args):
        ranked = rank(df, *args)
        seen.append([r["count"] for r in ranked.groupBy(F.spark_partition_id()).count().collect()])
        return ranked
    monkeypatch.setattr(ranking, "distributed_rank", watched)
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 1).otherwise(-1).alias("y"),
                                  F.when(F.col("id") % 3 == 0, 12345).otherwise(12346).cast("long").alias("h"))
    quotas = spark.createDataFrame([(1, 400), (-1, 1999)], "y int, quota long")
    got = take_per_group(df, ["y"], "h", "id", quotas)
    want = [r["id"] for y, n in ((1, 400), (-1, 1999)) for r in df.where(F.col("y") == y).orderBy("h", "id").limit(n).collect()]
    assert set(got.columns) == set(df.columns) and sorted(r["id"] for r in got.collect()) == sorted(want)
    assert "row_number" not in got._jdf.queryExecution().optimizedPlan().toString()
    none = take_per_group(df.limit(0), ["y"], "h", "id", quotas)
    whole = take_per_group(df, ["y"], "h", "id", quotas.withColumn("quota", F.lit(5000).cast("long")))
    assert none.count() == 0 and whole.count() == 3000
    assert sum(seen[0]) == 3000 and len(seen[0]) > 1 and max(seen[0]) < 2000


def test_stored_counts_replace_the_count_before_a_join(spark, tmp_path, monkeypatch):
    """predict and project_rows over an artefact read its cells once, and hot keys are spread by the stored counts."""
    from widemargin.functions import skew
    monkeypatch.setattr(skew, "ROWS_PER_SLICE", 50)
    cells = spark.range(900).select(F.col("id").alias("row_id"), F.when(F.col("id") < 600, 3).otherwise(F.col("id") % 30).cast("long").alias("feature_id"),
                                    (F.col("id") % 7 - 3).cast("double").alias("value"))
    path = artifacts.write_artifact(cells, str(tmp_path / "cells"), feature_buckets=4, count_keys=("feature_id", "row_id"))
    stored, hot = artifacts.read_artifact(spark, path), artifacts.hot_of(spark, path, "feature_id")
    assert rows(hot, "feature_id", "slices") == [(3, 13)] and artifacts.hot_of(spark, path, "row_id").count() == 0
    assert artifacts.key_counts(spark, path, "feature_id").agg(F.sum("n_rows")).first()[0] == 900
    weights = spark.range(30).select(F.col("id").alias("feature_id"), (F.col("id") - 9).cast("double").alias("weight"))
    pool_w = weights.withColumn("col_id", F.lit("a")).unionByName(weights.where("feature_id < 9").withColumn("col_id", F.lit("b")))
    labels = spark.range(901).select(F.col("id").alias("row_id"))
    for got, want, names in (
            (M.scores(labels, stored, weights, 0.5, hot), M.scores(labels, cells, weights, 0.5), ("row_id", "score")),
            (C.project_rows(stored, pool_w, hot), C.project_rows(cells, pool_w), ("row_id", "col_id", "z")),
            (C.combine_columns(pool_w, spark.createDataFrame([("a", 2.0)], "col_id string, coef double"), hot.limit(0).withColumnRenamed("feature_id", "col_id")),
             weights.select("feature_id", (2 * F.col("weight")).alias("weight")), ("feature_id", "weight"))):
        assert rows(got, *names) == rows(want, *names)
    for got in (M.scores(labels, stored, weights, 0.5, hot), C.project_rows(stored, pool_w, hot)):
        leaves = got._jdf.queryExecution().optimizedPlan().collectLeaves().mkString("|")
        assert sum("value#" in leaf for leaf in leaves.split("|")) == 1
        assert sum("Relation" in leaf and "n_rows#" not in leaf for leaf in leaves.split("|")) == 1


def test_lengths_of_columns_come_with_their_counts(spark, monkeypatch):
    from widemargin.functions import skew
    monkeypatch.setattr(skew, "ROWS_PER_SLICE", 20)
    _, w = pool_of(spark, [("wide", k, 2.0) for k in range(100)] + [("thin", 1, 3.0), ("zero", 4, 1e-12)])
    got = {(r["col_id"], r["feature_id"]): r["weight"] for r in C.normalize_columns(w).collect()}
    assert len(got) == 102 and got["wide", 7] == pytest.approx(0.1) and got["thin", 1] == 1.0 and got["zero", 4] == pytest.approx(1e-12, rel=1e-3)


def test_split_keeps_class_shares(spark):
    labels = spark.range(1000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 4 == 0, 1).otherwise(-1).alias("y"))
    parts = {(r["y"], r["part"]): r["count"] for r in B.stratified_split(labels, 2).groupBy("y", "part").count().collect()}
    assert parts == {(1, "test"): 50, (1, "train"): 200, (-1, "test"): 150, (-1, "train"): 600}


def test_feature_groups(spark):
    features = spark.range(103).select(F.col("id").alias("feature_id"))
    disjoint = B.disjoint_feature_groups(features, 103, 10, 3)
    assert disjoint.count() == 103 == disjoint.select("feature_id").distinct().count()
    sizes = [r["count"] for r in disjoint.groupBy("model_id").count().collect()]
    assert len(sizes) == 10 and set(sizes) <= {10, 11}
    overlap = B.overlapping_feature_groups(features, 103, 20, 15, 3)
    assert {r["count"] for r in overlap.distinct().groupBy("model_id").count().collect()} == {15}
    assert rows(overlap, "model_id", "feature_id") == rows(B.overlapping_feature_groups(features, 103, 20, 15, 3), "model_id", "feature_id")


def pool_of(spark, weights, kinds=None):
    names = sorted({c for c, _, _ in weights} | set(kinds or {}))
    pool = spark.createDataFrame([(n, (kinds or {}).get(n, "point"), "test", 0, 0.0) for n in names], C.POOL_SCHEMA)
    return pool, spark.createDataFrame(weights, C.POOL_W_SCHEMA) if weights else spark.createDataFrame([], C.POOL_W_SCHEMA)


def test_equal_columns_are_found_whatever_the_row_order(spark):
    pool, w = pool_of(spark, [("a", 1, 0.5), ("a", 2, -1.0), ("b", 2, -1.0), ("b", 1, 0.5), ("c", 1, 0.5), ("c", 2, 1.0)],
                      {"z1": "point", "z2": "point"})
    assert rows(C.dedupe_columns(pool, w), "col_id", "kept") == [("a", "a"), ("b", "a"), ("c", "c"), ("z1", "z1"), ("z2", "z1")]
    merged, merged_w = C.merge_pool(*[d.where("col_id in ('a', 'z1')") for d in (pool, w)],
                                    *[d.where("col_id not in ('a', 'z1')") for d in (pool, w)])
    assert rows(merged, "col_id") == [("a",), ("c",), ("z1",)] and merged_w.count() == 4


def test_keyed_ids_repeat(spark):
    pool, w = pool_of(spark, [("a", 1, 0.5), ("b", 1, 2.0)])
    first, second = C.key_pool(pool, w), C.key_pool(pool.orderBy(F.col("col_id").desc()), w.orderBy(F.col("weight").desc()))
    assert rows(first[0], "col_id") == rows(second[0], "col_id") and first[0].count() == 2


def test_empty_pool(spark):
    pool, w = C.empty_pool(spark)
    assert C.stack_pool([], spark).count() == 0
    assert C.existing_pairs(w).count() == 0 and C.column_norms(w).count() == 0
    fresh, fresh_w = C.unit_columns(spark.createDataFrame([(4, -1)], "feature_id long, sign int"))
    merged, merged_w = C.merge_pool(pool, w, fresh, fresh_w)
    assert rows(merged, "col_id") == [("p_m4",)] and rows(merged_w, "feature_id", "weight") == [(4, -1.0)]


def test_gram_needs_no_pairs(spark):
    _, w = pool_of(spark, [("a", 1, 2.0), ("a", 2, 1.0), ("b", 2, 3.0), ("c", 5, 1.0)])
    assert rows(C.gram_matrix(w), "k1", "k2", "dot") == [("a", "a", 5.0), ("a", "b", 3.0), ("b", "b", 9.0), ("c", "c", 1.0)]


def test_screening_ties_bans_and_limits(spark):
    matrix = spark.createDataFrame([(0, 1, 2.0), (1, 2, 2.0), (2, 3, -5.0)], "row_id long, feature_id long, value double")
    weights = spark.createDataFrame([(0, 1.0), (1, 1.0), (2, 1.0)], "row_id long, v double")
    got = [tuple(r) for r in S.screen_features(matrix, weights, k_max=99).collect()]
    # equal severities fall back to the feature order; more room than violations is fine
    assert got == [(3, 1, -1, 5.0), (1, -1, 1, 2.0), (2, -1, 1, 2.0)]
    banned = spark.createDataFrame([(1, -1), (3, -1)], "feature_id long, sign int")
    assert rows(S.screen_features(matrix, weights, already=banned), "feature_id") == [(2,), (3,)]
    whole = banned.select("feature_id")
    assert rows(S.screen_features(matrix, weights, already=whole), "feature_id") == [(2,)]


def test_planted_feature_is_screened_first(spark):
    matrix = spark.range(200).select(F.col("id").alias("row_id"), F.explode(F.array(
        F.struct(F.lit(0).cast("long").alias("feature_id"), F.lit(0.1).alias("value")),
        F.struct(F.lit(9).cast("long").alias("feature_id"), F.when(F.col("id") < 100, 1.0).otherwise(-1.0).alias("value"))
    )).alias("c")).select("row_id", "c.*")
    y = spark.range(200).select(F.col("id").alias("row_id"), F.when(F.col("id") < 100, 1.0).otherwise(-1.0).alias("v"))
    top = S.screen_features(matrix, y, k_max=1).first()
    assert top["feature_id"] == 9 and top["sign_descent"] == 1


def test_rays(spark):
    w = spark.createDataFrame([(1, 0.4), (2, -0.9)], "feature_id long, weight double")
    assert S.rays_from_large_weights(w).count() == 0
    w = spark.createDataFrame([(1, 4.0), (2, -9.0), (3, 5.0)], "feature_id long, weight double")
    assert [(r["feature_id"], r["sign"]) for r in S.rays_from_large_weights(w).collect()] == [(2, -1), (3, 1)]
    assert rows(S.rays_from_box_hits(w, 5.0), "feature_id") == [(2,), (3,)]


def test_history_rules(spark):
    records = [("r", i, "a", "point", 0.0, None) for i in range(4)] + [("r", i, "b", "point", 0.0 if i else None, None) for i in range(3)]
    records += [("r", i, "c", "ray", 0.5, None) for i in range(4)]
    history = spark.createDataFrame(records, "run_id string, iter int, col_id string, kind string, coef double, event string")
    assert rows(H.idle_columns(history, 3, 1e-6), "col_id") == [("a",)]
    assert rows(H.idle_columns(history, 2, 1e-6), "col_id") == [("a",), ("b",)]
    runs = spark.createDataFrame([("x", 0, 5.0, 1.0), ("x", 1, 4.0, 4.0), ("y", 0, None, None), ("z", 0, 3.0, None), ("z", 1, 3.5, None)],
                                 "run_id string, iter int, ub double, lb double")
    assert rows(H.first_stop(runs, 1e-6, 10), "run_id", "iter", "status") == [("x", 1, "optimo_gap"), ("y", 0, "MASTER_FAILURE")]
    assert [r["alert"] for r in H.convergence_series(runs).where("run_id = 'z'").orderBy("iter").collect()] == [False, True]


def test_metrics_edges(spark):
    labels = spark.createDataFrame([(1, 1), (2, -1), (3, -1)], "row_id long, y int")
    none = spark.createDataFrame([], "row_id long, feature_id long, value double")
    w = spark.createDataFrame([(1, 1.0)], "feature_id long, weight double")
    scored = M.scores(labels, none, w, 0.0)
    assert {r["pred"] for r in M.predict(scored).collect()} == {0}
    report = {r["label"]: r for r in M.classification_report(M.predict(scored, zero_as=-1)).collect()}
    # class 1 is never predicted
    assert report["1"]["precision"] == 0.0 and report["1"]["recall"] == 0.0 and report["-1"]["recall"] == 1.0
    empty_w = spark.createDataFrame([], "feature_id long, weight double")
    assert M.objective(empty_w, M.margins_slacks(scored), 1.0).first()["obj_val"] == 3.0
    assert M.model_sparsity(empty_w, 10).first()["share_small"] == 1.0


def test_dual_bound_of_one_class_is_zero(spark):
    matrix = spark.createDataFrame([(1, 1, 1.0)], "row_id long, feature_id long, value double")
    duals = spark.createDataFrame([(1, 1, 0.0, 1.0), (2, 1, 0.0, 1.0)], "row_id long, y int, margin double, pi double")
    out = D.dual_bound(matrix, duals).first()
    assert out["lb_conic"] == 0.0 and not out["feasible"]


def test_combination_feasibility_of_rays(spark):
    theta = spark.createDataFrame([("a", "point", 1.0), ("r", "ray", -1.0)], "col_id string, kind string, coef double")
    assert not any(r["feasible"] for r in D.combination_feasibility(theta).collect())


def test_csv_scan_keeps_the_word_na(spark, tmp_path):
    path = tmp_path / "texts.csv"
    path.write_text('id,gender,clean_data,clase,n_words\n1,F,NA,1,1\n2,,"two ""quoted""\nlines",0,2\n3,M,,1,0\n', encoding="utf-8")
    df = A.read_text_table(spark, str(path))
    assert rows(A.fill_missing_text(df), "id", "clean_data") == [(1, "NA"), (2, 'two "quoted"\nlines'), (3, "")]
    assert df.where("gender is null").count() == 1
    assert A.filter_ids(df, "id", [1, 3]).count() == 2
    assert A.filter_ids(df, "id", list(range(5000))).count() == 3


def test_experiment_tables(spark, tmp_path):
    grid = X.with_filename(X.experiment_grid(X.axes_frame(spark, tipo=["convexo", "conico"], pricing=["caja"], tolerance=[1e-6], M_box=[1e4, None])))
    assert grid.count() == 4 and grid.select("filename").distinct().count() == 4
    done = grid.where("tipo = 'convexo'").limit(1).select(
        "filename", F.lit(1.5).alias("final_obj"), F.lit("optimo").alias("status"))
    assert X.skip_finished_runs(grid, done, ["filename"]).count() == 3
    states = [r["status"] for r in X.finished_summaries(grid, done, ["filename"], ["final_obj", "status"]).collect()]
    assert sorted(states) == ["PENDING", "PENDING", "PENDING", "optimo"]
    path = X.append_run_summary(done, str(tmp_path / "runs"))
    X.append_run_summary(done, path)
    report = X.summary_report(spark.read.parquet(path))
    assert report.count() == 2 and "tipo" in report.first()["missing_columns"]


def test_state_round_trip(spark, tmp_path):
    pool, w = pool_of(spark, [("a", 1, 0.5)])
    base = artifacts.pool_checkpoint({"pool": pool, "pool_w": w}, str(tmp_path), "r", 3)
    back = artifacts.pool_restore(spark, base, ("pool", "pool_w"))
    assert rows(back["pool_w"], "col_id", "weight") == [("a", 0.5)]


def test_validation_raises(spark):
    _, w = pool_of(spark, [("a", 1, 0.5), ("a", 99, 1.0)])
    with pytest.raises(ValueError):
        B.require_valid(w, spark.createDataFrame([(1,)], "feature_id long"))


def test_gram_in_blocks_of_columns(spark, monkeypatch):
    """More columns than a block holds, and than a driver matrix would, against plain products."""
    rng = np.random.default_rng(4)
    dense = np.where(rng.random((37, 60)) < 0.3, rng.integers(-3, 4, (37, 60)), 0).astype(float)
    cells = [(f"c{k:02d}", j, float(v)) for k, row in enumerate(dense) for j, v in enumerate(row) if v]
    w = spark.createDataFrame(cells, "col_id string, feature_id long, weight double")
    monkeypatch.setattr(C, "_GRAM_BLOCK", 8)
    monkeypatch.setattr(C, "_GRAM_ROWS", 5)
    want = {(f"c{a:02d}", f"c{b:02d}"): x for a in range(37) for b in range(a, 37) if (x := float(dense[a] @ dense[b]))}
    assert {(r["k1"], r["k2"]): r["dot"] for r in C.gram_matrix(w).collect()} == want
    names = [f"c{k:02d}" for k in range(0, 37, 2)]
    some = {k: v for k, v in want.items() if k[0] in names and k[1] in names}
    assert {(r["k1"], r["k2"]): r["dot"] for r in C.gram_matrix(w, names).collect()} == some


def test_gram_of_many_unit_columns(spark):
    w = spark.range(5000).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("col_id"), (F.col("id") % 2500).alias("feature_id"),
                                 (F.col("id") % 7 + 1).cast("double").alias("weight"))
    got = C.gram_matrix(w)
    assert got.count() == 7500 and got.where("k1 <> k2").count() == 2500


def test_grid_runner(spark, tmp_path):
    """A second call runs nothing, a failing run leaves an ERROR row, another session's claim is respected."""
    import threading
    import time

    grid = X.with_filename(X.experiment_grid(X.axes_frame(spark, tipo=["a", "b", "bad"], tolerance=[0.1, 0.2])))
    calls, together = [], threading.Barrier(2, timeout=60)

    def run(row):
        calls.append(row["filename"])
        if row["tipo"] == "a":
            together.wait()  # both runs of a are under way at the same time
        if row["tipo"] == "bad":
            raise RuntimeError("boom")
        return {"final_obj": row["tolerance"], "iterations": 3, "status": "optimo"}

    names = sorted(r["filename"] for r in grid.collect())
    other = [n for n in names if "__b__" in n][0]
    claims = spark.createDataFrame([(other, "another", time.time() - 10)], X.CLAIM_SCHEMA)
    claims.write.parquet(f"{tmp_path}/claims/other")
    first = {r["filename"]: r for r in X.run_grid(grid, run, str(tmp_path)).collect()}
    assert sorted(calls) == sorted(first) == [n for n in names if n != other]
    assert {r["status"] for n, r in first.items() if "bad" in n} == {"ERROR"} and "boom" in first[[n for n in first if "bad" in n][0]]["error_msg"]
    assert {r["final_obj"] for n, r in first.items() if "__a__" in n} == {0.1, 0.2}
    calls.clear()
    assert X.run_grid(grid, run, str(tmp_path)).count() == 5 and not calls
    # the other session's claim has grown old; errors are tried again only when asked
    X.run_grid(grid, run, str(tmp_path), stale_seconds=1.0)
    assert calls == [other]
    calls.clear()
    assert X.run_grid(grid, lambda r: {"final_obj": 1, "iterations": 1, "status": "optimo"}, str(tmp_path), retry_errors=True).where("status = 'ERROR'").count() == 0
    assert X.run_summary(*[spark.createDataFrame([], s) for s in ("run_id string, status string, error_msg string", "run_id string, iter int, ub double, lb double")]).count() == 0
