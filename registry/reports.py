"""Queries: histories, stopping rules, predictions, metrics, experiment tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.base import (HISTORY_CTE, ITERATIONS_CTE, ORDER_CTES, VECTOR_CTES, clean_vector_pool, combined_weights, counted,
                           event_history, order_iterations, order_labels, order_matrix, pool_theta, query, rounded,
                           supplier_features, table, vector_features, vector_labels, vector_matrix)
from widemargin.operators import history as H, metrics as M
from widemargin.plans import experiments as X

BIAS = 0.05
PERIODS, IDLE_BELOW = 3, 0.012


# ---------------------------------------------------------------- history
@query("prune_idle_columns", f"""WITH {HISTORY_CTE},
r AS (SELECT *, row_number() OVER (PARTITION BY run_id, col_id ORDER BY iter DESC) AS rn FROM hist WHERE event IS NULL),
idle AS (SELECT col_id FROM r WHERE rn <= {PERIODS} GROUP BY run_id, col_id
         HAVING count(*) = {PERIODS} AND count(coef) = {PERIODS} AND max(abs(coef)) < {IDLE_BELOW})
SELECT col_id, col_id IN (SELECT col_id FROM idle) AS removed,
       CASE WHEN col_id IN (SELECT col_id FROM idle) THEN 0 ELSE count(coef) END AS n_weights FROM hist GROUP BY col_id""")
def _(spark, sf_dir):
    history = event_history(spark, sf_dir)
    pool = history.select("col_id", "kind").distinct()
    pool_w = history.where("coef IS NOT NULL").select("col_id", F.col("iter").alias("feature_id"), F.col("coef").alias("weight"))
    kept, kept_w, removed = H.prune_idle_columns(pool, pool_w, history, PERIODS, IDLE_BELOW)
    sizes = kept_w.groupBy("col_id").agg(F.count(F.lit(1)).alias("n"))
    return (kept.withColumn("removed", F.lit(False)).unionByName(removed.withColumn("removed", F.lit(True)))
            .join(sizes, "col_id", "left").select("col_id", "removed", F.coalesce("n", F.lit(0)).alias("n_weights")))


@query("record_coefficients", f"""WITH {VECTOR_CTES}
SELECT 'demo' AS run_id, 4 AS iter, col_id, kind, round(coef, 6) + 0.0 AS coef, NULL AS event FROM theta
UNION ALL SELECT 'demo', 4, col_id, kind, NULL, 'removed' FROM theta WHERE coef = 0""")
def _(spark, sf_dir):
    pool, _ = clean_vector_pool(spark, sf_dir)
    theta = pool_theta(pool)
    gone = theta.where(F.col("coef") == 0).select("col_id", "kind")
    return rounded(H.record_coefficients(theta, "demo", 4, gone), "coef")


STOP = f"""chg AS (SELECT *, abs(ub - lag(ub) OVER (PARTITION BY run_id ORDER BY iter)) AS change FROM iters),
ruled AS (SELECT run_id, iter, ub, lb, CASE
  WHEN ub IS NULL THEN 'MASTER_FAILURE'
  WHEN iter > 0 AND abs(ub - lb) <= 1e-6 THEN 'optimo_gap'
  WHEN iter >= 2 AND change <= 1e-6 THEN 'optimo'
  WHEN iter >= 12 THEN 'max_iter' END AS stop FROM chg)"""


@query("stop_rules", f"""WITH {ITERATIONS_CTE}, {STOP}
SELECT run_id, iter, stop AS status FROM
  (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY iter) AS rn FROM ruled WHERE stop IS NOT NULL) WHERE rn = 1""")
def _(spark, sf_dir):
    return H.first_stop(order_iterations(spark, sf_dir), 1e-6, 12)


@query("tolerance_schedule", f"""WITH {ITERATIONS_CTE},
m AS (SELECT run_id, iter, CASE WHEN c > 1e-1 THEN 'coarse' WHEN c > 1e-3 THEN 'medium' WHEN c IS NOT NULL THEN 'fine' END AS mode
  FROM (SELECT run_id, iter, abs(lag(ub) OVER (PARTITION BY run_id ORDER BY iter) - ub) AS c FROM iters))
SELECT run_id, iter, mode,
  (CASE mode WHEN 'coarse' THEN 1 WHEN 'medium' THEN 0.1 WHEN 'fine' THEN 0.01 END)::DOUBLE AS tol_e5,
  (CASE mode WHEN 'medium' THEN 1.1 WHEN 'fine' THEN 1.5 ELSE 1.0 END)::DOUBLE AS window_factor,
  coalesce(mode = 'fine', false) AS drop_box FROM m""")
def _(spark, sf_dir):
    out = H.tolerance_schedule(order_iterations(spark, sf_dir))
    return rounded(out.withColumn("tol_e5", F.col("tol") * 1e5).drop("tol"), "tol_e5")


@query("convergence_series", f"""WITH {ITERATIONS_CTE},
p AS (SELECT *, lag(ub) OVER (PARTITION BY run_id ORDER BY iter) AS prev FROM iters)
SELECT run_id, iter, round(ub, 4) AS ub, round(lb, 4) AS lb, round(ub - lb, 4) + 0.0 AS gap,
       round(prev - ub, 4) + 0.0 AS improvement, coalesce(ub > prev + 1e-6, false) AS alert FROM p""")
def _(spark, sf_dir):
    return rounded(H.convergence_series(order_iterations(spark, sf_dir)), "ub", "lb", "gap", "improvement", digits=4)


@query("theta_stats", f"""WITH {HISTORY_CTE},
last AS (SELECT run_id, coef FROM (SELECT *, row_number() OVER (PARTITION BY run_id, col_id ORDER BY iter DESC) AS rn
                                   FROM hist WHERE event IS NULL) WHERE rn = 1)
SELECT run_id, count(coef) AS theta_last_active, count(*) FILTER (abs(coef) > 1e-12) AS theta_last_nonzero,
       round(max(coef), 6) AS theta_last_max, round(min(coef), 6) AS theta_last_min FROM last GROUP BY run_id""")
def _(spark, sf_dir):
    return rounded(H.theta_stats(event_history(spark, sf_dir)), "theta_last_max", "theta_last_min")


def _pivot(expr):
    cells = ", ".join(f"round(max(CASE WHEN iter = {i} AND event IS NULL THEN {expr} END), 6) + 0.0 AS it_{i}" for i in range(12))
    return (f"SELECT run_id, col_id, {cells}, max(CASE WHEN event = 'removed' THEN 1 ELSE 0 END) AS removed "
            "FROM hist GROUP BY run_id, col_id")


@query("theta_matrix", f"WITH {HISTORY_CTE} {_pivot('coef')}")
def _(spark, sf_dir):
    out = H.theta_matrix(event_history(spark, sf_dir), list(range(12)))
    return rounded(out, *[f"it_{i}" for i in range(12)])


@query("theta_log_matrix", f"WITH {HISTORY_CTE} {_pivot('CASE WHEN coef IS NOT NULL THEN log10(greatest(abs(coef), 1e-10)) END')}")
def _(spark, sf_dir):
    out = H.theta_log_matrix(event_history(spark, sf_dir), list(range(12)))
    return rounded(out, *[f"it_{i}" for i in range(12)])


# ---------------------------------------------------------------- scoring
SCORED = f"""sc AS (SELECT ey.row_id, y, coalesce(s, 0) + {BIAS}::DOUBLE AS score FROM ey
  LEFT JOIN (SELECT row_id, sum(value * weight) AS s FROM em JOIN w USING (feature_id) GROUP BY row_id) x ON x.row_id = ey.row_id),
pr AS (SELECT *, CASE WHEN score > 0 THEN 1 WHEN score < 0 THEN -1 ELSE 0 END AS pred,
              y * score AS margin, greatest(0.0, 1.0 - y * score) AS xi FROM sc)"""
VECTOR_SCORED = f"{VECTOR_CTES}, {SCORED}"


def vector_scores(spark, sf_dir):
    weights = combined_weights(spark, sf_dir)
    matrix, hot = counted(vector_matrix(spark, sf_dir), "matrix", "feature_id")
    return M.scores(vector_labels(spark, sf_dir), matrix, weights, BIAS, hot), weights


# orders scored by a supplier weight; an order without a line scores exactly the bias 0
ORDER_SCORED = f"""{ORDER_CTES},
ow AS (SELECT feature_id, (feature_id % 7 - 3)::DOUBLE AS weight FROM feats WHERE feature_id % 7 <> 3),
osc AS (SELECT oy.row_id, y, coalesce(s, 0.0) AS score FROM oy
  LEFT JOIN (SELECT row_id, sum(value * weight) AS s FROM om JOIN ow USING (feature_id) GROUP BY row_id) x ON x.row_id = oy.row_id),
opr AS (SELECT *, CASE WHEN score > 0 THEN 1 WHEN score < 0 THEN -1 ELSE 0 END AS pred FROM osc)"""


def order_scores(spark, sf_dir):
    weights = (supplier_features(spark, sf_dir).where(F.col("feature_id") % 7 != 3)
               .select("feature_id", (F.col("feature_id") % 7 - 3).cast("double").alias("weight")))
    matrix, hot = counted(order_matrix(spark, sf_dir), "matrix", "feature_id")
    return M.scores(order_labels(spark, sf_dir), matrix, weights, 0.0, hot)


@query("predict", f"WITH {ORDER_SCORED} SELECT row_id, y, round(score, 6) + 0.0 AS score, pred, CASE WHEN pred = 0 THEN -1 ELSE pred END AS pred_zero_as FROM opr")
def _(spark, sf_dir):
    scored = order_scores(spark, sf_dir)
    both = M.predict(M.predict(scored, zero_as=-1).withColumnRenamed("pred", "pred_zero_as"))
    return rounded(both, "score")


@query("margins_slacks", f"WITH {VECTOR_SCORED} SELECT row_id, y, round(margin, 6) + 0.0 AS margin, round(xi, 6) + 0.0 AS xi FROM pr")
def _(spark, sf_dir):
    scored, _ = vector_scores(spark, sf_dir)
    return rounded(M.margins_slacks(scored).select("row_id", "y", "margin", "xi"), "margin", "xi")


@query("objective", f"""WITH {VECTOR_SCORED}, nw AS (SELECT sqrt(sum(weight * weight)) AS norm_w FROM w),
sx AS (SELECT sum(xi) AS sum_xi FROM pr)
SELECT round(norm_w, 6) AS norm_w, round(sum_xi, 6) AS sum_xi, round(norm_w + 2.0 * sum_xi, 6) AS obj_val FROM nw, sx""")
def _(spark, sf_dir):
    scored, weights = vector_scores(spark, sf_dir)
    return rounded(M.objective(weights, M.margins_slacks(scored), 2.0), "norm_w", "sum_xi", "obj_val")


@query("accuracy", f"WITH {VECTOR_SCORED} SELECT round(avg((y = pred)::INT), 6) AS accuracy FROM pr")
def _(spark, sf_dir):
    scored, _ = vector_scores(spark, sf_dir)
    return rounded(M.accuracy(M.predict(scored)), "accuracy")


def report_sql(source):
    return f"""labs AS (SELECT y AS label FROM {source} UNION SELECT pred FROM {source}),
pc AS (SELECT label, (SELECT count(*) FROM {source} WHERE y = label) AS support,
              (SELECT count(*) FROM {source} WHERE pred = label) AS said,
              (SELECT count(*) FROM {source} WHERE y = label AND pred = label) AS hit FROM labs),
pm AS (SELECT label::VARCHAR AS label, CASE WHEN said = 0 THEN 0.0 ELSE hit / said::DOUBLE END AS "precision",
              CASE WHEN support = 0 THEN 0.0 ELSE hit / support::DOUBLE END AS recall,
              CASE WHEN said + support = 0 THEN 0.0 ELSE 2 * hit / (said + support)::DOUBLE END AS f1, support FROM pc),
rep AS (SELECT * FROM pm UNION ALL
  SELECT 'macro avg', avg("precision"), avg(recall), avg(f1), sum(support) FROM pm UNION ALL
  SELECT 'weighted avg', sum("precision" * support) / sum(support), sum(recall * support) / sum(support),
         sum(f1 * support) / sum(support), sum(support) FROM pm)"""


REPORT_OUT = ('SELECT label, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1, '
              "support::BIGINT AS support FROM rep")


@query("classification_report", f"WITH {ORDER_SCORED}, {report_sql('opr')} {REPORT_OUT}")
def _(spark, sf_dir):
    return rounded(M.classification_report(M.predict(order_scores(spark, sf_dir))), "precision", "recall", "f1")


ROLE_CASE = """CASE WHEN length(text) % 5 = 0 THEN 'assistant' WHEN length(text) % 5 = 1 THEN 'tool' ELSE 'user' END"""


@query("classification_report_multiclass", f"""WITH rp AS (SELECT role AS y, {ROLE_CASE} AS pred FROM conversations), {report_sql('rp')} {REPORT_OUT}""")
def _(spark, sf_dir):
    size = F.length("text") % 5
    pairs = table(spark, sf_dir, "conversations").select(
        F.col("role").alias("y"), F.when(size == 0, "assistant").when(size == 1, "tool").otherwise("user").alias("pred"))
    return rounded(M.classification_report(pairs), "precision", "recall", "f1")


@query("fit_summary", f"""WITH {VECTOR_SCORED}, {report_sql('pr')}
SELECT (SELECT round(avg((y = pred)::INT), 6) FROM pr) AS accuracy,
  (SELECT round(f1, 6) FROM rep WHERE label = 'macro avg') AS f1_macro,
  (SELECT round(f1, 6) FROM rep WHERE label = 'weighted avg') AS f1_weighted,
  round(norm_w, 6) AS norm_w, round(sum_xi, 6) AS sum_xi, positive_slacks, round(norm_w + sum_xi, 6) AS obj_val
FROM (SELECT sqrt(sum(weight * weight)) AS norm_w FROM w),
     (SELECT sum(xi) AS sum_xi, count(*) FILTER (xi > 1e-6) AS positive_slacks FROM pr)""")
def _(spark, sf_dir):
    scored, weights = vector_scores(spark, sf_dir)
    out = M.fit_summary(M.predict(scored), weights, M.margins_slacks(scored))
    return rounded(out, "accuracy", "f1_macro", "f1_weighted", "norm_w", "sum_xi", "obj_val")


@query("model_sparsity", f"""WITH {VECTOR_CTES}, nf AS (SELECT count(DISTINCT feature_id) AS n FROM em)
SELECT n AS n_features, n - large AS n_small, round((n - large) / n::DOUBLE, 6) AS share_small
FROM nf, (SELECT count(*) FILTER (abs(weight) >= 0.02) AS large FROM w)""")
def _(spark, sf_dir):
    n = vector_features(spark, sf_dir).count()
    return rounded(M.model_sparsity(combined_weights(spark, sf_dir), n, 0.02), "share_small")


@query("coefficient_bands", f"""WITH {VECTOR_CTES}, nf AS (SELECT count(DISTINCT feature_id) AS n FROM em)
SELECT n - count(*) FILTER (abs(weight) >= 1e-2) AS below_1e_2, n - count(*) FILTER (abs(weight) >= 1e-4) AS below_1e_4,
       n - count(*) FILTER (abs(weight) >= 1e-6) AS below_1e_6, n - count(*) FILTER (abs(weight) >= 1e-8) AS below_1e_8,
       n - count(*) FILTER (weight <> 0) AS exact_0, count(*) FILTER (weight > 0) AS over_0,
       count(*) FILTER (weight < 0) AS under_0 FROM w, nf GROUP BY n""")
def _(spark, sf_dir):
    n = vector_features(spark, sf_dir).count()
    return M.coefficient_bands(combined_weights(spark, sf_dir), n)


# ---------------------------------------------------------------- experiments
def _axes(spark, sf_dir):
    """Axis values found in the tables: order states, priorities, discounts and taxes (all short value lists)."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    one = F.lit(1).alias("_one")
    left = orders.agg(F.collect_set("o_orderstatus").alias("tipo"), F.collect_set("o_orderpriority").alias("pricing"))
    right = lines.agg(F.collect_set("l_discount").alias("tolerance"), F.collect_set("l_tax").alias("M_box"))
    return left.withColumn("_one", one).join(right.withColumn("_one", one), "_one").drop("_one")


GRID = """grid AS (SELECT tipo, pricing, tolerance, "M_box" FROM (SELECT DISTINCT o_orderstatus AS tipo FROM orders),
  (SELECT DISTINCT o_orderpriority AS pricing FROM orders), (SELECT DISTINCT l_discount AS tolerance FROM lineitem),
  (SELECT DISTINCT l_tax AS "M_box" FROM lineitem))"""
FINISHED = """done AS (SELECT o_orderstatus AS tipo, o_orderpriority AS pricing, l_discount AS tolerance, l_tax AS "M_box",
  round(min(o_totalprice), 4) AS final_obj, CASE WHEN min(o_totalprice) > 60000 THEN 'optimo' END AS status
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity >= 40 GROUP BY 1, 2, 3, 4)"""
KEYS = ["tipo", "pricing", "tolerance", "M_box"]


def _finished(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_quantity") >= 40)
    price = F.min("o_totalprice")
    return (table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
            .groupBy(F.col("o_orderstatus").alias("tipo"), F.col("o_orderpriority").alias("pricing"),
                     F.col("l_discount").alias("tolerance"), F.col("l_tax").alias("M_box"))
            .agg(F.round(price, 4).alias("final_obj"), F.when(price > 60000, F.lit("optimo")).alias("status")))


@query("experiment_grid", f"""WITH {GRID} SELECT tipo, pricing, tolerance, "M_box" FROM grid""")
def _(spark, sf_dir):
    return X.experiment_grid(_axes(spark, sf_dir))


@query("skip_finished_runs", f"""WITH {GRID}, {FINISHED} SELECT tipo, pricing, tolerance, "M_box" FROM grid g
WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.tipo = g.tipo AND d.pricing = g.pricing AND d.tolerance = g.tolerance AND d."M_box" = g."M_box")""")
def _(spark, sf_dir):
    return X.skip_finished_runs(X.experiment_grid(_axes(spark, sf_dir)), _finished(spark, sf_dir), KEYS)


@query("finished_summaries", f"""WITH {GRID}, {FINISHED}
SELECT g.tipo, g.pricing, g.tolerance, g."M_box", final_obj,
       coalesce(status, CASE WHEN d.tipo IS NOT NULL THEN 'LOADED' ELSE 'PENDING' END) AS status
FROM grid g LEFT JOIN done d ON d.tipo = g.tipo AND d.pricing = g.pricing AND d.tolerance = g.tolerance AND d."M_box" = g."M_box" """)
def _(spark, sf_dir):
    grid = X.experiment_grid(_axes(spark, sf_dir))
    return X.finished_summaries(grid, _finished(spark, sf_dir), KEYS, ["final_obj", "status"])


# the same over all lines: a run counts as stored when its lines are large on average
STORED = """done AS (SELECT o_orderstatus AS tipo, o_orderpriority AS pricing, l_discount AS tolerance, l_tax AS "M_box",
  round(min(o_totalprice), 4) AS final_obj, CASE WHEN min(o_totalprice) > 1500 THEN 'optimo' END AS status
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2, 3, 4 HAVING avg(l_quantity) >= 25.5)"""


def _stored(spark, sf_dir):
    price = F.min("o_totalprice")
    return (table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
            .groupBy(F.col("o_orderstatus").alias("tipo"), F.col("o_orderpriority").alias("pricing"),
                     F.col("l_discount").alias("tolerance"), F.col("l_tax").alias("M_box"))
            .agg(F.round(price, 4).alias("final_obj"), F.when(price > 1500, F.lit("optimo")).alias("status"), F.avg("l_quantity").alias("_mean"))
            .where("_mean >= 25.5").drop("_mean"))


@query("unfinished_runs", f"""WITH {GRID}, {STORED} SELECT tipo, pricing, tolerance, "M_box" FROM grid g
WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.tipo = g.tipo AND d.pricing = g.pricing AND d.tolerance = g.tolerance AND d."M_box" = g."M_box")""")
def _(spark, sf_dir):
    return X.skip_finished_runs(X.experiment_grid(_axes(spark, sf_dir)), _stored(spark, sf_dir), KEYS)


@query("stored_summaries", f"""WITH {GRID}, {STORED}
SELECT g.tipo, g.pricing, g.tolerance, g."M_box", final_obj,
       coalesce(status, CASE WHEN d.tipo IS NOT NULL THEN 'LOADED' ELSE 'PENDING' END) AS status
FROM grid g LEFT JOIN done d ON d.tipo = g.tipo AND d.pricing = g.pricing AND d.tolerance = g.tolerance AND d."M_box" = g."M_box" """)
def _(spark, sf_dir):
    grid = X.experiment_grid(_axes(spark, sf_dir))
    return X.finished_summaries(grid, _stored(spark, sf_dir), KEYS, ["final_obj", "status"])


RUNS = f"""{ITERATIONS_CTE}, {STOP},
runs AS (SELECT o_orderkey // 16 AS run_id,
  max(CASE WHEN o_orderkey % 1000 = 0 THEN 'ERROR' ELSE 'optimo' END) FILTER (o_orderkey % 16 = 0) AS status,
  max(CASE WHEN o_orderkey % 1000 = 0 THEN 'no solution' END) AS error_msg FROM orders GROUP BY 1),
lastub AS (SELECT run_id, ub FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY iter DESC) AS rn
                                    FROM iters WHERE ub IS NOT NULL) WHERE rn = 1),
cnt AS (SELECT run_id, count(*) AS iterations, min(ub) AS best_obj FROM iters GROUP BY run_id),
summ AS (SELECT r.run_id, round(l.ub, 4) AS final_obj, round(best_obj, 4) AS best_obj,
  coalesce(iterations, 0) AS iterations, status, error_msg
  FROM runs r LEFT JOIN cnt c ON c.run_id = r.run_id LEFT JOIN lastub l ON l.run_id = r.run_id)"""


def _runs(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    return (orders.groupBy(F.floor(key / 16).cast("long").alias("run_id"))
            .agg(F.max(F.when(key % 16 == 0, F.when(key % 1000 == 0, "ERROR").otherwise("optimo"))).alias("status"),
                 F.max(F.when(key % 1000 == 0, "no solution")).alias("error_msg")))


@query("run_summary", f"WITH {RUNS} SELECT run_id, final_obj, best_obj, iterations, status, error_msg FROM summ")
def _(spark, sf_dir):
    out = X.run_summary(_runs(spark, sf_dir), order_iterations(spark, sf_dir))
    return rounded(out, "final_obj", "best_obj", digits=4)


@query("summary_report", f"""WITH {RUNS} SELECT 'run_' || run_id AS filename, final_obj, iterations, status, error_msg,
'tipo,pricing,solver,presolve,M_box' AS missing_columns FROM summ""")
def _(spark, sf_dir):
    runs = X.run_summary(_runs(spark, sf_dir), order_iterations(spark, sf_dir))
    named = runs.withColumn("filename", F.concat(F.lit("run_"), F.col("run_id").cast("string")))
    return rounded(X.summary_report(named), "final_obj", digits=4)
