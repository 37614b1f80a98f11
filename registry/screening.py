"""Queries: gradients, screening, bounds and rays."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.base import (ORDER_CTES, VECTOR_CTES, clean_vector_pool, combined_weights, order_labels, order_matrix,
                           query, rounded, vector_labels, vector_matrix)
from registry.reports import SCORED, vector_scores
from widemargin.operators import bounds as D, screening as S

EPS, COST, M_BOX = 0.5, 1.0, 10.0


def _row_weights(spark, sf_dir):
    return order_labels(spark, sf_dir).select("row_id", F.col("y").cast("double").alias("v"))


def _alpha(spark, sf_dir):
    """alpha = -w/|w| for a weight of 1/(1+j) on every second supplier."""
    from registry.base import supplier_features
    weights = (supplier_features(spark, sf_dir).where(F.col("feature_id") % 2 == 0)
               .select("feature_id", (F.lit(1.0) / (F.lit(1.0) + F.col("feature_id"))).alias("weight")))
    return D.cone_dual(weights)


ALPHA = """aw AS (SELECT feature_id, 1.0::DOUBLE / (1.0::DOUBLE + feature_id) AS weight FROM feats WHERE feature_id % 2 = 0),
al AS (SELECT feature_id, -weight / sqrt(sum(weight * weight) OVER ()) AS alpha FROM aw),
osum AS (SELECT feature_id, sum(value * y) AS s FROM om JOIN oy USING (row_id) GROUP BY feature_id),
rc AS (SELECT coalesce(a.feature_id, s.feature_id) AS feature_id, coalesce(alpha, 0) AS a, coalesce(s, 0) AS s
       FROM al a FULL JOIN osum s ON a.feature_id = s.feature_id),
viol AS (SELECT feature_id, -1 AS sign, a + s AS severity FROM rc WHERE -a - s < -1e-8
         UNION ALL SELECT feature_id, 1, -(a + s) FROM rc WHERE a + s < -1e-8),
known AS (SELECT feature_id, CASE WHEN feature_id % 3 = 0 THEN 1 ELSE -1 END AS sign FROM feats WHERE feature_id % 5 = 0),
open_viol AS (SELECT * FROM viol v WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.feature_id = v.feature_id AND k.sign = v.sign)),
hits AS (SELECT * FROM open_viol ORDER BY severity DESC, feature_id, sign LIMIT 25)"""


def _known(spark, sf_dir):
    from registry.base import supplier_features
    return (supplier_features(spark, sf_dir).where(F.col("feature_id") % 5 == 0)
            .withColumn("sign", F.when(F.col("feature_id") % 3 == 0, 1).otherwise(-1)))


@query("screen_features", f"""WITH {ORDER_CTES}, {ALPHA}
SELECT feature_id, sign, -sign AS sign_descent, round(severity, 6) AS severity FROM hits""")
def _(spark, sf_dir):
    hits = S.screen_features(order_matrix(spark, sf_dir), _row_weights(spark, sf_dir), _alpha(spark, sf_dir),
                             k_max=25, already=_known(spark, sf_dir))
    return rounded(hits, "severity")


@query("screening_summary", f"""WITH {ORDER_CTES}, {ALPHA}
SELECT sum(y)::DOUBLE AS sum_y, CASE WHEN sum(y) > 1e-8 THEN 1 WHEN sum(y) < -1e-8 THEN -1 ELSE 0 END AS b_suggest,
  (SELECT count(*) FROM open_viol WHERE sign = -1) AS n_viol1, (SELECT count(*) FROM open_viol WHERE sign = 1) AS n_viol2 FROM oy""")
def _(spark, sf_dir):
    costs = S.reduced_costs(S.weighted_feature_sums(order_matrix(spark, sf_dir), _row_weights(spark, sf_dir)),
                            _alpha(spark, sf_dir))
    return S.screening_summary(costs, _row_weights(spark, sf_dir), already=_known(spark, sf_dir))


@query("add_screened_columns", f"""WITH {ORDER_CTES}, {ALPHA}
SELECT 'p_' || CASE WHEN sign < 0 THEN 'm' ELSE 'e' END || feature_id AS col_id, feature_id, sign::DOUBLE AS weight FROM known
UNION ALL SELECT 'p_' || CASE WHEN sign < 0 THEN 'm' ELSE 'e' END || feature_id, feature_id, sign::DOUBLE FROM hits""")
def _(spark, sf_dir):
    from widemargin.operators.pool import unit_columns
    pool, pool_w = unit_columns(_known(spark, sf_dir))
    _, merged_w, _ = S.add_screened_columns(pool, pool_w, order_matrix(spark, sf_dir), _row_weights(spark, sf_dir),
                                            _alpha(spark, sf_dir), k_max=25)
    return merged_w


# the duals of the smoothed hinge at the combined centroid model
DUALS = f"""pi AS (SELECT row_id, y, margin, {COST} * least(1.0, greatest(0.0, (1.0 - margin) / {EPS})) AS pi FROM pr),
pis AS (SELECT feature_id, sum(value * y * pi) AS s FROM em JOIN pi USING (row_id) GROUP BY feature_id),
nw AS (SELECT sqrt(sum(weight * weight)) AS nw FROM w),
gr AS (SELECT coalesce(w.feature_id, pis.feature_id) AS feature_id, coalesce(-weight / nw, 0) AS alpha, coalesce(s, 0) AS s,
              coalesce(-weight / nw, 0) + coalesce(s, 0) AS grad
       FROM nw, w FULL JOIN pis ON w.feature_id = pis.feature_id)"""
DUAL_CTES = f"{VECTOR_CTES}, {SCORED}, {DUALS}"


def _duals(spark, sf_dir):
    scored, weights = vector_scores(spark, sf_dir)
    return D.hinge_duals(scored, COST, EPS), weights


def _gradient(spark, sf_dir):
    duals, weights = _duals(spark, sf_dir)
    return D.master_gradient(vector_matrix(spark, sf_dir), duals, weights)


@query("master_gradient", f"""WITH {DUAL_CTES}
SELECT feature_id, round(alpha, 6) + 0.0 AS alpha, round(s, 6) + 0.0 AS s, round(grad, 6) + 0.0 AS grad FROM gr""")
def _(spark, sf_dir):
    return rounded(_gradient(spark, sf_dir), "alpha", "s", "grad")


@query("gradient_policy", f"""WITH {DUAL_CTES},
mix AS (SELECT feature_id, 0.7 * alpha + 0.3 * grad AS g FROM gr),
nn AS (SELECT sqrt(sum(g * g)) AS n FROM mix)
SELECT feature_id, round(CASE WHEN n > 0.5 THEN g / n ELSE g END, 6) + 0.0 AS grad FROM mix, nn""")
def _(spark, sf_dir):
    full = _gradient(spark, sf_dir)
    alpha_only = D.choose_gradient(full, "alpha_only")
    mixed = D.smooth_gradient(alpha_only, D.choose_gradient(full, "full_gradient"), 0.3)
    return rounded(D.scale_gradient(mixed, above=0.5), "grad")


@query("dual_bound", f"""WITH {DUAL_CTES},
t AS (SELECT sum(pi) AS sum_pi, sum(y * pi) AS sum_ypi, max(pi) AS max_pi,
             sum(pi) FILTER (y > 0) AS p, sum(pi) FILTER (y < 0) AS q FROM pi),
rep AS (SELECT row_id, y, pi * CASE WHEN y > 0 THEN least(1, q / p) ELSE least(1, p / q) END AS pi FROM pi, t),
rs AS (SELECT feature_id, sum(value * y * pi) AS s FROM em JOIN rep USING (row_id) GROUP BY feature_id),
nr AS (SELECT sqrt(sum(s * s)) AS n FROM rs), sr AS (SELECT sum(pi) AS sp FROM rep),
bx AS (SELECT sum(abs(coalesce(gr.alpha, 0) + coalesce(rs.s, 0))) AS l1 FROM gr FULL JOIN rs USING (feature_id)),
ns AS (SELECT sqrt(sum(s * s)) AS n0 FROM pis)
SELECT round(sum_pi, 6) AS sum_pi, round(sum_ypi, 6) + 0.0 AS sum_ypi, round(max_pi, 6) AS max_pi, round(n0, 6) AS norm_xtypi,
  (n0 <= 1 + 1e-9 AND abs(sum_ypi) <= 1e-6 AND max_pi <= {COST} + 1e-9) AS feasible,
  round(sp / greatest(1, n), 6) + 0.0 AS lb_conic, round(sp - {M_BOX} * l1, 6) + 0.0 AS lb_box FROM t, nr, sr, bx, ns""")
def _(spark, sf_dir):
    duals, weights = _duals(spark, sf_dir)
    matrix = vector_matrix(spark, sf_dir)
    direction = D.choose_gradient(D.master_gradient(matrix, duals, weights), "alpha_only")
    out = D.dual_bound(matrix, duals, COST, direction, M_BOX)
    return rounded(out, "sum_pi", "sum_ypi", "max_pi", "norm_xtypi", "lb_conic", "lb_box")


@query("combination_types", f"""WITH {VECTOR_CTES},
t AS (SELECT sum(coef) AS s, min(coef) AS m FROM theta), k AS (SELECT unnest(['convexo', 'afin', 'conico', 'mayor_uno', 'libre']) AS combination)
SELECT combination, round(s, 6) AS sum_theta, round(m, 6) + 0.0 AS min_theta, CASE combination
  WHEN 'convexo' THEN abs(s - 1) <= 1e-6 AND m >= -1e-6 WHEN 'afin' THEN abs(s - 1) <= 1e-6
  WHEN 'conico' THEN m >= -1e-6 WHEN 'mayor_uno' THEN m >= -1e-6 AND s >= 1 - 1e-6 ELSE true END AS feasible FROM t, k""")
def _(spark, sf_dir):
    from registry.base import pool_theta
    pool, _ = clean_vector_pool(spark, sf_dir)
    return rounded(D.combination_feasibility(pool_theta(pool)), "sum_theta", "min_theta")


@query("box_limit", f"""WITH {VECTOR_CTES}
SELECT round(max(abs(weight)), 6) AS max_abs_w, 0.05::DOUBLE AS m_box, max(abs(weight)) <= 0.05 AS within,
       count(*) FILTER (abs(weight) > 0.05) AS n_outside FROM w""")
def _(spark, sf_dir):
    return rounded(D.box_check(combined_weights(spark, sf_dir), 0.05), "max_abs_w")


@query("rays_from_large_weights", f"""WITH {VECTOR_CTES}, big AS (SELECT feature_id, weight * 100 AS weight FROM w)
SELECT feature_id, sign(weight)::INT AS sign, round(weight, 6) AS weight FROM big, (SELECT max(abs(weight)) AS peak FROM big)
WHERE abs(weight) >= 0.5 * peak AND peak >= 1 ORDER BY abs(weight) DESC, feature_id LIMIT 50""")
def _(spark, sf_dir):
    big = combined_weights(spark, sf_dir).withColumn("weight", F.col("weight") * 100)
    return rounded(S.rays_from_large_weights(big), "weight")


@query("rays_from_box_hits", f"""WITH {VECTOR_CTES}, cl AS (SELECT feature_id, greatest(-0.01, least(0.01, weight)) AS weight FROM w)
SELECT feature_id, sign(weight)::INT AS sign, round(weight, 6) AS weight FROM cl WHERE abs(weight) >= 0.01 - 1e-4 ORDER BY feature_id LIMIT 50""")
def _(spark, sf_dir):
    clipped = combined_weights(spark, sf_dir).withColumn(
        "weight", F.greatest(F.lit(-0.01), F.least(F.lit(0.01), F.col("weight"))))
    return rounded(S.rays_from_box_hits(clipped, 0.01), "weight")


@query("gradient_ray", f"""WITH {DUAL_CTES}
SELECT feature_id, round(grad, 6) + 0.0 AS weight FROM gr ORDER BY abs(grad) DESC, feature_id LIMIT 20""")
def _(spark, sf_dir):
    return rounded(S.gradient_ray(_gradient(spark, sf_dir), top=20), "weight")
