"""Queries: the pool of candidate columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.base import (ORDER_CTES, VECTOR_CTES, clean_vector_pool, combined_weights, counted, h32, order_matrix, pool_theta,
                           query, rounded, scratch_path, supplier_features, vector_features, vector_matrix, vector_pool)
from widemargin.operators import pool as C
from widemargin.sources import artifacts

W_OUT = "col_id, feature_id, round(weight, 6) + 0.0 AS weight"


def _flat(pool, pool_w):
    """One row per weight; a column without weights shows one row with nulls."""
    return rounded(pool.join(pool_w, "col_id", "left").select("col_id", "b", "feature_id", "weight"), "weight", "b")


FLAT = "SELECT p.col_id, round(b, 6) + 0.0 AS b, feature_id, round(weight, 6) + 0.0 AS weight"


@query("compact_pool", f"WITH {VECTOR_CTES} {FLAT} FROM pool p LEFT JOIN pool_w w2 ON p.col_id = w2.col_id")
def _(spark, sf_dir):
    return _flat(*C.compact_pool(*vector_pool(spark, sf_dir)))




@query("stack_pool", f"""WITH {VECTOR_CTES}, {ORDER_CTES}
SELECT {W_OUT} FROM pool_w UNION ALL
SELECT 'p_e' || feature_id, feature_id, 1.0 FROM feats""")
def _(spark, sf_dir):
    _, centroids = clean_vector_pool(spark, sf_dir)
    _, units = C.unit_columns(supplier_features(spark, sf_dir))
    empty = C.empty_pool(spark)[1]
    return rounded(C.stack_pool([centroids, empty, units], spark), "weight")


@query("zero_and_unit_columns", f"""WITH {ORDER_CTES}
SELECT 'p_zero' AS col_id, 0.0 AS b, NULL::BIGINT AS feature_id, NULL::DOUBLE AS weight UNION ALL
SELECT CASE WHEN feature_id % 2 = 0 THEN 'p_m' ELSE 'p_e' END || feature_id, 0.0, feature_id,
       CASE WHEN feature_id % 2 = 0 THEN -1.0 ELSE 1.0 END FROM feats""")
def _(spark, sf_dir):
    signed = supplier_features(spark, sf_dir).withColumn("sign", F.when(F.col("feature_id") % 2 == 0, -1).otherwise(1))
    return _flat(*C.zero_and_unit_columns(signed))


@query("sample_unit_columns", f"""WITH {ORDER_CTES},
r AS (SELECT feature_id, row_number() OVER (ORDER BY {h32("'420'", "feature_id")}, feature_id) - 1 AS rk,
             count(*) OVER () AS n FROM feats)
SELECT 'p_zero' AS col_id, NULL::BIGINT AS feature_id UNION ALL
SELECT 'p_e' || feature_id, feature_id FROM r WHERE rk < floor(n * 0.1::DOUBLE)""")
def _(spark, sf_dir):
    pool, pool_w = C.sample_unit_columns(supplier_features(spark, sf_dir), 0.1)
    return pool.join(pool_w, "col_id", "left").select("col_id", "feature_id")


@query("unit_columns_for", f"""WITH {ORDER_CTES}
SELECT 'r_e' || feature_id AS col_id, feature_id, 1.0 AS weight
FROM (SELECT feature_id FROM om GROUP BY feature_id HAVING sum(value) >= 15000)""")
def _(spark, sf_dir):
    busy = (order_matrix(spark, sf_dir).groupBy("feature_id").agg(F.sum("value").alias("q"))
            .where(F.col("q") >= 15000).select("feature_id"))
    return C.unit_columns(busy, kind="ray")[1]


def _mixed_pool(spark, sf_dir):
    """Centroids plus signed unit columns for a tenth of the vector positions."""
    pool, pool_w = clean_vector_pool(spark, sf_dir)
    picked = (vector_features(spark, sf_dir).where(F.col("feature_id") % 10 < 2)
              .withColumn("sign", F.when(F.col("feature_id") % 10 == 1, -1).otherwise(1)))
    units, units_w = C.unit_columns(picked)
    return pool.unionByName(units), pool_w.unionByName(units_w)


MIXED = f"""{VECTOR_CTES},
picked AS (SELECT DISTINCT feature_id, CASE WHEN feature_id % 10 = 1 THEN -1 ELSE 1 END AS sign FROM em WHERE feature_id % 10 < 2),
mixed_w AS (SELECT * FROM pool_w UNION ALL
  SELECT CASE WHEN sign < 0 THEN 'p_m' ELSE 'p_e' END || feature_id, feature_id, sign::DOUBLE FROM picked),
mixed AS (SELECT * FROM pool UNION ALL
  SELECT CASE WHEN sign < 0 THEN 'p_m' ELSE 'p_e' END || feature_id, 'point', 'unit', 0, 0.0 FROM picked)"""


@query("existing_pairs", f"""WITH {MIXED}
SELECT DISTINCT min(feature_id) AS feature_id, CASE WHEN min(weight) < 0 THEN -1 ELSE 1 END AS sign
FROM mixed_w GROUP BY col_id HAVING count(*) = 1""")
def _(spark, sf_dir):
    return C.existing_pairs(_mixed_pool(spark, sf_dir)[1])


def _with_copies(spark, sf_dir):
    """The mixed pool and, under new names, a copy of each of its columns."""
    pool, pool_w = _mixed_pool(spark, sf_dir)
    renamed = F.concat(F.lit("q_"), F.col("col_id"))
    return (pool.unionByName(pool.withColumn("col_id", renamed)),
            pool_w.unionByName(pool_w.withColumn("col_id", renamed)))


# ids follow from the content: a column and its copy under another name become one column, others stay apart
@query("key_pool", f"""WITH {MIXED}, sizes AS (SELECT col_id, count(*) AS n FROM mixed_w GROUP BY col_id)
SELECT 'p_' AS prefix, 18 AS id_length, (SELECT count(*) FROM mixed) AS n_ids, round(b, 6) + 0.0 AS b, feature_id,
       round(weight, 6) + 0.0 AS weight, coalesce(n, 0) AS n
FROM mixed m LEFT JOIN mixed_w w2 ON m.col_id = w2.col_id LEFT JOIN sizes s ON m.col_id = s.col_id""")
def _(spark, sf_dir):
    pool, pool_w = C.key_pool(*_with_copies(spark, sf_dir))
    n_ids = pool.select("col_id").distinct().count()
    sizes = pool_w.groupBy("col_id").agg(F.count(F.lit(1)).alias("n"))
    flat = pool.join(sizes, "col_id", "left").join(pool_w, "col_id", "left")
    return rounded(flat.select(F.substring("col_id", 1, 2).alias("prefix"), F.length("col_id").alias("id_length"),
                               F.lit(n_ids).alias("n_ids"), "b", "feature_id", "weight", F.coalesce("n", F.lit(0)).alias("n")), "weight", "b")


SIGNATURE = """sig AS (SELECT m.col_id, list(struct_pack(f := w2.feature_id, w := w2.weight) ORDER BY w2.feature_id)
          FILTER (WHERE w2.feature_id IS NOT NULL) AS s
  FROM both_pool m LEFT JOIN both_w w2 ON m.col_id = w2.col_id GROUP BY m.col_id)"""


@query("dedupe_columns", f"""WITH {MIXED},
both_pool AS (SELECT * FROM mixed UNION ALL SELECT 'q_' || col_id, kind, origin, born_iter, b FROM mixed),
both_w AS (SELECT * FROM mixed_w UNION ALL SELECT 'q_' || col_id, feature_id, weight FROM mixed_w), {SIGNATURE}
SELECT col_id, min(col_id) OVER (PARTITION BY s) AS kept FROM sig""")
def _(spark, sf_dir):
    return C.dedupe_columns(*_with_copies(spark, sf_dir))


@query("merge_pool", f"""WITH {MIXED}, {ORDER_CTES},
added AS (SELECT DISTINCT 'p_e' || feature_id AS col_id, feature_id FROM em
          WHERE 'p_e' || feature_id NOT IN (SELECT col_id FROM mixed))
SELECT p.col_id, round(b, 6) + 0.0 AS b, feature_id, round(weight, 6) + 0.0 AS weight FROM mixed p LEFT JOIN mixed_w w2 ON p.col_id = w2.col_id
UNION ALL SELECT col_id, 0.0, feature_id, 1.0 FROM added""")
def _(spark, sf_dir):
    pool, pool_w = _mixed_pool(spark, sf_dir)
    new_pool, new_w = C.unit_columns(vector_features(spark, sf_dir))
    # the batch holds every new column twice
    twice = F.concat(F.col("col_id"), F.lit("_again"))
    new_pool = new_pool.unionByName(new_pool.withColumn("col_id", twice))
    new_w = new_w.unionByName(new_w.withColumn("col_id", twice))
    return _flat(*C.merge_pool(pool, pool_w, new_pool, new_w))


@query("active_columns", f"""WITH {VECTOR_CTES} {FLAT}
FROM pool p JOIN theta t ON p.col_id = t.col_id LEFT JOIN pool_w w2 ON p.col_id = w2.col_id WHERE abs(coef) > 1e-6""")
def _(spark, sf_dir):
    pool, pool_w = clean_vector_pool(spark, sf_dir)
    return _flat(*C.active_columns(pool, pool_w, pool_theta(pool)))


@query("normalize_columns", f"""WITH {VECTOR_CTES}
SELECT col_id, feature_id, round(weight / sqrt(sum(weight * weight) OVER (PARTITION BY col_id)), 6) + 0.0 AS weight FROM pool_w""")
def _(spark, sf_dir):
    return rounded(C.normalize_columns(clean_vector_pool(spark, sf_dir)[1]), "weight")


@query("prune_weights", f"""WITH {VECTOR_CTES}
SELECT p.col_id, round(b, 6) + 0.0 AS b, feature_id, round(weight, 6) + 0.0 AS weight FROM pool p JOIN pool_w w2 ON p.col_id = w2.col_id WHERE abs(weight) >= 0.03""")
def _(spark, sf_dir):
    return _flat(*C.prune_weights(*clean_vector_pool(spark, sf_dir), tol=0.03))


@query("combine_columns", f"WITH {VECTOR_CTES} SELECT feature_id, round(weight, 6) + 0.0 AS weight FROM w")
def _(spark, sf_dir):
    return rounded(combined_weights(spark, sf_dir), "weight")


@query("gram_matrix", f"""WITH {VECTOR_CTES}
SELECT a.col_id AS k1, b.col_id AS k2, round(sum(a.weight * b.weight), 6) + 0.0 AS dot
FROM pool_w a JOIN pool_w b ON a.feature_id = b.feature_id AND a.col_id <= b.col_id GROUP BY 1, 2""")
def _(spark, sf_dir):
    return rounded(C.gram_matrix(clean_vector_pool(spark, sf_dir)[1]), "dot")


@query("project_rows", f"""WITH {VECTOR_CTES}
SELECT row_id, col_id, round(sum(value * weight), 6) + 0.0 AS z FROM em JOIN pool_w USING (feature_id) GROUP BY 1, 2""")
def _(spark, sf_dir):
    matrix, hot = counted(vector_matrix(spark, sf_dir), "matrix", "feature_id")
    return rounded(C.project_rows(matrix, clean_vector_pool(spark, sf_dir)[1], hot), "z")


@query("pool_checkpoint", f"WITH {VECTOR_CTES} {FLAT} FROM pool p LEFT JOIN pool_w w2 ON p.col_id = w2.col_id")
def _(spark, sf_dir):
    pool, pool_w = clean_vector_pool(spark, sf_dir)
    base = artifacts.pool_checkpoint({"pool": pool, "pool_w": pool_w}, scratch_path(spark, "state"), "demo", 0)
    state = artifacts.pool_restore(spark, base, ("pool", "pool_w"))
    return _flat(state["pool"], state["pool_w"])


@query("pool_restore", f"WITH {VECTOR_CTES} SELECT col_id, kind, round(coef, 6) + 0.0 AS coef FROM theta")
def _(spark, sf_dir):
    from widemargin.operators.history import record_coefficients
    pool, _ = clean_vector_pool(spark, sf_dir)
    history = record_coefficients(pool_theta(pool), "demo", 3)
    base = artifacts.pool_checkpoint({"theta_history": history}, scratch_path(spark, "state"), "demo", 3)
    back = artifacts.pool_restore(spark, base, ("theta_history",))["theta_history"]
    return rounded(back.where(F.col("iter") == 3).select("col_id", "kind", "coef"), "coef")
