"""Reduced-cost screening of single features, and rays made from weights or gradients."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from widemargin.operators.pool import existing_pairs, merge_pool, unit_columns

# fixed values of the published method
RELATIVE_WEIGHT = 0.5      # share of the largest weight that makes a ray
SMALLEST_PEAK = 1.0        # no ray when the largest weight is below this
BOX_TOLERANCE = 1e-4       # distance to the box that counts as a hit
GRADIENT_RAY_FEATURES = 20_000


def weighted_feature_sums(matrix: DataFrame, row_weights: DataFrame) -> DataFrame:
    """s = X'v as (feature_id, s) for row weights (row_id, v)."""
    # rows are many and bounded in width: a plain shuffle join on row_id is balanced
    return (matrix.join(row_weights.select("row_id", "v"), "row_id")
            .groupBy("feature_id").agg(F.sum(F.col("value") * F.col("v")).alias("s")))


def reduced_costs(sums: DataFrame, alpha: DataFrame | None = None) -> DataFrame:
    """(feature_id, a, s, v1, v2) with v1 = -a-s and v2 = a+s; a missing entry is 0."""
    if alpha is None:
        both = sums.withColumn("a", F.lit(0.0))
    else:
        both = sums.join(alpha.select("feature_id", F.col("alpha").alias("a")), "feature_id", "full_outer")
    a, s = F.coalesce("a", F.lit(0.0)), F.coalesce("s", F.lit(0.0))
    return both.select("feature_id", a.alias("a"), s.alias("s"), (-a - s).alias("v1"), (a + s).alias("v2"))


def violations(costs: DataFrame, eps: float = 1e-8, already: DataFrame | None = None) -> DataFrame:
    """(feature_id, sign, sign_descent, severity) of the violated inequalities.

    ``sign`` is -1 for a violated v1 and +1 for a violated v2.  ``sign_descent``
    is the direction in which the objective falls, the opposite of ``sign``; the
    loops use it.  ``already`` bans (feature_id, sign) pairs, or whole features
    when it has no sign column.
    """
    # one generator over two structs keeps a single scan of the costs
    stacked = (costs.select("feature_id", F.explode(F.array(
        F.struct(F.lit(-1).alias("sign"), F.col("v1").alias("v")),
        F.struct(F.lit(1).alias("sign"), F.col("v2").alias("v")))).alias("c"))
        .select("feature_id", "c.sign", "c.v")
        .where(F.col("v") < -eps))
    if already is not None:
        keys = ["feature_id", "sign"] if "sign" in already.columns else ["feature_id"]
        stacked = stacked.join(already.select(*keys).distinct(), keys, "left_anti")
    return stacked.select("feature_id", "sign", (-F.col("sign")).alias("sign_descent"),
                          (-F.col("v")).alias("severity"))


def screen_features(matrix: DataFrame, row_weights: DataFrame, alpha: DataFrame | None = None,
                    eps: float = 1e-8, k_max: int = 50, already: DataFrame | None = None) -> DataFrame:
    """The ``k_max`` worst violations, by severity, then feature, then sign."""
    costs = reduced_costs(weighted_feature_sums(matrix, row_weights), alpha)
    return (violations(costs, eps, already)
            .orderBy(F.col("severity").desc(), "feature_id", "sign").limit(k_max))


def screening_summary(costs: DataFrame, row_weights: DataFrame, eps: float = 1e-8,
                      already: DataFrame | None = None) -> DataFrame:
    """One row: sum of the row weights, the suggested bias sign and both violation counts."""
    counts = violations(costs, eps, already).agg(
        F.count(F.when(F.col("sign") == -1, 1)).alias("n_viol1"),
        F.count(F.when(F.col("sign") == 1, 1)).alias("n_viol2"))
    total = row_weights.agg(F.sum("v").alias("sum_y"))
    hint = F.when(F.col("sum_y") > eps, 1).when(F.col("sum_y") < -eps, -1).otherwise(0)
    # both sides are single-row aggregates
    return (total.withColumn("_one", F.lit(1)).join(counts.withColumn("_one", F.lit(1)), "_one")
            .select("sum_y", hint.alias("b_suggest"), "n_viol1", "n_viol2"))


def add_screened_columns(pool: DataFrame, pool_w: DataFrame, matrix: DataFrame, row_weights: DataFrame,
                         alpha: DataFrame | None = None, eps: float = 1e-8, k_max: int = 25,
                         descent: bool = False, kind: str = "point", born_iter: int = 0):
    """Screen, turn the hits into signed unit columns and append the new ones.

    Returns (pool, pool_w, added) where ``added`` lists the screened pairs.
    """
    # with descent signs a known +e_j blocks the violation whose descent sign is +1
    known = existing_pairs(pool_w)
    if descent:
        known = known.withColumn("sign", -F.col("sign"))
    hits = screen_features(matrix, row_weights, alpha, eps, k_max, known)
    chosen = hits.select("feature_id", (F.col("sign_descent") if descent else F.col("sign")).alias("sign"))
    new_pool, new_w = unit_columns(chosen, kind, "screening", born_iter)
    merged, merged_w = merge_pool(pool, pool_w, new_pool, new_w)
    return merged, merged_w, hits


def rays_from_large_weights(weights: DataFrame, max_rays: int = 50) -> DataFrame:
    """(feature_id, sign, weight) of the weights at or above half the largest one."""
    # one number for the whole table, brought back as a one-row broadcast side
    peak = F.broadcast(weights.agg(F.max(F.abs("weight")).alias("peak")).withColumn("_one", F.lit(1)))
    return (weights.withColumn("_one", F.lit(1)).join(peak, "_one")
            .where((F.abs("weight") >= F.lit(RELATIVE_WEIGHT) * F.col("peak")) & (F.col("peak") >= SMALLEST_PEAK))
            .select("feature_id", F.signum("weight").cast("int").alias("sign"), "weight")
            .orderBy(F.abs("weight").desc(), "feature_id").limit(max_rays))


def rays_from_box_hits(weights: DataFrame, m_box: float, max_rays: int = 50) -> DataFrame:
    """(feature_id, sign, weight) where |weight| reaches the box."""
    return (weights.where(F.abs("weight") >= m_box - BOX_TOLERANCE)
            .select("feature_id", F.signum("weight").cast("int").alias("sign"), "weight")
            .orderBy("feature_id").limit(max_rays))


def gradient_ray(grad: DataFrame, top: int = GRADIENT_RAY_FEATURES, descent: bool = True) -> DataFrame:
    """One ray over the ``top`` largest |grad| entries, as (feature_id, weight).

    ``grad`` is minus the derivative of the objective, so +grad descends; the
    option ``descent=False`` gives -grad.
    """
    factor = 1.0 if descent else -1.0
    return (grad.orderBy(F.abs("grad").desc(), "feature_id").limit(top)
            .select("feature_id", (F.col("grad") * factor).alias("weight")))
