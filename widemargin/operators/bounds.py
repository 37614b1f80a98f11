"""Duals, gradients and bounds of a given model, as aggregates over the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from widemargin.operators.screening import weighted_feature_sums
from widemargin.session import cut_lineage

COMBINATIONS = ("convexo", "afin", "conico", "mayor_uno", "libre")


def hinge_duals(scored: DataFrame, cost: float = 1.0, eps: float = 0.1) -> DataFrame:
    """(row_id, y, margin, pi): duals of the hinge smoothed over a width ``eps``."""
    margin = F.col("y") * F.col("score")
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.lit(1.0) - F.col("margin")) / F.lit(float(eps))))
    return (scored.withColumn("margin", margin)
            .select("row_id", "y", "margin", (share * F.lit(float(cost))).alias("pi")))


def cone_dual(weights: DataFrame) -> DataFrame:
    """alpha = -w/|w| as (feature_id, alpha); empty for the zero vector."""
    norm = weights.agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_n")).withColumn("_one", F.lit(1))
    return (weights.withColumn("_one", F.lit(1)).join(F.broadcast(norm), "_one")
            .where(F.col("_n") > 0)
            .select("feature_id", (-F.col("weight") / F.col("_n")).alias("alpha")))


def dual_feature_sums(matrix: DataFrame, duals: DataFrame) -> DataFrame:
    """X'(y*pi) as (feature_id, s); rows with pi = 0 are left out before the join."""
    active = duals.where(F.col("pi") != 0).select("row_id", (F.col("y") * F.col("pi")).alias("v"))
    return weighted_feature_sums(matrix, active)


def master_gradient(matrix: DataFrame, duals: DataFrame, weights: DataFrame) -> DataFrame:
    """(feature_id, alpha, s, grad) with grad = alpha + X'(y*pi), minus the derivative of the objective."""
    both = cone_dual(weights).join(dual_feature_sums(matrix, duals), "feature_id", "full_outer")
    alpha, s = F.coalesce("alpha", F.lit(0.0)), F.coalesce("s", F.lit(0.0))
    return both.select("feature_id", alpha.alias("alpha"), s.alias("s"), (alpha + s).alias("grad"))


def choose_gradient(gradient: DataFrame, strategy: str = "full_gradient") -> DataFrame:
    """(feature_id, grad) for ``full_gradient`` or ``alpha_only``."""
    if strategy not in ("full_gradient", "alpha_only"):
        raise ValueError(f"unknown gradient strategy {strategy}")
    return gradient.select("feature_id", F.col("alpha" if strategy == "alpha_only" else "grad").alias("grad"))


def smooth_gradient(previous: DataFrame, current: DataFrame, factor: float) -> DataFrame:
    """(1-factor)*previous + factor*current; an entry missing on one side is 0."""
    both = previous.select("feature_id", F.col("grad").alias("_p")).join(
        current.select("feature_id", F.col("grad").alias("_c")), "feature_id", "full_outer")
    return both.select("feature_id", ((1 - factor) * F.coalesce("_p", F.lit(0.0))
                                      + factor * F.coalesce("_c", F.lit(0.0))).alias("grad"))


def scale_gradient(gradient: DataFrame, above: float = 10.0) -> DataFrame:
    """Unit length when the norm is above ``above``, else unchanged."""
    norm = gradient.agg(F.sqrt(F.sum(F.col("grad") * F.col("grad"))).alias("_n")).withColumn("_one", F.lit(1))
    divisor = F.when(F.col("_n") > above, F.col("_n")).otherwise(F.lit(1.0))
    return (gradient.withColumn("_one", F.lit(1)).join(F.broadcast(norm), "_one")
            .select("feature_id", (F.col("grad") / divisor).alias("grad")))


def equalised_duals(duals: DataFrame) -> DataFrame:
    """Scale the heavier class down so that sum(y*pi) = 0."""
    sums = duals.agg(F.sum(F.when(F.col("y") > 0, F.col("pi")).otherwise(0.0)).alias("_p"),
                     F.sum(F.when(F.col("y") < 0, F.col("pi")).otherwise(0.0)).alias("_q")).withColumn("_one", F.lit(1))
    mine = F.when(F.col("y") > 0, F.col("_p")).otherwise(F.col("_q"))
    other = F.when(F.col("y") > 0, F.col("_q")).otherwise(F.col("_p"))
    factor = F.when(mine > other, other / mine).otherwise(F.lit(1.0))
    return (duals.withColumn("_one", F.lit(1)).join(F.broadcast(sums), "_one")
            .withColumn("pi", F.col("pi") * factor).select(*duals.columns))


def dual_bound(matrix: DataFrame, duals: DataFrame, cost: float = 1.0,
               direction: DataFrame | None = None, m_box: float | None = None) -> DataFrame:
    """One row: what ``duals`` says about the optimum.

    sum_pi, sum_ypi, max_pi, norm_xtypi and feasible describe the duals as given.
    The bounds use repaired duals (class sums equalised): lb_conic bounds the
    conic problem, lb_box the pricing problem with gradient ``direction`` and box.
    """
    # written once: the duals meet the row totals and the cells
    duals = cut_lineage(duals)
    plus, minus = F.col("y") > 0, F.col("y") < 0
    totals = duals.agg(F.sum("pi").alias("sum_pi"), F.sum(F.col("y") * F.col("pi")).alias("sum_ypi"),
                       F.max("pi").alias("max_pi"), F.sum(F.when(plus, F.col("pi")).otherwise(0.0)).alias("_p"),
                       F.sum(F.when(minus, F.col("pi")).otherwise(0.0)).alias("_q")).withColumn("_one", F.lit(1))
    f_plus = F.when(F.col("_p") > F.col("_q"), F.col("_q") / F.col("_p")).otherwise(F.lit(1.0))
    f_minus = F.when(F.col("_q") > F.col("_p"), F.col("_p") / F.col("_q")).otherwise(F.lit(1.0))
    # one pass over the cells gives the sums of both classes, and with them the given and the repaired duals
    cell = F.col("value") * F.col("pi")
    sums = (matrix.join(duals.where(F.col("pi") != 0).select("row_id", "y", "pi"), "row_id")
            .groupBy("feature_id").agg(F.sum(F.when(plus, cell).otherwise(0.0)).alias("_sp"),
                                       F.sum(F.when(minus, cell).otherwise(0.0)).alias("_sn")))
    zero = F.lit(0.0)
    if direction is not None:
        sums = sums.join(direction.select("feature_id", F.col("grad").alias("_g")), "feature_id", "full_outer")
    else:
        sums = sums.withColumn("_g", zero)
    sums = sums.select(F.coalesce("_sp", zero).alias("_sp"), F.coalesce("_sn", zero).alias("_sn"),
                       F.coalesce("_g", zero).alias("_g"), F.lit(1).alias("_one")).join(F.broadcast(totals), "_one")
    given, repaired = F.col("_sp") - F.col("_sn"), f_plus * F.col("_sp") - f_minus * F.col("_sn")
    norms = sums.agg(F.sqrt(F.sum(given * given)).alias("_ng"), F.sqrt(F.sum(repaired * repaired)).alias("_n"),
                     F.sum(F.abs(repaired + F.col("_g"))).alias("_l1")).withColumn("_one", F.lit(1))
    out = totals.join(F.broadcast(norms), "_one")
    norm, total = F.coalesce("_ng", zero), f_plus * F.col("_p") + f_minus * F.col("_q")
    with_box = direction is not None and m_box is not None
    box = total - F.lit(float(m_box)) * F.coalesce("_l1", zero) if with_box else F.lit(None).cast("double")
    return out.select("sum_pi", "sum_ypi", "max_pi", norm.alias("norm_xtypi"),
                      ((norm <= 1 + 1e-9) & (F.abs("sum_ypi") <= 1e-6) & (F.col("max_pi") <= cost + 1e-9)).alias("feasible"),
                      (total / F.greatest(F.lit(1.0), F.coalesce("_n", zero))).alias("lb_conic"), box.alias("lb_box"))


def combination_feasibility(theta: DataFrame, tol: float = 1e-6) -> DataFrame:
    """(combination, sum_theta, min_theta, feasible): which combination types ``theta`` satisfies.

    Rays must be non-negative in every type.
    """
    points = F.coalesce(F.col("kind") != "ray", F.lit(True))
    facts = theta.agg(F.sum(F.when(points, F.col("coef")).otherwise(0.0)).alias("sum_theta"),
                      F.min(F.when(points, F.col("coef"))).alias("min_theta"),
                      F.min(F.when(~points, F.col("coef"))).alias("_ray"))
    kinds = facts.withColumn("combination", F.explode(F.array(*[F.lit(c) for c in COMBINATIONS])))
    one = F.abs(F.col("sum_theta") - 1) <= tol
    positive = F.col("min_theta") >= -tol
    rule = (F.when(F.col("combination") == "convexo", one & positive).when(F.col("combination") == "afin", one)
            .when(F.col("combination") == "conico", positive)
            .when(F.col("combination") == "mayor_uno", positive & (F.col("sum_theta") >= 1 - tol))
            .otherwise(F.lit(True)))
    return kinds.select("combination", "sum_theta", "min_theta",
                        (rule & F.coalesce(F.col("_ray") >= -tol, F.lit(True))).alias("feasible"))


def box_check(weights: DataFrame, m_box: float) -> DataFrame:
    """(max_abs_w, m_box, within, n_outside) of |w_j| <= m_box."""
    return weights.agg(F.max(F.abs("weight")).alias("max_abs_w"), F.lit(float(m_box)).alias("m_box"),
                       (F.max(F.abs("weight")) <= m_box).alias("within"),
                       F.count(F.when(F.abs("weight") > m_box, 1)).alias("n_outside"))
