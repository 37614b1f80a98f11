"""Coefficient history, stopping rules and reports over iterations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

# fixed values of the tolerance schedule
COARSE_CHANGE, MEDIUM_CHANGE = 1e-1, 1e-3
COARSE_TOL, MEDIUM_TOL, FINE_TOL = 1e-5, 1e-6, 1e-7
MEDIUM_WINDOW, FINE_WINDOW = 1.1, 1.5
# fixed value: the pricing box once the schedule has dropped the master's
FREE_PRICING_BOX = 1e6
FLAT_FROM_ITER = {"points": 2, "points_rays": 6}


def record_coefficients(theta: DataFrame, run_id: str, iteration: int, removed: DataFrame | None = None) -> DataFrame:
    """Rows to append to theta_history(run_id, iter, col_id, kind, coef, event)."""
    rows = theta.select(F.lit(run_id).alias("run_id"), F.lit(iteration).alias("iter"), "col_id", "kind",
                        "coef", F.lit(None).cast("string").alias("event"))
    if removed is not None:
        rows = rows.unionByName(removed.select(
            F.lit(run_id).alias("run_id"), F.lit(iteration).alias("iter"), "col_id", "kind",
            F.lit(None).cast("double").alias("coef"), F.lit("removed").alias("event")))
    return rows


def idle_columns(history: DataFrame, periods: int, threshold: float) -> DataFrame:
    """(run_id, col_id) below ``threshold`` in each of the last ``periods`` records.

    A null record never counts as idle.  A window holds the records of one
    column, one per iteration.
    """
    recent = Window.partitionBy("run_id", "col_id").orderBy(F.col("iter").desc())
    idle = F.coalesce(F.abs("coef") < threshold, F.lit(False))
    return (history.where(F.col("event").isNull())
            .withColumn("_rn", F.row_number().over(recent)).where(F.col("_rn") <= periods)
            .groupBy("run_id", "col_id")
            .agg(F.count(F.lit(1)).alias("_n"), F.min(idle.cast("int")).alias("_idle"))
            .where((F.col("_n") == periods) & (F.col("_idle") == 1))
            .select("run_id", "col_id"))


def prune_idle_columns(pool: DataFrame, pool_w: DataFrame, history: DataFrame, periods: int, threshold: float):
    """(pool, pool_w, removed) without the idle columns of the history."""
    idle = idle_columns(history, periods, threshold).select("col_id")
    return (pool.join(idle, "col_id", "left_anti"), pool_w.join(idle, "col_id", "left_anti"),
            pool.join(idle, "col_id", "left_semi"))


def _by_iter():
    return Window.partitionBy("run_id").orderBy("iter")


def stop_rules(iterations: DataFrame, tol: float, max_iter: int, flat_from: int = 2) -> DataFrame:
    """Adds ``stop``: the first rule that holds at each iteration, or null.

    ``iterations`` is (run_id, iter, ub, lb); a run has one row per iteration.
    """
    change = F.abs(F.col("ub") - F.lag("ub").over(_by_iter()))
    rule = (F.when(F.col("ub").isNull(), "MASTER_FAILURE")
            .when((F.col("iter") > 0) & (F.abs(F.col("ub") - F.col("lb")) <= tol), "optimo_gap")
            .when((F.col("iter") >= flat_from) & (change <= tol), "optimo")
            .when(F.col("iter") >= max_iter, "max_iter"))
    return iterations.withColumn("stop", rule)


def first_stop(iterations: DataFrame, tol: float, max_iter: int, flat_from: int = 2) -> DataFrame:
    """(run_id, iter, status) where each run ends."""
    marked = stop_rules(iterations, tol, max_iter, flat_from).where(F.col("stop").isNotNull())
    return marked.groupBy("run_id").agg(F.min(F.struct("iter", "stop")).alias("_s")).select(
        "run_id", F.col("_s.iter").alias("iter"), F.col("_s.stop").alias("status"))


def schedule_mode(change):
    return (F.when(change > COARSE_CHANGE, "coarse").when(change > MEDIUM_CHANGE, "medium")
            .when(change.isNotNull(), "fine"))


def tolerance_schedule(iterations: DataFrame) -> DataFrame:
    """(run_id, iter, mode, tol, window_factor, drop_box) from the change of ub."""
    change = F.abs(F.lag("ub").over(_by_iter()) - F.col("ub"))
    mode = F.col("mode")
    return (iterations.select("run_id", "iter", schedule_mode(change).alias("mode"))
            .select("run_id", "iter", "mode",
                    F.when(mode == "coarse", COARSE_TOL).when(mode == "medium", MEDIUM_TOL)
                    .when(mode == "fine", FINE_TOL).alias("tol"),
                    F.when(mode == "medium", MEDIUM_WINDOW).when(mode == "fine", FINE_WINDOW)
                    .otherwise(1.0).alias("window_factor"),
                    F.coalesce(mode == "fine", F.lit(False)).alias("drop_box")))


def convergence_series(iterations: DataFrame, tol: float = 1e-6) -> DataFrame:
    """(run_id, iter, ub, lb, gap, improvement, alert); alert marks a rising ub."""
    before = F.lag("ub").over(_by_iter())
    return iterations.select("run_id", "iter", "ub", "lb", (F.col("ub") - F.col("lb")).alias("gap"),
                             (before - F.col("ub")).alias("improvement"),
                             F.coalesce(F.col("ub") > before + tol, F.lit(False)).alias("alert"))


def theta_stats(history: DataFrame, zero: float = 1e-12) -> DataFrame:
    """Per run, over the last record of each column: known, non-zero, max, min."""
    last = (history.where(F.col("event").isNull()).groupBy("run_id", "col_id")
            .agg(F.max_by(F.struct("coef"), "iter").alias("_c")).select("run_id", "col_id", F.col("_c.coef").alias("coef")))
    return last.groupBy("run_id").agg(
        F.count("coef").alias("theta_last_active"),
        F.count(F.when(F.abs("coef") > zero, 1)).alias("theta_last_nonzero"),
        F.max("coef").alias("theta_last_max"), F.min("coef").alias("theta_last_min"))


def theta_matrix(history: DataFrame, iterations: list[int]) -> DataFrame:
    """(run_id, col_id, it_0, it_1, ..., removed): one coefficient column per iteration."""
    columns = [F.max(F.when((F.col("iter") == i) & F.col("event").isNull(), F.col("coef"))).alias(f"it_{i}")
               for i in iterations]
    removed = F.max((F.coalesce("event", F.lit("")) == "removed").cast("int")).alias("removed")
    return history.groupBy("run_id", "col_id").agg(*columns, removed)


def theta_log_matrix(history: DataFrame, iterations: list[int], eps: float = 1e-10) -> DataFrame:
    """As theta_matrix with log10(max(|coef|, eps))."""
    logged = history.withColumn("coef", F.when(F.col("coef").isNotNull(), F.log10(F.greatest(F.abs("coef"), F.lit(eps)))))
    return theta_matrix(logged, iterations)
