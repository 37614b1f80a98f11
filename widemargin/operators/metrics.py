"""Scoring and model reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from widemargin.functions.skew import salted_join

SMALL_WEIGHT = 1e-5
# fixed values: the reported magnitude bands
BANDS = (1e-2, 1e-4, 1e-6, 1e-8)


def scores(rows: DataFrame, matrix: DataFrame, weights: DataFrame, b: float | Column,
           hot: DataFrame | None = None) -> DataFrame:
    """``rows`` plus score = x.w + b; a row without cells scores b."""
    partial = (salted_join(matrix, weights.select("feature_id", "weight"), "feature_id", "row_id", hot)
               .groupBy("row_id").agg(F.sum(F.col("value") * F.col("weight")).alias("_xw")))
    bias = b if isinstance(b, Column) else F.lit(float(b))
    return (rows.join(partial, "row_id", "left")
            .withColumn("score", F.coalesce("_xw", F.lit(0.0)) + bias).drop("_xw"))


def predict(scored: DataFrame, zero_as: int | None = None) -> DataFrame:
    """Adds pred = sign of the score; a zero score gives 0 or ``zero_as``."""
    zero = 0 if zero_as is None else zero_as
    return scored.withColumn("pred", F.when(F.col("score") > 0, 1).when(F.col("score") < 0, -1).otherwise(zero))


def margins_slacks(scored: DataFrame) -> DataFrame:
    """Adds margin = y*score and xi = max(0, 1-margin)."""
    return (scored.withColumn("margin", F.col("y") * F.col("score"))
            .withColumn("xi", F.greatest(F.lit(0.0), F.lit(1.0) - F.col("margin"))))


def norm_of(weights: DataFrame) -> DataFrame:
    return weights.agg(F.coalesce(F.sqrt(F.sum(F.col("weight") * F.col("weight"))), F.lit(0.0)).alias("norm_w"))


def _one_row_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Put two single-row aggregates side by side."""
    return left.withColumn("_one", F.lit(1)).join(right.withColumn("_one", F.lit(1)), "_one").drop("_one")


def objective(weights: DataFrame, slacks: DataFrame, cost: float = 1.0) -> DataFrame:
    """(norm_w, sum_xi, obj_val) with obj_val = |w| + C * sum(xi)."""
    total = slacks.agg(F.coalesce(F.sum("xi"), F.lit(0.0)).alias("sum_xi"))
    return _one_row_join(norm_of(weights), total).withColumn(
        "obj_val", F.col("norm_w") + F.lit(float(cost)) * F.col("sum_xi"))


def accuracy(predictions: DataFrame) -> DataFrame:
    return predictions.agg(F.avg((F.col("y") == F.col("pred")).cast("double")).alias("accuracy"))


def classification_report(predictions: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) per class, then macro avg and weighted avg.

    ``predictions`` has y and pred of one type.  A zero division gives 0.
    """
    cells = predictions.groupBy("y", "pred").agg(F.count(F.lit(1)).alias("n"))
    # each cell counts for its true and for its predicted class: classes x classes rows
    sides = cells.select(F.explode(F.array(
        F.struct(F.col("y").cast("string").alias("label"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("said"),
                 F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("pred").cast("string").alias("label"), F.lit(0).cast("long").alias("actual"),
                 F.col("n").alias("said"), F.lit(0).cast("long").alias("hit")))).alias("s")).select("s.*")
    totals = sides.groupBy("label").agg(F.sum("actual").alias("support"), F.sum("said").alias("said"),
                                        F.sum("hit").alias("hit"))

    def share(top, bottom):
        return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)

    per_class = totals.select(
        "label", share(F.col("hit"), F.col("said")).alias("precision"),
        share(F.col("hit"), F.col("support")).alias("recall"),
        share(2 * F.col("hit"), F.col("said") + F.col("support")).alias("f1"), "support")
    names = ("precision", "recall", "f1")
    macro = per_class.agg(*[F.avg(c).alias(c) for c in names], F.sum("support").alias("support"))
    weighted = per_class.agg(*[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in names],
                             F.sum("support").alias("support"))
    columns = ["label", *names, "support"]
    return (per_class.select(*columns)
            .unionByName(macro.withColumn("label", F.lit("macro avg")).select(*columns))
            .unionByName(weighted.withColumn("label", F.lit("weighted avg")).select(*columns)))


def fit_summary(predictions: DataFrame, weights: DataFrame, slacks: DataFrame, cost: float = 1.0,
                slack_tol: float = 1e-6) -> DataFrame:
    """One row: accuracy, f1_macro, f1_weighted, norm_w, sum_xi, positive_slacks, obj_val."""
    report = classification_report(predictions)
    f1 = report.agg(F.max(F.when(F.col("label") == "macro avg", F.col("f1"))).alias("f1_macro"),
                    F.max(F.when(F.col("label") == "weighted avg", F.col("f1"))).alias("f1_weighted"))
    positive = slacks.agg(F.count(F.when(F.col("xi") > slack_tol, 1)).alias("positive_slacks"))
    return _one_row_join(_one_row_join(_one_row_join(accuracy(predictions), f1),
                                       objective(weights, slacks, cost)), positive)


def model_sparsity(weights: DataFrame, n_features: int, small: float = SMALL_WEIGHT) -> DataFrame:
    """(n_features, n_small, share_small); an absent weight is zero."""
    large = weights.agg(F.count(F.when(F.abs("weight") >= small, 1)).alias("_large"))
    return large.select(F.lit(n_features).cast("long").alias("n_features"),
                        (F.lit(n_features) - F.col("_large")).cast("long").alias("n_small"),
                        ((F.lit(n_features) - F.col("_large")) / F.lit(float(n_features))).alias("share_small"))


def coefficient_bands(weights: DataFrame, n_features: int, bands=BANDS) -> DataFrame:
    """Counts below each band, exact zeros, positive and negative weights."""
    w = F.col("weight")
    stored = [F.count(F.when(F.abs(w) >= t, 1)).alias(f"_{i}") for i, t in enumerate(bands)]
    counted = weights.agg(*stored, F.count(F.when(w != 0, 1)).alias("_nz"),
                          F.count(F.when(w > 0, 1)).alias("over_0"), F.count(F.when(w < 0, 1)).alias("under_0"))
    below = [(F.lit(n_features) - F.col(f"_{i}")).cast("long").alias(f"below_1e_{round(-_log10(t))}")
             for i, t in enumerate(bands)]
    return counted.select(*below, (F.lit(n_features) - F.col("_nz")).cast("long").alias("exact_0"),
                          "over_0", "under_0")


def _log10(value: float) -> float:
    from math import log10
    return log10(value)
