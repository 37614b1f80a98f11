"""Max-margin fits on the whole matrix: the squared-norm baseline and the conic model."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from widemargin.operators.ascent import MAX_EPOCHS, Ascended, StoredMatrix, fit_norm
from widemargin.operators.bounds import dual_bound, hinge_duals
from widemargin.operators.newton import Regulariser, combination_bound, combination_set, minimise
from widemargin.operators.rows import block_evaluator, block_scores, pack_blocks
from widemargin.session import cut_lineage

# Up to this many features Newton steps may run on the features themselves.
NARROW_FEATURES = 512


@dataclass
class SvmModel:
    weights: DataFrame     # feature_id, weight
    b: float
    objective: float       # |w| + C*sum(xi); for the baseline (|w|^2)/2 + C*sum(xi)
    lower: float
    sum_xi: float
    passes: int
    status: str
    duals: DataFrame | None = None

    @property
    def gap(self) -> float:
        return (self.objective - self.lower) / max(1.0, abs(self.objective))


def feature_list(matrix: DataFrame, limit: int) -> np.ndarray | None:
    """The sorted feature ids when there are at most ``limit``, else None."""
    ids = [r["feature_id"] for r in matrix.select("feature_id").distinct().limit(limit + 1).collect()]
    return None if len(ids) > limit else np.sort(np.array(ids, dtype="int64"))


def index_features(matrix: DataFrame, features: np.ndarray) -> DataFrame:
    """(row_id, k, z): the cells of a short feature list, k = position in the list."""
    spark = matrix.sparkSession
    index = spark.createDataFrame(pd.DataFrame({"feature_id": features, "k": np.arange(len(features), dtype="int32")}),
                                  "feature_id long, k int")
    # the list is bounded by the caller; the cells keep their partitioning
    return matrix.join(F.broadcast(index), "feature_id").select("row_id", "k", F.col("value").alias("z"))


def weight_table(spark, features: np.ndarray, values: np.ndarray) -> DataFrame:
    keep = values != 0
    return spark.createDataFrame(pd.DataFrame({"feature_id": features[keep], "weight": values[keep].astype(float)}),
                                 "feature_id long, weight double")


def _ascended(found: Ascended) -> SvmModel:
    return SvmModel(found.weights, found.b, found.objective, found.lower, found.sum_xi, found.epochs, found.status, cut_lineage(found.duals))


def linear_svm(matrix: DataFrame, labels: DataFrame, cost: float = 1.0, tol: float = 1e-3, max_epochs: int = MAX_EPOCHS,
               stored: StoredMatrix | None = None) -> SvmModel:
    """Hinge-loss baseline (|w|^2)/2 + C*sum(xi) by dual ascent, with a proven lower bound; the intercept is not penalised."""
    return _ascended(fit_norm(stored or StoredMatrix(matrix, labels), cost, tol, squared=True, max_epochs=max_epochs))


def conic_svm(matrix: DataFrame, labels: DataFrame, cost: float = 1.0, tol: float = 1e-3, max_passes: int = 120,
              narrow: int = NARROW_FEATURES, max_epochs: int = MAX_EPOCHS, stored: StoredMatrix | None = None) -> SvmModel:
    """min |w| + C*sum(xi), the norm not squared, to a proven gap.

    Dual ascent by row blocks serves any number of features.  Up to ``narrow`` features Newton steps on the features
    themselves end at the same bound with fewer jobs; ``narrow=0`` leaves them out.
    """
    features = feature_list(matrix, narrow) if narrow else None
    if features is None:
        return _ascended(fit_norm(stored or StoredMatrix(matrix, labels), cost, tol, max_epochs=max_epochs))
    size = len(features)
    packed = pack_blocks(labels, index_features(matrix, features))
    rays = np.zeros(size, bool)
    found = minimise(block_evaluator(packed, size), Regulariser(np.eye(size)), combination_set("libre", rays),
                     np.zeros(size + 1), cost, combination_bound(np.eye(size), "libre", rays), tol, max_passes)
    duals = cut_lineage(hinge_duals(block_scores(packed, size, found.dual_point), cost, found.width))
    packed.release()
    return SvmModel(weight_table(matrix.sparkSession, features, found.point[:-1]), float(found.point[-1]),
                    found.objective, found.lower, found.hinge, found.passes, found.status, duals)


def certificate(model: SvmModel, matrix: DataFrame, cost: float = 1.0) -> DataFrame:
    """The bound of the model's duals, recomputed from the tables."""
    return dual_bound(matrix, model.duals, cost)
