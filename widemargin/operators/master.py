"""The master problem: the best combination of a pool of candidate columns.

Rows, weights and gradients stay in DataFrames.  The driver holds what has the
size of the pool: coefficients, the Gram matrix and one curvature matrix.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from widemargin.functions.skew import hot_keys, with_slice
from widemargin.operators.ascent import StoredMatrix, fit_norm
from widemargin.operators.bounds import hinge_duals
from widemargin.operators.newton import (WIDTHS, NewtonResult, Regulariser, combination_bound, combination_set,
                                         minimise)
from widemargin.operators.pool import MAX_GRAM_COLUMNS, POOL_SCHEMA, gram_matrix, project_rows
from widemargin.operators.rows import PackedRows, block_evaluator, block_scores, extend_rows, label_rows, pack_rows
from widemargin.session import bucketed, cut_lineage

# fixed value: weight of the ridge term, which the reported objective leaves out
RIDGE = 1e-6
# rows of the box |w_j| <= M added per round, rounds, and the first penalty
_BOX_ROWS = 200
_BOX_ROUNDS = 40
_BOX_PENALTY = 100.0


@dataclass
class MasterSolution:
    """Result of one master solve; theta and weights are DataFrames."""

    status: str
    objective: float
    lower: float
    b: float
    norm_w: float
    sum_xi: float
    passes: int
    theta: DataFrame          # col_id, kind, coef
    weights: DataFrame        # feature_id, weight
    duals: DataFrame          # row_id, y, margin, pi
    coefficients: dict = field(repr=False, default_factory=dict)

    @property
    def gap(self) -> float:
        return (self.objective - self.lower) / max(1.0, abs(self.objective))


def column_index(spark, names: list[str], first: int = 0) -> DataFrame:
    """(col_id, k) of at most MAX_GRAM_COLUMNS names."""
    if len(names) > MAX_GRAM_COLUMNS:
        raise ValueError(f"more than {MAX_GRAM_COLUMNS} columns in one pool")
    return spark.createDataFrame(
        pd.DataFrame({"col_id": np.array(names, dtype=object), "k": np.arange(first, first + len(names), dtype="int32")}),
        "col_id string, k int")


def cross_gram(new_w: DataFrame, pool_w: DataFrame) -> DataFrame:
    """(k1, k2, dot) between a few new columns and all columns; the pairs are combined map-side."""
    left = new_w.select("feature_id", F.col("col_id").alias("k1"), F.col("weight").alias("_a"))
    right = pool_w.select("feature_id", F.col("col_id").alias("k2"), F.col("weight").alias("_b"))
    return left.join(right, "feature_id").groupBy("k1", "k2").agg(F.sum(F.col("_a") * F.col("_b")).alias("dot"))


class MasterState:
    """A pool with its projections on the rows and its Gram matrix; columns are only appended."""

    def __init__(self, matrix: DataFrame, labels: DataFrame, cost: float = 1.0, hot: DataFrame | None = None):
        self.spark = matrix.sparkSession
        self.labels, self.cost = labels, float(cost)
        matrix = matrix.select("row_id", "feature_id", "value")
        # measured once per run: the joins of every iteration reuse it
        self.hot = cut_lineage(hot_keys(matrix, "feature_id") if hot is None else hot)
        # two stored copies, so that no iteration shuffles the matrix: by feature for X w, by row for X'(y*pi)
        self.by_feature = bucketed(with_slice(matrix, "feature_id", "row_id", self.hot), "feature_id", "_slice")
        self.matrix = bucketed(matrix, "row_id")
        self.columns: list[dict] = []
        self.active: set[str] = set()
        # names of columns that an earlier part of the run dropped: they don't come back
        self.retired: set[str] = set()
        self.pool_w: DataFrame | None = None
        self.row_table: DataFrame | None = None
        self.gram = np.zeros((0, 0))
        self.rows: PackedRows | None = None

    def add(self, pool: DataFrame, pool_w: DataFrame) -> list[str]:
        """Append the columns whose id is new; returns their ids."""
        known = {c["col_id"] for c in self.columns} | self.retired
        rows = pool.select(*POOL_SCHEMA.names).limit(MAX_GRAM_COLUMNS + len(known) + 1).collect()
        fresh = sorted((r.asDict() for r in rows if r["col_id"] not in known), key=lambda r: r["col_id"])
        if not fresh:
            return []
        first = len(self.columns)
        if first + len(fresh) > MAX_GRAM_COLUMNS:
            raise ValueError(f"more than {MAX_GRAM_COLUMNS} columns in one pool")
        names = [c["col_id"] for c in fresh]
        index = F.broadcast(column_index(self.spark, names, first))
        new_w = cut_lineage(pool_w.select("col_id", "feature_id", "weight").join(index.select("col_id"), "col_id", "left_semi"))
        new_z = cut_lineage(project_rows(self.by_feature, new_w, self.hot).join(index, "col_id").select("row_id", "k", "z"))
        self._extend_gram(names, new_w)
        self.columns += fresh
        self.active |= set(names)
        self.pool_w = new_w if self.pool_w is None else self.pool_w.unionByName(new_w)
        # rows keep their buckets: only the entries of the new columns are shuffled
        rows = label_rows(self.labels, new_z) if self.row_table is None else extend_rows(self.row_table, new_z)
        self.row_table = bucketed(rows, "row_id")
        old, self.rows = self.rows, pack_rows(self.row_table)
        if old is not None:
            old.release()
        return names

    def _extend_gram(self, names: list[str], new_w: DataFrame):
        place = {c["col_id"]: k for k, c in enumerate(self.columns)}
        first = len(place)
        place.update({n: first + i for i, n in enumerate(names)})
        dots = gram_matrix(new_w, names) if self.pool_w is None else cross_gram(new_w, self.pool_w.unionByName(new_w))
        gram = np.zeros((len(place), len(place)))
        gram[:first, :first] = self.gram
        found = dots.toPandas()
        i, j = found["k1"].map(place).to_numpy(int), found["k2"].map(place).to_numpy(int)
        gram[i, j] = found["dot"]
        gram[j, i] = found["dot"]
        self.gram = gram

    def release(self):
        """Free the cached rows; results already returned stay valid only through their tables."""
        if self.rows is not None:
            self.rows.release()

    def drop(self, names):
        """Leave columns out of further solves; their projections stay where they are."""
        self.active -= set(names)

    def frames(self) -> tuple[DataFrame, DataFrame]:
        """(pool, pool_w) of the active columns."""
        rows = [tuple(c[n] for n in POOL_SCHEMA.names) for c in self.columns if c["col_id"] in self.active]
        pool = self.spark.createDataFrame(rows, POOL_SCHEMA)
        return pool, self.pool_w.join(F.broadcast(pool.select("col_id")), "col_id", "left_semi")

    def solve(self, combination: str = "convexo", m_box: float | None = None, ridge: float = RIDGE,
              tol: float = 1e-3, max_passes: int = 120, start: dict | None = None,
              only: set[str] | None = None, norm: str = "norm") -> MasterSolution:
        """Minimise |W theta| + C*sum(xi) over the coefficients ``combination`` allows."""
        names_in = self.active if only is None else self.active & only
        chosen = np.array([k for k, c in enumerate(self.columns) if c["col_id"] in names_in], dtype=int)
        if not len(chosen):
            raise ValueError("the pool is empty")
        cols = [self.columns[k] for k in chosen]
        gram = self.gram[np.ix_(chosen, chosen)]
        rays = np.array([c["kind"] == "ray" for c in cols])
        project = combination_set(combination, rays)
        evaluate = block_evaluator(self.rows, len(self.columns), chosen)
        regulariser = Regulariser(gram, kind=norm, ridge=ridge)
        first = np.array([(start or {}).get(c["col_id"], 0.0) for c in cols])
        if not start and combination in ("convexo", "mayor_uno", "afin"):
            first = np.where(rays, 0.0, 1.0 / max(1, (~rays).sum()))
        first = np.append(project(first), (start or {}).get("b", 0.0))
        bound = combination_bound(gram, combination, rays) if norm == "norm" else None
        # a warm start goes on near the width where the last solve ended
        widths = [w for w in WIDTHS if w <= 4 * (start or {}).get("width", WIDTHS[0])] or list(WIDTHS[-1:])
        found = minimise(evaluate, regulariser, project, first, self.cost, bound, tol, max_passes, widths)
        if m_box is not None:
            found = self._inside_box(found, evaluate, regulariser, project, bound, cols, m_box, combination, tol, max_passes)
        return self._solution(found, cols, chosen, gram)

    def _weights(self, cols, x) -> DataFrame:
        pairs = [(c["col_id"], float(v)) for c, v in zip(cols, x) if v != 0.0]
        theta = self.spark.createDataFrame(pairs, "col_id string, coef double")
        # at most MAX_GRAM_COLUMNS coefficients
        return (self.pool_w.join(F.broadcast(theta), "col_id")
                .groupBy("feature_id").agg(F.sum(F.col("weight") * F.col("coef")).alias("weight")))

    def _inside_box(self, found, evaluate, regulariser, project, bound, cols, m_box, combination, tol, max_passes):
        """The box |w_j| <= M as rows with multipliers.

        Features that leave the box become rows, at most a batch per round.  Each round solves with the rows' penalty and
        takes the multipliers on; they count as duals in the bound.  The point of a round is drawn to a point inside the
        box, towards 0 or the column that lies deepest inside, so every round has an allowed point; rounds end when the
        best of these meets the bound, with the status "box_active".
        """
        peak = self._peak(cols, found.point)
        if peak <= m_box * (1 + 1e-9):
            return found
        inner, depth = self._deepest(cols, m_box, combination)
        held: dict[tuple[int, int], int] = {}
        lower, passes, best, least = found.lower, found.passes, None, np.inf
        regulariser.limits, regulariser.limit = np.zeros((0, len(cols))), m_box
        regulariser.multipliers, regulariser.penalty = np.zeros(0), _BOX_PENALTY
        for turn in range(_BOX_ROUNDS):
            # the nearest point on the way to the inner one that is allowed
            share = min(1.0, (m_box - depth) / (peak - depth)) if peak > m_box else 1.0
            if share > 0:
                point = found.point.copy()
                point[:-1] = share * point[:-1] + (1 - share) * inner
                sums = evaluate(point[None, :], found.width)
                passes += 1
                value = self._objective(regulariser, point, float(sums["hinge"][0]))
                if best is None or value < best[0]:
                    best = value, point, float(sums["hinge"][0])
            if best is not None and best[0] - lower <= tol * max(1.0, abs(best[0])):
                break
            self._add_box_rows(regulariser, held, cols, found.point, m_box)
            over = regulariser.limits @ found.point[:-1] - m_box
            worst = np.maximum(over, 0.0).max(initial=0.0)
            regulariser.multipliers = np.maximum(regulariser.multipliers + regulariser.penalty * over, 0.0)
            if worst > 0.25 * least:
                regulariser.penalty *= 4
            least = min(least, worst)
            widths = [w for w in WIDTHS if w <= 4 * found.width] or list(WIDTHS[-1:])
            found = minimise(evaluate, regulariser, project, found.point, self.cost,
                             regulariser.bounded_by_rows(bound) if bound else None, 0.3 * tol, max_passes, widths)
            passes, lower = passes + found.passes, max(lower, found.lower)
            peak = self._peak(cols, found.point)
        found.passes, found.lower = passes, lower
        if best is None:
            found.status = "box_exceeded"
            return found
        found.objective, found.point, found.hinge = best
        found.status = "box_active" if found.gap <= tol else "box_inaccurate"
        return found

    def _objective(self, regulariser, point, hinge) -> float:
        plain = Regulariser(regulariser.gram, regulariser.kind, regulariser.linear)
        return float(plain.value(point[None, :])[0] + self.cost * hinge)

    def _peak(self, cols, point) -> float:
        return self._weights(cols, point[:-1]).agg(F.max(F.abs("weight"))).first()[0] or 0.0

    def _deepest(self, cols, m_box, combination) -> tuple[np.ndarray, float]:
        """(coefficients, largest |w_j|) of an allowed point well inside the box."""
        inner = np.zeros(len(cols))
        if combination in ("conico", "libre"):
            return inner, 0.0
        peaks = {r["col_id"]: r["p"] for r in self.pool_w.groupBy("col_id").agg(F.max(F.abs("weight")).alias("p")).collect()}
        points = [(peaks.get(c["col_id"], 0.0), k) for k, c in enumerate(cols) if c["kind"] != "ray"]
        depth, k = min(points, default=(np.inf, 0))
        inner[k] = 1.0
        return inner, depth

    def _add_box_rows(self, regulariser, held, cols, point, m_box):
        """Rows of the features that leave the box most, by the side where they leave it."""
        outside = self._weights(cols, point[:-1]).where(F.abs("weight") > m_box).orderBy(F.abs("weight").desc(), "feature_id")
        known = list(held)
        if known:
            old = self.spark.createDataFrame(known, "feature_id long, side int")
            # as many as there are rows
            outside = (outside.withColumn("side", F.signum("weight").cast("int"))
                       .join(F.broadcast(old), ["feature_id", "side"], "left_anti").orderBy(F.abs("weight").desc(), "feature_id"))
        worst = [(r["feature_id"], 1 if r["weight"] > 0 else -1) for r in outside.limit(_BOX_ROWS).collect()]
        if not worst:
            return
        keep = self.spark.createDataFrame([(j,) for j, _ in worst], "feature_id long")
        cells = self.pool_w.join(F.broadcast(keep), "feature_id").toPandas()
        place = {c["col_id"]: k for k, c in enumerate(cols)}
        row = {j: i for i, (j, _) in enumerate(worst)}
        added = np.zeros((len(worst), len(cols)))
        cells = cells[cells["col_id"].isin(place)]
        added[cells["feature_id"].map(row), cells["col_id"].map(place)] = cells["weight"]
        added *= np.array([[side] for _, side in worst])
        held.update({pair: len(held) + i for i, pair in enumerate(worst)})
        regulariser.limits = np.vstack([regulariser.limits, added])
        regulariser.multipliers = np.append(regulariser.multipliers, np.zeros(len(worst)))

    def _solution(self, found: NewtonResult, cols, chosen, gram) -> MasterSolution:
        x, b = found.point[:-1], float(found.point[-1])
        theta = self.spark.createDataFrame([(c["col_id"], c["kind"], float(v)) for c, v in zip(cols, x)],
                                           "col_id string, kind string, coef double")
        everywhere = np.zeros(len(self.columns) + 1)
        everywhere[chosen], everywhere[-1] = found.dual_point[:-1], found.dual_point[-1]
        scored = block_scores(self.rows, len(self.columns), everywhere)
        coefficients = {c["col_id"]: float(v) for c, v in zip(cols, x)}
        coefficients |= {"b": b, "width": found.width}
        return MasterSolution(
            status=found.status, objective=found.objective, lower=found.lower, b=b,
            norm_w=float(np.sqrt(max(x @ gram @ x, 0.0))), sum_xi=found.hinge, passes=found.passes, theta=theta,
            weights=self._weights(cols, x), duals=hinge_duals(scored, self.cost, found.width),
            coefficients=coefficients)


def solve_master(matrix: DataFrame, labels: DataFrame, pool: DataFrame, pool_w: DataFrame,
                 combination: str = "convexo", cost: float = 1.0, m_box: float | None = 1e4,
                 hot: DataFrame | None = None, **options) -> MasterSolution:
    """Solve the master once for a pool of points and rays."""
    state = MasterState(matrix, labels, cost, hot)
    state.add(pool, pool_w)
    return state.solve(combination, m_box, **options)


def solve_unit_master(matrix: DataFrame, labels: DataFrame, pool: DataFrame, pool_w: DataFrame, combination: str = "conico",
                      cost: float = 1.0, tol: float = 1e-3, **options) -> MasterSolution:
    """The master over unit columns, points or rays, any number of them, for "conico" and "libre".

    Columns of one weight each only say which signs a weight may have, so the master is a fit over the features that have
    columns, with these signs, and dual ascent solves it without a Gram matrix; nothing of the pool is on the driver.
    The coefficient goes to the first column, by id, of its feature and sign; a column without weights gets 0.
    """
    if combination not in ("conico", "libre"):
        raise ValueError(f"unit columns of any number need conico or libre, not {combination}")
    pool_w = pool_w.where(F.col("weight").isNotNull() & (F.col("weight") != 0))
    if pool_w.groupBy("col_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        raise ValueError("a column has more than one weight")
    free = F.col("kind") != "ray" if combination == "libre" else F.lit(False)
    units = cut_lineage(pool_w.join(pool.select("col_id", "kind"), "col_id").withColumn("free", F.coalesce(free, F.lit(combination == "libre"))))
    first = lambda sign: F.min(F.when(F.col("free") | (F.signum("weight") == sign), F.struct("col_id", "weight")))
    known = cut_lineage(units.groupBy("feature_id").agg(first(1.0).alias("up"), first(-1.0).alias("down")))
    # w_j may rise where a column leads up, and fall where one leads down
    signs = known.select("feature_id", F.when(F.col("down").isNull(), -1.0).when(F.col("up").isNull(), 1.0).otherwise(0.0).alias("g"))
    stored = StoredMatrix(matrix.join(known.select("feature_id"), "feature_id", "left_semi"), labels)
    found = fit_norm(stored, cost, tol, signs=signs, **options)
    weights = cut_lineage(found.weights)
    chosen = weights.join(known, "feature_id").withColumn("to", F.when(F.col("weight") > 0, F.col("up")).otherwise(F.col("down")))
    coefs = chosen.select(F.col("to.col_id").alias("col_id"), (F.col("weight") / F.col("to.weight")).alias("coef"))
    theta = pool.select("col_id", "kind").join(coefs, "col_id", "left").withColumn("coef", F.coalesce("coef", F.lit(0.0)))
    norm = weights.agg(F.sqrt(F.sum(F.col("weight") * F.col("weight")))).first()[0] or 0.0
    return MasterSolution(found.status, found.objective, found.lower, found.b, norm, found.sum_xi, found.epochs, theta, weights,
                          cut_lineage(found.duals))


def solve_master_stored_slack(pool: DataFrame, pool_w: DataFrame, pool_xi: DataFrame, cost: float = 1.0,
                              tol: float = 1e-4) -> tuple[DataFrame, float, float]:
    """Convex master with stored slacks: min |W theta| + C*sum_k theta_k*sum(xi^k).

    ``pool_xi`` is (col_id, row_id, xi).  No data row is touched.  Returns
    (theta, objective, lower bound).
    """
    spark = pool.sparkSession
    slack = (pool.select("col_id").join(pool_xi.groupBy("col_id").agg(F.sum("xi").alias("s")), "col_id", "left")
             .limit(MAX_GRAM_COLUMNS + 1).toPandas().sort_values("col_id"))
    names = slack["col_id"].to_list()
    place = {n: k for k, n in enumerate(names)}
    gram = np.zeros((len(names), len(names)))
    dots = gram_matrix(pool_w, names).toPandas()
    i, j = dots["k1"].map(place).to_numpy(int), dots["k2"].map(place).to_numpy(int)
    gram[i, j] = gram[j, i] = dots["dot"].to_numpy()
    linear = cost * slack["s"].fillna(0.0).to_numpy()
    rays = np.zeros(len(names), bool)

    def no_rows(points, width, after=None):
        m, size = len(points), len(names)
        return {"hinge": np.zeros(m), "smooth": np.zeros(m), "mass": np.zeros(2), "pos": np.zeros(size),
                "neg": np.zeros(size), "curvature": np.zeros((size + 1, size + 1))}

    def bound(q, total, point):
        x = point[:-1]
        length = np.sqrt(max(x @ gram @ x, 0.0))
        return (gram @ x / length + linear if length > 1e-12 else linear).min()

    found = minimise(no_rows, Regulariser(gram, linear=linear), combination_set("convexo", rays),
                     np.append(np.full(len(names), 1.0 / len(names)), 0.0), cost, bound, tol, 400)
    theta = spark.createDataFrame(list(zip(names, found.point[:-1].tolist())), "col_id string, coef double")
    return theta, found.objective, found.lower


def hull_membership(new_w: DataFrame, pool: DataFrame, pool_w: DataFrame, combination: str = "convexo",
                    tol: float = 1e-6) -> tuple[bool, float]:
    """Is the column ``new_w`` (feature_id, weight) a combination of the pool?

    Returns (inside, residual) with residual = |W theta - w| / max(1, |w|) at
    the best theta, from inner products alone.
    """
    candidate = new_w.select(F.lit("~new").alias("col_id"), "feature_id", "weight")
    names = sorted(r["col_id"] for r in pool.select("col_id").limit(MAX_GRAM_COLUMNS + 1).collect())
    if not names:
        return False, float("inf")
    place = {n: k for k, n in enumerate([*names, "~new"])}
    dots = gram_matrix(pool_w.unionByName(candidate), list(place)).toPandas()
    gram = np.zeros((len(place), len(place)))
    i, j = dots["k1"].map(place).to_numpy(int), dots["k2"].map(place).to_numpy(int)
    gram[i, j] = gram[j, i] = dots["dot"].to_numpy()
    if gram[-1, -1] == 0:
        return False, float("inf")
    inner, q, size = gram[:-1, :-1], gram[:-1, -1], len(names)
    project = combination_set(combination, np.zeros(size, bool))
    x = project(np.full(size, 1.0 / size))
    step = 1.0 / max(np.linalg.eigvalsh(inner)[-1], 1e-12)
    ahead, pace = x, 1.0
    for _ in range(20_000):
        new = project(ahead - step * (inner @ ahead - q))
        next_pace = 0.5 * (1 + np.sqrt(1 + 4 * pace * pace))
        ahead = new + (pace - 1) / next_pace * (new - x)
        moved, x, pace = np.linalg.norm(new - x), new, next_pace
        if moved <= 1e-13 * (1 + np.linalg.norm(x)):
            break
    left = np.sqrt(max(x @ inner @ x - 2 * q @ x + gram[-1, -1], 0.0)) / max(1.0, np.sqrt(gram[-1, -1]))
    # inner products carry rounding noise of about the square root of the precision
    return bool(left <= max(tol, 1e-7)), float(left)
