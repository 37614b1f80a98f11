"""Column generation: master, gradient, pricing or screening, pruning, until a stopping rule holds."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, functions as F, types as T

from widemargin.operators import bounds as D, history as H, metrics as M, screening as S
from widemargin.operators.master import MasterSolution, MasterState
from widemargin.operators.pool import (POOL_SCHEMA, column_signatures, existing_pairs, sample_unit_columns,
                                       unit_columns)
from widemargin.operators.ascent import StoredMatrix
from widemargin.operators.pricing import NARROW_FEATURES, UnitRows, price_column
from widemargin.operators.svm import feature_list
from widemargin.session import cut_lineage
from widemargin.sources.artifacts import RESUME_TABLES, STATE_TABLES, pool_checkpoint, pool_restore

ITERATION_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("iter", T.IntegerType()),
    T.StructField("ub", T.DoubleType()), T.StructField("lb", T.DoubleType()),
    T.StructField("n_points", T.IntegerType()), T.StructField("n_rays", T.IntegerType()),
    T.StructField("n_added", T.IntegerType()), T.StructField("n_removed", T.IntegerType()),
    T.StructField("step", T.StringType()), T.StructField("status", T.StringType()),
])
HISTORY_SCHEMA = "run_id string, iter int, col_id string, kind string, coef double, event string"
#: numbers of the last solution that a resumed run needs
_SOLVED = ("status", "objective", "lower", "b", "norm_w", "sum_xi", "passes")


@dataclass
class Settings:
    """How a run behaves; the defaults are those of the plain loop."""

    combination: str = "convexo"
    cost: float = 1.0
    m_box: float | None = 1e4
    pricing_box: float | None = None      # None: the master's box
    cut: str | None = None
    gradient: str = "full_gradient"       # or "alpha_only"
    smoothing: float = 0.0
    scale_above: float | None = None      # scale the gradient to unit length above this norm
    tol: float = 1e-6                     # stop tolerance on gap and change
    master_tol: float = 1e-3
    pricing_tol: float = 1e-2
    max_iter: int = 10
    idle_threshold: float = 1e-6
    idle_periods: int = 5
    check_every: int = 5
    prune: bool = True
    flat_from: int = 2
    # screening
    screen_k: int = 25
    screen_eps: float = 1e-8
    # hybrid: screening by default, pricing every so often or after flat steps
    hybrid: bool = False
    pricing_every: int = 5
    patience: int = 2
    # points and rays
    max_rays: int = 0
    adaptive_tolerance: bool = False
    # stop when a priced column is already in the pool
    stop_on_repeat: bool = False


@dataclass
class Run:
    run_id: str
    settings: Settings
    pool: DataFrame
    pool_w: DataFrame
    solution: MasterSolution
    status: str
    iterations: list[dict]
    history: list[tuple]
    n_init: int
    generated: list[str]
    removed: list[str]
    spark: object = field(repr=False, default=None)
    error: str | None = None               # what ended the run, with a FAILURE status

    def run_iterations(self) -> DataFrame:
        rows = [tuple(r.get(f.name) for f in ITERATION_SCHEMA) for r in self.iterations]
        return self.spark.createDataFrame(rows, ITERATION_SCHEMA)

    def theta_history(self) -> DataFrame:
        return self.spark.createDataFrame(self.history, HISTORY_SCHEMA)


class _Loop:
    def __init__(self, matrix, labels, pool, pool_w, settings: Settings, run_id: str, state_dir: str | None,
                 resume_from: str | None = None):
        self.spark, self.labels, self.s = matrix.sparkSession, labels, settings
        self.run_id, self.state_dir = run_id, state_dir
        self.state = MasterState(matrix, labels, settings.cost)
        # the row-partitioned copy serves every join on row_id
        self.matrix = matrix = self.state.matrix
        saved = pool_restore(self.spark, resume_from, STATE_TABLES + RESUME_TABLES) if resume_from else None
        if saved:
            pool, pool_w = saved["pool"], saved["pool_w"]
        self.state.add(pool, pool_w)
        self.n_init = len(self.state.columns)
        self.gradient: DataFrame | None = None
        self.solution: MasterSolution | None = None
        self.iterations, self.history, self.generated, self.removed = [], [], [], []
        self.periods, self.m_box, self.tol = float(settings.idle_periods), settings.m_box, settings.master_tol
        self.first, self.flat, self.added_last, self.lb_best = 0, 0, None, None
        self.last_good, self.error = None, None
        if saved:
            self.restore(saved)
        # at most this many features: the unit rows are packed once for all pricing calls
        few = feature_list(matrix, NARROW_FEATURES)
        self.unit_rows = UnitRows(matrix, labels, few) if few is not None else None
        # else pricing reads the copy by feature that the master reads too
        self.stored = StoredMatrix(matrix, labels, self.state.hot, by_feature=self.state.by_feature) if few is None else None

    # ------------------------------------------------------------ steps
    def theta_history(self) -> DataFrame:
        return self.spark.createDataFrame(self.history, HISTORY_SCHEMA)

    def run_iterations(self) -> DataFrame:
        rows = [tuple(r.get(f.name) for f in ITERATION_SCHEMA) for r in self.iterations]
        return self.spark.createDataFrame(rows, ITERATION_SCHEMA)

    def prune(self):
        # pool-sized: one row per idle column
        idle = H.idle_columns(self.theta_history(), int(self.periods), self.s.idle_threshold).collect()
        gone = sorted(r["col_id"] for r in idle if r["col_id"] in self.state.active)
        # never drop the last column
        gone = gone[:max(0, len(self.state.active) - 1)]
        kinds = {c["col_id"]: c["kind"] for c in self.state.columns}
        self.state.drop(gone)
        self.removed += gone
        self.history += [(self.run_id, self.i, c, kinds[c], None, "removed") for c in gone]
        return len(gone)

    def master(self):
        start = self.solution.coefficients if self.solution else None
        found = self.state.solve(self.s.combination, self.m_box, tol=self.tol, start=start)
        kinds = {c["col_id"]: c["kind"] for c in self.state.columns if c["col_id"] in self.state.active}
        self.kept_point = False
        if self.solution is not None and found.objective > self.solution.objective:
            # the solve starts at the last point, so only rows of the box make it rise; that point is still
            # allowed unless one of its columns was pruned.  The point is kept whole, duals and bound are the new ones.
            last = self.solution
            names = {k for k, v in last.coefficients.items() if k not in ("b", "width") and v}
            if names <= self.state.active:
                self.kept_point = True
                theta = [(c, k, float(last.coefficients.get(c, 0.0))) for c, k in kinds.items()]
                found = replace(found, objective=last.objective, b=last.b, norm_w=last.norm_w, sum_xi=last.sum_xi,
                                weights=last.weights, theta=self.spark.createDataFrame(theta, "col_id string, kind string, coef double"),
                                coefficients={**{c: v for c, _, v in theta}, "b": last.b, "width": found.coefficients["width"]})
        self.solution = found
        self.history += [(self.run_id, self.i, c, k, float(found.coefficients.get(c, 0.0)), None) for c, k in kinds.items()]
        return found

    def next_gradient(self):
        duals = cut_lineage(D.equalised_duals(self.solution.duals))
        full = cut_lineage(D.master_gradient(self.matrix, duals, self.solution.weights))
        # proven bound of the whole problem from the repaired duals
        norm = full.agg(F.sqrt(F.sum(F.col("s") * F.col("s")))).first()[0] or 0.0
        total = duals.agg(F.sum("pi")).first()[0] or 0.0
        current = D.choose_gradient(full, self.s.gradient)
        if self.s.smoothing > 0 and self.gradient is not None:
            current = cut_lineage(D.smooth_gradient(self.gradient, current, self.s.smoothing))
        self.gradient = current
        return float(total / max(1.0, norm))

    def direction(self):
        if self.s.combination == "conico":
            return D.scale_gradient(self.gradient, above=1e-8)
        if self.s.scale_above is not None:
            return D.scale_gradient(self.gradient, above=self.s.scale_above)
        return self.gradient

    def _append(self, pool, pool_w) -> list[str]:
        added = self.state.add(pool, pool_w)
        self.generated += added
        return added

    def price(self):
        """Ids of the priced column and, with max_rays, of the unit rays of its large weights."""
        box = self.s.pricing_box if self.s.pricing_box is not None else self.m_box
        if box is None and self.s.m_box is not None:
            # the schedule dropped the master's box: pricing still needs one
            box = H.FREE_PRICING_BOX
        column = price_column(self.matrix, self.labels, self.direction(), self.s.cost, box, self.s.cut,
                              self.s.pricing_tol, unit_rows=self.unit_rows, stored=self.stored)
        if column.norm_w <= 1e-9:
            return []
        weights = column.weights
        if self.s.combination == "conico":
            weights = weights.withColumn("weight", F.col("weight") / column.norm_w)
        name = f"p_{self.run_id}_{self.i:03d}"
        pool = self.spark.createDataFrame([(name, "point", "pricing", self.i, column.b)], POOL_SCHEMA)
        pool_w = weights.select(F.lit(name).alias("col_id"), "feature_id", "weight")
        if self.s.stop_on_repeat and self._known(pool, pool_w):
            return []
        if self.s.max_rays:
            known = existing_pairs(self.state.frames()[1])
            fresh = (S.rays_from_large_weights(column.weights, self.s.max_rays).select("feature_id", "sign")
                     .join(known, ["feature_id", "sign"], "left_anti"))
            rays, rays_w = unit_columns(cut_lineage(fresh), "ray", "acceleration", self.i)
            pool, pool_w = pool.unionByName(rays), pool_w.unionByName(rays_w)
        return self._append(pool, pool_w)

    def _known(self, pool, pool_w) -> bool:
        """Is the one column of ``pool`` equal to a column of the pool?"""
        content = ["n_weights", "h1", "h2", "h3"]
        old = column_signatures(*self.state.frames())
        return bool(column_signatures(pool, pool_w).join(old.select(*content), content, "left_semi").limit(1).collect())

    def screen(self, kind="point"):
        duals = self.solution.duals.select("row_id", (F.col("y") * F.col("pi")).alias("v"))
        alpha = D.cone_dual(self.solution.weights)
        known = existing_pairs(self.state.frames()[1]).withColumn("sign", -F.col("sign"))
        hits = S.screen_features(self.matrix, duals, alpha, self.s.screen_eps, self.s.screen_k, known)
        chosen = cut_lineage(hits.select("feature_id", F.col("sign_descent").alias("sign")))
        return self._append(*unit_columns(chosen, kind, "screening", self.i))

    def gradient_ray(self):
        name = f"r_grad_{self.i}"
        ray = cut_lineage(S.gradient_ray(self.gradient).where(F.col("weight") != 0)
                          .select(F.lit(name).alias("col_id"), "feature_id", "weight"))
        pool = self.spark.createDataFrame([(name, "ray", "gradient", self.i, 0.0)], POOL_SCHEMA)
        return self._append(pool, ray)

    def adapt(self):
        """Tolerance, window and box by the schedule's mode at the last change of the objective.

        The schedule's own tolerances are those of an exact solver; here they scale the proven gap.
        """
        if len(self.iterations) < 2:
            return
        now = H.tolerance_schedule(self.run_iterations()).where(F.col("iter") == self.iterations[-1]["iter"]).first()
        if now["mode"] is None:
            return
        self.tol = {"coarse": max(self.s.master_tol, 1e-2), "medium": self.s.master_tol, "fine": 0.1 * self.s.master_tol}[now["mode"]]
        self.periods *= now["window_factor"]
        if now["drop_box"]:
            self.m_box = None

    def stop_rule(self) -> str | None:
        """The rule that ends the run at the current iteration."""
        marked = H.stop_rules(self.run_iterations(), self.s.tol, self.s.max_iter, self.s.flat_from)
        return marked.where(F.col("iter") == self.i).first()["stop"]

    # ------------------------------------------------------------ loop
    def run(self) -> Run:
        s, status = self.s, "max_iter"
        for self.i in range(self.first, s.max_iter + 1):
            begun = self.progress()
            if s.adaptive_tolerance:
                self.adapt()
            n_removed = 0
            if s.prune and self.i > 0 and self.i % s.check_every == 0 and self.i != s.max_iter:
                n_removed = self.prune()
            before = self.iterations[-1]["ub"] if self.iterations else None
            # a failing solve ends the run with what it has: the last solution, its pool and its bounds
            try:
                found = self.master()
                lb = self.next_gradient()
            except Exception as problem:
                status, self.error = "MASTER_FAILURE", f"{type(problem).__name__}: {str(problem)[:500]}"
                self.solution = self.solution if before is None else self.last_good
                self.iterations.append({"run_id": self.run_id, "iter": self.i, "n_added": 0, "n_removed": n_removed, "step": "none", "status": status})
                break
            self.last_good = found
            self.lb_best = lb if self.lb_best is None else max(self.lb_best, lb)
            kinds = [c["kind"] for c in self.state.columns if c["col_id"] in self.state.active]
            row = {"run_id": self.run_id, "iter": self.i, "ub": float(found.objective), "lb": float(self.lb_best),
                   "n_points": sum(k != "ray" for k in kinds), "n_rays": sum(k == "ray" for k in kinds),
                   "n_added": 0, "n_removed": n_removed, "step": "none", "status": found.status}
            if not math.isfinite(found.objective):
                row["ub"] = None
            self.iterations.append(row)
            change = abs(found.objective - before) if before is not None else None
            self.flat = self.flat + 1 if change is not None and change <= s.tol else 0
            rule = self.stop_rule()
            if rule == "optimo" and (s.hybrid or self.kept_point):
                # the hybrid loop has its own patience; a kept point is no flat solve
                rule = "max_iter" if self.i >= s.max_iter else None
            if rule is None and s.hybrid and self.flat >= max(s.idle_periods, s.patience):
                rule = "optimo"
            if rule is not None:
                status = rule
                break
            use_pricing = (not s.hybrid or (s.pricing_every and self.i > 0 and self.i % s.pricing_every == 0)
                           or self.flat >= s.patience or self.added_last == 0)
            if use_pricing:
                row["step"] = "pricing"
                try:
                    added = self.price()
                except Exception as problem:
                    # the reduced costs need no solve: screening takes the place of a pricing that fails
                    self.error = f"{type(problem).__name__}: {str(problem)[:500]}"
                    added = self.screen("ray" if s.max_rays else "point")
                    row["step"] = "screening_after_failure"
                    if not added:
                        status = "PRICING_FAILURE"
                        break
                if not added and s.stop_on_repeat:
                    status = "repeated_column"
                    break
                if not added:
                    added = self.screen("ray" if s.max_rays else "point")
                    row["step"] = "screening_fallback"
                if not added and s.max_rays:
                    added = self.gradient_ray()
                    row["step"] = "gradient_ray"
                if not added and s.hybrid and self.flat >= s.patience:
                    status = "optimo"
                    break
            else:
                added = self.screen()
                row["step"] = "screening"
            row["n_added"] = self.added_last = len(added)
            if self.state_dir:
                self.save(self.i + 1, self.progress())
        else:
            begun = None
        if self.state_dir and begun is not None and self.solution is not None:
            # a run that goes on from here repeats the step at which this one stopped
            self.save(self.i, begun)
        if self.unit_rows is not None:
            self.unit_rows.release()
        pool, pool_w = self.state.frames()
        return Run(self.run_id, s, pool, pool_w, self.solution, status, self.iterations, self.history, self.n_init,
                   self.generated, self.removed, self.spark, self.error)

    def progress(self) -> dict:
        """What a step hands to the next one, besides tables and the solution."""
        return {"flat": self.flat, "added_last": self.added_last, "lb_best": self.lb_best, "periods": self.periods,
                "m_box": self.m_box, "tol": self.tol}

    def save(self, following: int, progress: dict):
        """Writes the state from which ``resume_from`` goes on with step ``following``."""
        pool, pool_w = self.state.frames()
        found = self.solution
        facts = {"following": following, "n_init": self.n_init, "generated": self.generated, "removed": self.removed,
                 "progress": progress, "solved": {n: getattr(found, n) for n in _SOLVED}}
        one = self.spark.createDataFrame
        pool_checkpoint({"pool": pool, "pool_w": pool_w, "theta_history": self.theta_history(),
                         "run_iterations": self.run_iterations(), "weights": found.weights, "duals": found.duals,
                         "coefficients": one([(k, float(v)) for k, v in found.coefficients.items()], "name string, value double"),
                         "gradient": self.gradient, "facts": one([(self.i, json.dumps(facts, default=float))], "iter int, facts string")},
                        self.state_dir, self.run_id, self.i)

    def restore(self, saved: dict[str, DataFrame]):
        facts = json.loads(saved["facts"].first()["facts"])
        self.first, self.n_init = facts["following"], facts["n_init"]
        self.generated, self.removed = facts["generated"], facts["removed"]
        for name, value in facts["progress"].items():
            setattr(self, name, value)
        # one row per step, and per step and column: as large as the run keeps on the driver anyway
        self.iterations = [r.asDict() for r in saved["run_iterations"].orderBy("iter").collect() if r["iter"] < self.first]
        self.history = [tuple(r) for r in saved["theta_history"].orderBy("iter").collect()
                        if r["iter"] < self.first or r["event"] == "removed"]
        self.state.retired = set(self.removed)
        self.gradient = saved["gradient"]
        coefficients = {r["name"]: r["value"] for r in saved["coefficients"].collect()}
        kinds = [(c["col_id"], c["kind"], coefficients.get(c["col_id"], 0.0)) for c in self.state.columns]
        self.solution = MasterSolution(**facts["solved"], theta=self.spark.createDataFrame(kinds, "col_id string, kind string, coef double"),
                                       weights=saved["weights"], duals=saved["duals"], coefficients=coefficients)


def column_generation(matrix: DataFrame, labels: DataFrame, pool: DataFrame, pool_w: DataFrame,
                      settings: Settings | None = None, run_id: str = "run", state_dir: str | None = None,
                      resume_from: str | None = None) -> Run:
    """The plain loop: master, stop tests, pricing; idle columns are pruned now and then.

    With ``state_dir`` every step is saved.  ``resume_from``, a folder that
    ``last_checkpoint`` finds there, goes on with the step after it; ``pool`` is not read then.
    """
    return _Loop(matrix, labels, pool, pool_w, settings or Settings(), run_id, state_dir, resume_from).run()


def column_generation_hybrid(matrix, labels, pool, pool_w, settings: Settings | None = None, **options) -> Run:
    """Screening by default; pricing every few steps, after flat steps, or when nothing was added."""
    s = settings or Settings()
    return column_generation(matrix, labels, pool, pool_w, Settings(**{**s.__dict__, "hybrid": True}), **options)


def column_generation_points_rays(matrix, labels, pool, pool_w, settings: Settings | None = None, **options) -> Run:
    """Points under the combination type and rays with non-negative coefficients, with extra rays per step."""
    s = settings or Settings()
    extra = {"max_rays": s.max_rays or 20, "scale_above": s.scale_above or 10.0, "adaptive_tolerance": True,
             "flat_from": H.FLAT_FROM_ITER["points_rays"]}
    return column_generation(matrix, labels, pool, pool_w, Settings(**{**s.__dict__, **extra}), **options)


def column_generation_basic(matrix, labels, pool, pool_w, settings: Settings | None = None, **options) -> Run:
    """No pruning; stops on a flat objective, a repeated column or the iteration limit."""
    s = settings or Settings()
    return column_generation(matrix, labels, pool, pool_w,
                             Settings(**{**s.__dict__, "prune": False, "stop_on_repeat": True}), **options)


def pool_prefilter(matrix, labels, pools: list[tuple[DataFrame, DataFrame]], tol: float = 1e-6,
                   cost: float = 1.0, m_box: float | None = 1e4, gap: float = 1e-3):
    """Merge pools, solve a conic master and keep the columns it uses: (pool, pool_w, solution)."""
    state = MasterState(matrix, labels, cost)
    for pool, pool_w in pools:
        state.add(pool, pool_w)
    found = state.solve("conico", m_box, tol=gap)
    used = {k for k, v in found.coefficients.items() if k not in ("b", "width") and abs(v) > tol}
    state.drop({c["col_id"] for c in state.columns} - used)
    pool, pool_w = state.frames()
    return pool, pool_w, found


def final_refit(matrix, labels, run_pool, run_pool_w, combination: str = "convexo", cost: float = 1.0,
                m_box: float | None = None, gap: float = 1e-3) -> MasterSolution:
    """The master once more on the final pool."""
    state = MasterState(matrix, labels, cost)
    state.add(run_pool, run_pool_w)
    return state.solve(combination, m_box, tol=gap)


def run_once(train: tuple[DataFrame, DataFrame], test: tuple[DataFrame, DataFrame], settings: Settings,
             pool: tuple[DataFrame, DataFrame] | None = None, share: float = 0.1, run_id: str = "run") -> DataFrame:
    """One measured run: fit, refit, predict the test rows, one row of results.

    ``train`` and ``test`` are (matrix, labels).  Without a pool it starts from
    the zero column and unit columns of a share of the features.
    """
    matrix, labels = train
    features = matrix.select("feature_id").distinct()
    n_features = features.count()
    start = pool or sample_unit_columns(features, share)
    planned = Settings(**{**settings.__dict__, "idle_threshold": 1.0 / (10.0 * n_features),
                          "idle_periods": max(1, settings.max_iter // 10), "check_every": max(1, settings.max_iter // 5)})
    run = column_generation(matrix, labels, *start, planned, run_id=run_id)
    refit = final_refit(matrix, labels, run.pool, run.pool_w, settings.combination, settings.cost, settings.m_box,
                        settings.master_tol)
    scored = M.margins_slacks(M.predict(M.scores(test[1], test[0], refit.weights, refit.b), zero_as=-1))
    summary = M.fit_summary(scored, refit.weights, scored, settings.cost, settings.tol)
    stats = H.theta_stats(run.theta_history()).drop("run_id")
    last = run.iterations[-1]
    one = F.lit(1)
    facts = summary.withColumn("_one", one).join(stats.withColumn("_one", one), "_one").drop("_one")
    return facts.select(
        F.lit(run_id).alias("run_id"), F.lit(settings.combination).alias("tipo"),
        F.lit(settings.cut or "caja").alias("pricing"), F.lit(last["iter"]).alias("iters"),
        F.lit(run.status).alias("status"), F.lit(float(refit.objective)).alias("train_objective"),
        F.lit(float(last["lb"])).alias("train_lower"), F.lit(run.n_init).alias("n_columns_init"),
        F.lit(len(refit.coefficients) - 2).alias("n_columns_final"),
        F.lit(len(run.generated)).alias("n_generated"), F.lit(len(run.removed)).alias("n_eliminated_total"),
        "accuracy", "f1_macro", "f1_weighted", "norm_w", "sum_xi", "positive_slacks", "obj_val",
        "theta_last_active", "theta_last_nonzero", "theta_last_max", "theta_last_min")
