"""Whitening of embeddings with eigenvectors refined from float32 to double precision.

The fit list is every distinct integer vector x = floor(64*c) + 1000000.  Its sums and its scatter matrix are sums of
exact integers over all tasks: entries are centred by the rounded mean before they are multiplied, and what the rounding
leaves, less than half a unit, is taken off exactly on the driver.  The driver holds what has the size of the dimension:
sums, one covariance matrix, its eigenvectors.

The eigenvectors start as float32 ones.  Ogita-Aishima iterations, matrix products in extended precision, then square
their error at each turn.  Eigenvalues that lie closer together than the present error form a cluster, whose vectors
the iteration alone cannot tell apart: the matrix, shifted by the cluster's mean and projected on its vectors, is solved by
itself, and the iteration goes on with the vectors turned accordingly.

Rows whose vector is null or holds a null or non-finite entry are dropped; a row with a null id stays.  A vector that
ends earlier counts as c = 0 behind its end; entries beyond 2**53 / 64 count as that bound.  Repeated rows each get their
result, and count once in the fit list.  A component without variance, as with one distinct vector, has null as
``whitened``; without any variance ``explained`` and ``identity_error`` are null too.  ``deviation`` is null where it
exceeds a long.  The sign of a component is that of its largest entry, the first of equal ones.  Components of equal
eigenvalues are any orthonormal basis, the same for all rows.  Columns besides the id and the vector are not read; an
empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from widemargin.llm.common import small_batches, staged
from widemargin.llm.vectors import matrix, usable

SCALE, SHIFT = 64, 1_000_000
#: Entries behind this many units from the mean are summed in double precision instead of exactly.
_EXACT = 1 << 20
_BOUND = float(1 << 53)
_LOW = (1 << 31) - 1
_ROUNDS = 12
SCHEMA = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


@dataclass
class Whitening:
    """The fit: integers n and sums, the rounded mean, and the components as columns."""

    n: int
    sums: np.ndarray        # Python integers
    centre: np.ndarray      # int64, sums / n rounded
    values: np.ndarray      # eigenvalues, falling
    vectors: np.ndarray     # width x components
    trace: float
    identity_error: float | None = None

    @property
    def rest(self) -> np.ndarray:
        """sums / n - centre."""
        return np.array([(s - self.n * int(c)) / self.n for s, c in zip(self.sums, self.centre)])

    @property
    def live(self) -> np.ndarray:
        """Components that have variance, beyond what rounding leaves of none."""
        return self.values > len(self.sums) * 1e-17 * max(self.trace, 0.0)

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates of integer vectors; NaN for components without variance."""
        factor = np.full(len(self.values), np.nan)
        factor[self.live] = 1 / np.sqrt(self.values[self.live])
        return ((x - self.centre).astype(float) - self.rest) @ self.vectors * factor

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """sum((n*x - sums)**2), exact, as Python integers or int64."""
        off = np.array([s - self.n * int(c) for s, c in zip(self.sums, self.centre)], dtype=object)
        far = max(1, int(np.abs(x - self.centre).max(initial=0))) * self.n + max(map(abs, off), default=0)
        kind = np.int64 if far * far * max(1, len(off)) < 1 << 63 else object
        return ((self.n * (x - self.centre).astype(kind) - off.astype(kind)) ** 2).sum(1)


def eigenvectors(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, vectors as columns) of a symmetric matrix, to double precision."""
    high = np.longdouble
    a = np.asarray(covariance, dtype=high)
    size = np.abs(a).max(initial=0)
    if not size:
        return np.zeros(len(a)), np.eye(len(a))
    a = (a + a.T) / (2 * size)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(high)
    eye, norm = np.eye(len(a), dtype=high), np.sqrt((a * a).sum())
    for turn in range(_ROUNDS):
        r, s = eye - x.T @ x, x.T @ a @ x
        r, s = (r + r.T) / 2, (s + s.T) / 2
        value = np.diag(s) / (1 - np.diag(r))
        delta = 2 * (np.sqrt(((s - np.diag(value)) ** 2).sum()) + norm * np.sqrt((r * r).sum()))
        gap = value[None, :] - value[:, None]
        near = np.abs(gap) <= delta
        # half of r mends the lengths and right angles; the rest is a rotation, exactly antisymmetric
        mean = (value[None, :] + value[:, None]) / 2
        step = r / 2 + np.where(near, 0, (s + mean * r) / np.where(near, 1, gap))
        x = x + x @ step
        for own in clusters(value, delta):
            x[:, own] = x[:, own] @ turned(a, x[:, own], value[own].mean())
        if np.abs(step).max() < 1e-17 and turn:
            break
    value = np.einsum("ij,ij->j", x, a @ x) / np.einsum("ij,ij->j", x, x)
    x, order = x / np.sqrt((x * x).sum(0)), np.argsort(-value, kind="stable")
    x = x[:, order]
    x = x * np.where(x[np.abs(x).argmax(0), np.arange(x.shape[1])] < 0, -1, 1)
    return (value[order] * size).astype(float), x.astype(float)


def clusters(value: np.ndarray, delta: float) -> list[np.ndarray]:
    """Index lists of eigenvalues whose neighbours are not further than ``delta``."""
    order = np.argsort(value)
    parts = np.split(order, np.flatnonzero(np.diff(value[order]) > delta) + 1)
    return [p for p in parts if len(p) > 1]


def turned(a: np.ndarray, x: np.ndarray, mean) -> np.ndarray:
    """Rotation of a cluster's vectors: the shifted matrix, seen in their span, solved by itself."""
    inner = x.T @ (a @ x - mean * x)
    inner = (inner + inner.T) / 2
    size = np.abs(inner).max()
    if size <= 1e-18:  # one eigenvalue several times: any basis will do
        return np.eye(x.shape[1], dtype=x.dtype)
    return np.linalg.eigh((inner / size).astype(float))[1].astype(x.dtype)


def integers(vectors: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(vec_id, x) of the rows that stay."""
    def cell(c):
        return F.greatest(F.least(F.floor(F.least(F.greatest(c.cast("double") * scale, F.lit(-_BOUND)), F.lit(_BOUND))), F.lit(1 << 53)),
                          F.lit(-(1 << 53))) + F.lit(shift).cast("long")
    return vectors.where(usable("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", cell).alias("x"))


def _added(name: str, rows: DataFrame, keys: list[str]) -> list:
    """Sums of (keys, high, low, rest) over all tasks; as many rows as the dimension, or its square, allows."""
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    return rows.groupBy(*keys).agg(wide("high"), wide("low"), F.sum("rest").alias("rest")).orderBy(*keys).collect()


def _sums(fit: DataFrame, width: int, shift: int) -> tuple[int, np.ndarray]:
    def partial(batches):
        import pyarrow as pa
        high, low = np.zeros(width + 1, np.int64), np.zeros(width + 1, np.int64)
        for batch in batches:
            x = matrix(batch.column("x"), width, shift, np.int64)
            high[:width] += (x >> 31).sum(0)
            low[:width] += (x & _LOW).sum(0)
            low[width] += len(x)
        yield pa.RecordBatch.from_pydict({"i": np.arange(width + 1, dtype=np.int32), "high": high, "low": low, "rest": np.zeros(width + 1)})

    found = _added("sums", fit.mapInArrow(partial, "i int, high long, low long, rest double"), ["i"])
    total = [(int(r["high"]) << 31) + int(r["low"]) for r in found] or [0] * (width + 1)
    return total[width], np.array(total[:width], dtype=object)


def _scatter(fit: DataFrame, width: int, shift: int, centre: np.ndarray) -> np.ndarray:
    """sum((x - centre)(x - centre)') as Python integers, or fractions of them where entries are very large."""
    def partial(batches):
        import pyarrow as pa
        high, low, rest = (np.zeros((width, width), kind) for kind in (np.int64, np.int64, np.float64))
        for batch in batches:
            y = matrix(batch.column("x"), width, shift, np.int64) - centre
            far = (np.abs(y) >= _EXACT).any(1)
            for k in range(0, len(y), 4096):  # 4096 products below 2**40 add up exactly
                part = y[k:k + 4096][~far[k:k + 4096]].astype(float)
                product = (part.T @ part).astype(np.int64)
                high += product >> 31
                low += product & _LOW
            rest += y[far].astype(float).T @ y[far].astype(float)
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_pydict({"i": i.astype(np.int32), "j": j.astype(np.int32), "high": high[i, j], "low": low[i, j], "rest": rest[i, j]})

    found = _added("scatter", fit.mapInArrow(partial, "i int, j int, high long, low long, rest double"), ["i", "j"])
    out = np.zeros((width, width), dtype=object)
    for r in found:
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = (int(r["high"]) << 31) + int(r["low"]) + (int(r["rest"]) if r["rest"] else 0)
    return out


def fit_whitening(rows: DataFrame, components: int = 16, shift: int = SHIFT) -> Whitening | None:
    """Fits on the distinct vectors of (vec_id, x); None without any vector that has entries."""
    small_batches(rows.sparkSession)
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    if not width:
        return None
    # the same vector may be many rows: they are combined before the shuffle
    filled = F.concat("x", F.array_repeat(F.lit(shift).cast("long"), F.lit(width) - F.size("x")))
    fit = staged(rows.select(filled.alias("x")).distinct())
    n, sums = _sums(fit, width, shift)
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    off = np.array([s - n * int(c) for s, c in zip(sums, centre)], dtype=object)
    exact = n * _scatter(fit, width, shift, centre) - off[:, None] * off[None, :]
    covariance = np.array([np.longdouble(int(v)) for v in exact.ravel()], np.longdouble).reshape(width, width) / (np.longdouble(n) * n)
    values, vectors = eigenvectors(covariance)
    out = Whitening(n, sums, centre, values[:components], vectors[:, :components], float(np.trace(covariance)))
    out.identity_error = _identity_error(fit, out, width, shift)
    return out


def _identity_error(fit: DataFrame, model: Whitening, width: int, shift: int) -> float | None:
    """Largest entry of the whitened vectors' covariance minus the identity, measured on the whole fit list."""
    live = np.flatnonzero(model.live)
    if not len(live):
        return None

    def partial(batches):
        import pyarrow as pa
        total = np.zeros((len(live) + 1, len(live)))
        for batch in batches:
            w = model.apply(matrix(batch.column("x"), width, shift, np.int64))[:, live]
            total[:-1] += w.T @ w
            total[-1] += w.sum(0)
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_pydict({"i": i.ravel().astype(np.int32), "j": j.ravel().astype(np.int32), "v": total.ravel()})

    found = fit.mapInArrow(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).orderBy("i", "j").collect()
    total = np.array([r["v"] for r in found]).reshape(len(live) + 1, len(live)) / model.n
    return float(np.abs(total[:-1] - np.outer(total[-1], total[-1]) - np.eye(len(live))).max())


def whiten(vectors: DataFrame, components: int = 16, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every row that stays."""
    rows = integers(vectors, scale, shift)
    model = fit_whitening(rows, components, shift)
    if model is None:
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    width, k = len(model.sums), len(model.values)
    explained = [float(v / model.trace) if model.trace > 0 else None for v in model.values]

    def out(batches):
        import pyarrow as pa
        for batch in batches:
            x = matrix(batch.column("x"), width, shift, np.int64)
            deviation = [int(v) if v < 1 << 63 else None for v in model.deviation(x).tolist()]
            w = model.apply(x).ravel()
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(pa.array(np.repeat(np.arange(len(x)), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(w), model.n, np.int64)),
                pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k))),
                pa.array(w, mask=np.isnan(w)), pa.array(explained * len(x), pa.float64()),
                pa.array([model.identity_error] * len(w), pa.float64())],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(out, SCHEMA)
