"""Damped Newton steps for  reg(x) + C * sum(hinge)  over a convex set.

The data enters only through an evaluator that returns sums over rows, so the
same steps serve a Spark job over all rows and a small block inside one task.
The state here has the size of the pool.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

# widths of the smoothed hinge, from a curved start to a sharp end; halving keeps rows inside the curved part
WIDTHS = tuple(8.0 / 2 ** k for k in range(14))
STEPS = np.array([1.0, 0.7, 0.4, 0.2, 0.08, 0.02, 0.004])


# ------------------------------------------------------------ constraint sets
def to_simplex(v: np.ndarray) -> np.ndarray:
    """Nearest point with v >= 0 and sum 1 (sort and threshold)."""
    ordered = np.sort(v)[::-1]
    shift = (np.cumsum(ordered) - 1.0) / np.arange(1, len(v) + 1)
    return np.maximum(v - shift[np.nonzero(ordered > shift)[0][-1]], 0.0)


def combination_set(combination: str, rays: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Projection on the coefficients a combination type allows; rays are always >= 0."""
    points = ~rays
    if combination not in ("convexo", "afin", "conico", "mayor_uno", "libre"):
        raise ValueError(f"unknown combination type {combination}")

    def project(v):
        out = v.copy()
        out[rays] = np.maximum(v[rays], 0.0)
        p = v[points]
        if not len(p):
            return out
        if combination == "convexo":
            p = to_simplex(p)
        elif combination == "afin":
            p = p + (1.0 - p.sum()) / len(p)
        elif combination == "conico":
            p = np.maximum(p, 0.0)
        elif combination == "mayor_uno":
            p = np.maximum(p, 0.0) if np.maximum(p, 0.0).sum() >= 1.0 else to_simplex(p)
        out[points] = p
        return out
    return project


def box_set(m_box: float | None, direction: np.ndarray | None = None,
            cut: str | None = None) -> Callable[[np.ndarray], np.ndarray]:
    """Projection on |w| <= m_box, with the half-space cut -g.w >= 0 or the sign cut -g_j w_j >= 0."""
    high = np.inf if m_box is None else m_box
    if cut not in (None, "halfspace", "sign"):
        raise ValueError(f"unknown cut {cut}")
    if cut == "sign":
        low_j = np.where(direction < 0, 0.0, -high)
        high_j = np.where(direction > 0, 0.0, high)
        return lambda v: np.clip(v, low_j, high_j)

    def project(v):
        inside = np.clip(v, -high, high)
        if cut is None or direction @ inside <= 0:
            return inside

        def side(step):
            return direction @ np.clip(v - step * direction, -high, high)
        # the side falls along the direction, linearly between two points where a coordinate meets the box
        moving = direction != 0
        kinks = (v[moving] + np.array([[-high], [high]]) * np.sign(direction[moving])) / direction[moving]
        kinks = np.sort(kinks[np.isfinite(kinks) & (kinks > 0)]) if m_box is not None else np.empty(0)
        low, up = -1, len(kinks)
        while up - low > 1:
            mid = (low + up) // 2
            low, up = (mid, up) if side(kinks[mid]) > 0 else (low, mid)
        left = kinks[low] if low >= 0 else 0.0
        right = kinks[up] if up < len(kinks) else left + max(1.0, left)
        fall = side(left) - side(right)
        step = left + (right - left) * (side(left) / fall if fall > 0 else 1.0)
        return np.clip(v - step * direction, -high, high)
    return project


# ------------------------------------------------------------ regularisers
@dataclass
class Regulariser:
    """norm: sqrt(x'Gx);  squared: (x'Gx + b^2)/2;  none: 0 - plus linear.x + ridge*|x|^2."""

    gram: np.ndarray
    kind: str = "norm"
    linear: np.ndarray | None = None
    ridge: float = 0.0
    limits: np.ndarray | None = None   # rows a_j of a_j.x <= limit, kept by multipliers and a penalty
    limit: float = np.inf
    multipliers: np.ndarray | None = None
    penalty: float = 1e3

    def excess(self, x: np.ndarray) -> np.ndarray:
        """Per point and row: how far the row is over its limit, the share of its multiplier included."""
        return np.maximum(x @ self.limits.T - self.limit + self.multipliers / self.penalty, 0.0)

    def bounded_by_rows(self, bound: Callable) -> Callable:
        """``bound`` of the problem with the rows: their multipliers at the point are duals like those of the data."""
        def with_rows(q, total, point):
            dual = self.penalty * self.excess(point[:-1])
            return bound(q - self.limits.T @ dual, total - self.limit * dual.sum(), point)
        return with_rows

    def value(self, points, delta=0.0, with_ridge=True):
        x = points[:, :-1]
        quad = np.maximum(np.einsum("ij,jk,ik->i", x, self.gram, x), 0.0)
        out = np.sqrt(quad + delta * delta) - delta if self.kind == "norm" else (
            0.5 * (quad + points[:, -1] ** 2) if self.kind == "squared" else np.zeros(len(x)))
        if self.linear is not None:
            out = out + x @ self.linear
        if self.limits is not None:
            over = self.excess(x)
            out = out + 0.5 * (self.penalty * (over * over).sum(axis=1) - (self.multipliers ** 2).sum() / self.penalty)
        return out + self.ridge * (x * x).sum(axis=1) if with_ridge else out

    def slope_bend(self, point, delta):
        size = len(point)
        x, slope, bend = point[:-1], np.zeros(size), np.zeros((size, size))
        gx = self.gram @ x
        if self.kind == "norm":
            length = np.sqrt(max(x @ gx, 0.0) + delta * delta)
            slope[:-1] = gx / length
            bend[:-1, :-1] = self.gram / length - np.outer(gx, gx) / length ** 3
        elif self.kind == "squared":
            slope[:-1], slope[-1] = gx, point[-1]
            bend[:-1, :-1], bend[-1, -1] = self.gram, 1.0
        if self.linear is not None:
            slope[:-1] += self.linear
        if self.limits is not None:
            over = self.excess(x)
            slope[:-1] += self.penalty * self.limits.T @ over
            hit = self.limits[over != 0]
            bend[:-1, :-1] += self.penalty * hit.T @ hit
        slope[:-1] += 2 * self.ridge * x
        bend[:-1, :-1] += 2 * self.ridge * np.eye(size - 1)
        return slope, bend


def quadratic_step(bend, slope, start, project, rounds=400):
    """min slope.d + d'Bd/2 with start+d in the set: operator splitting on one eigenbasis."""
    # the plain Newton point is the answer when it lies in the set
    free = start - np.linalg.solve(bend, slope)
    clipped = free.copy()
    clipped[:-1] = project(free[:-1])
    if np.allclose(clipped, free, rtol=1e-9, atol=1e-12):
        return free
    values, basis = np.linalg.eigh(bend)
    values = np.maximum(values, 1e-10 * max(values[-1], 1e-10))
    target = slope - bend @ start

    def solve(rhs, rho):
        return basis @ ((basis.T @ rhs) / (values + rho))

    rho = np.sqrt(values[0] * values[-1]) + 1e-3 * np.median(values)
    dual, fixed = np.zeros_like(start), start.copy()
    for turn in range(rounds):
        free = solve(rho * (fixed - dual) - target, rho)
        before, fixed = fixed, free + dual
        fixed[:-1] = project(fixed[:-1])
        dual = dual + free - fixed
        primal, change = np.linalg.norm(free - fixed), rho * np.linalg.norm(fixed - before)
        if primal <= 1e-9 * (1 + np.linalg.norm(fixed)) and change <= 1e-9 * (1 + np.linalg.norm(target)):
            break
        if turn % 20 == 19:
            factor = np.sqrt(max(primal * rho, 1e-300) / max(change, 1e-300))
            factor = float(np.clip(factor, 0.2, 5.0))
            rho, dual = rho * factor, dual / factor
    return fixed


@dataclass
class NewtonResult:
    point: np.ndarray      # coefficients, bias last
    objective: float       # exact objective without ridge
    lower: float           # proven lower bound, -inf if none
    hinge: float           # sum of slacks at the point
    width: float           # smoothing width of the returned duals
    dual_point: np.ndarray  # point whose smoothed hinge gives the best duals
    passes: int
    status: str

    @property
    def gap(self):
        return (self.objective - self.lower) / max(1.0, abs(self.objective))


def balanced(sums, cost):
    """Duals repaired to equal class sums: (q = Z'(y*pi), sum of pi)."""
    plus, minus = sums["mass"]
    f_plus = min(1.0, minus / plus) if plus > 0 else 0.0
    f_minus = min(1.0, plus / minus) if minus > 0 else 0.0
    return cost * (f_plus * sums["pos"] - f_minus * sums["neg"]), cost * (f_plus * plus + f_minus * minus)


def minimise(evaluate, regulariser: Regulariser, project, start: np.ndarray, cost: float = 1.0,
             lower: Callable | None = None, tol: float = 1e-3, max_passes: int = 120, widths=WIDTHS) -> NewtonResult:
    """Newton steps over falling smoothing widths until the proven gap is below ``tol``."""
    point, passes = start.astype(float), 0
    best = NewtonResult(point, np.inf, -np.inf, np.nan, widths[0], point, 0, "max_passes")

    def bounded(sums, width, at):
        if lower is not None:
            bound = lower(*balanced(sums, cost), at)
            if bound > best.lower:
                best.lower, best.width, best.dual_point = float(bound), width, at

    def look(points, width, after):
        """One pass: sums at ``width``, and for the first point at the width ``after`` as well."""
        nonlocal passes
        passes += 1
        sums = evaluate(points, width, after)
        exact = regulariser.value(points, with_ridge=False) + cost * sums["hinge"]
        k = int(np.argmin(exact))
        if exact[k] < best.objective:
            best.point, best.objective, best.hinge = points[k], float(exact[k]), float(sums["hinge"][k])
        bounded(sums, width, points[0])
        if sums.get("next"):
            bounded(sums["next"], after, points[0])
        return sums, regulariser.value(points, delta) + cost * sums["smooth"]

    damping, scale, ahead = 1e-8, np.zeros(len(point)), None
    for place, width in enumerate(widths):
        delta = 1e-2 * width
        scale = 0.5 * scale
        after = widths[place + 1] if place + 1 < len(widths) else None
        if ahead is None:
            sums, values = look(point[None, :], width, after)
        else:
            sums, values = ahead, regulariser.value(point[None, :], delta) + cost * ahead["smooth"]
        current, ahead = values[0], sums.get("next")
        while passes < max_passes and best.gap > tol:
            slope, bend = regulariser.slope_bend(point, delta)
            slope[:-1] -= cost * (sums["pos"] - sums["neg"])
            slope[-1] -= cost * (sums["mass"][0] - sums["mass"][1])
            bend = bend + cost * sums["curvature"]
            # per coordinate, and with memory: without rows in the curved part the damping must still hold
            scale = np.maximum(np.diag(bend), np.maximum(scale, 1e-8))
            extra = damping * scale
            # a flat bias would otherwise jump
            extra[-1] += 1e-3 * scale[-1]
            bend = bend + np.diag(extra)
            move = quadratic_step(bend, slope, point, project) - point
            trial = point + STEPS[:, None] * move
            found, values = look(trial, width, after)
            k = int(np.argmin(values))
            gain = current - values[k]
            if k >= 3 or gain <= 0:
                damping = min(max(damping * 30, 1e-5), 1e4)
            elif k == 0:
                damping = max(damping / 30, 1e-8)
            if gain <= 0:
                if damping >= 1e4 or np.linalg.norm(move) <= 1e-9 * (1 + np.linalg.norm(point)):
                    break
                continue
            point, current = trial[k], values[k]
            sums = found if k == 0 else look(point[None, :], width, after)[0]
            ahead = sums.get("next")
            if gain <= (1e-3 if width >= 1.0 else 1e-6) * max(1.0, abs(current)) and k < 3:
                break
        if best.gap <= tol or passes >= max_passes:
            break
    best.passes = passes
    best.status = "optimal" if best.gap <= tol else ("max_passes" if passes >= max_passes else "inaccurate")
    return best


# ------------------------------------------------------------ proven bounds
def nonnegative_fit(gram: np.ndarray, q: np.ndarray, signed: np.ndarray):
    """min x'Gx/2 - q.x with x >= 0 where ``signed``: active set; returns (x, multipliers ok)."""
    size = len(q)
    x, inside = np.zeros(size), ~signed
    tol = 1e-8 * (1.0 + np.abs(q).max(initial=0.0))
    for _ in range(3 * size + 1):
        while True:
            idx = np.nonzero(inside)[0]
            full = np.zeros(size)
            if len(idx):
                full[idx] = np.linalg.lstsq(gram[np.ix_(idx, idx)], q[idx], rcond=1e-11)[0]
            bad = signed & inside & (full <= 0)
            if not bad.any():
                x = full
                break
            ratio = np.min(x[bad] / np.maximum(x[bad] - full[bad], 1e-300))
            x = x + ratio * (full - x)
            inside &= ~(signed & (x <= 1e-14))
            x[~inside] = 0.0
        pull = q - gram @ x
        outside = signed & ~inside & (pull > tol)
        if not outside.any():
            return x, bool(np.abs(pull[~signed]).max(initial=0.0) <= 100 * tol)
        inside[np.argmax(np.where(outside, pull, -np.inf))] = True
    return x, False


def combination_bound(gram: np.ndarray, combination: str, rays: np.ndarray):
    """Lower bound of the master from duals: uses |Wx| >= u.Wx for a vector u in the span of W, |u| <= 1."""
    points = ~rays
    signed = rays if combination in ("libre", "afin") else np.ones(len(rays), bool)

    everything_free = not signed.any()
    inverse = np.linalg.pinv(gram, rcond=1e-11, hermitian=True) if everything_free and len(gram) else None

    def cone(q, total):
        if everything_free:
            x = inverse @ q
            # q outside the range of the Gram matrix gives no bound
            solved = np.linalg.norm(gram @ x - q) <= 1e-6 * (1.0 + np.linalg.norm(q))
            return total / max(1.0, np.sqrt(max(q @ x, 0.0))) if solved else 0.0
        x, solved = nonnegative_fit(gram, q, signed)
        return total / max(1.0, np.sqrt(max(x @ gram @ x, 0.0))) if solved else 0.0

    def along(q, total, point):
        """u = w/|w|; on the rays the duals are shrunk until their reduced costs are not negative."""
        gx = gram @ point
        length = np.sqrt(max(point @ gx, 0.0))
        a = gx / length if length > 1e-12 else np.zeros(len(point))
        tight = rays & (q > 0)
        scale = float(np.clip(np.min(a[tight] / q[tight]), 0.0, 1.0)) if tight.any() else 1.0
        rest = a - scale * q
        if np.any(rest[rays] < -1e-12) or not points.any():
            return -np.inf
        return scale * total + rest[points].min()

    def affine(q, total):
        """W'u = q + shift on every point, the largest shift with |u| <= 1."""
        one = np.ones(len(q))
        a, b, c = one @ inverse @ one, one @ inverse @ q, q @ inverse @ q
        root = b * b - a * (c - 1.0)
        if a <= 1e-12 or root < 0:
            return -np.inf
        shift = (np.sqrt(root) - b) / a
        missed = np.linalg.norm(gram @ (inverse @ (q + shift * one)) - q - shift * one)
        return total + shift if missed <= 1e-6 * (1 + np.linalg.norm(q)) else -np.inf

    def bound(q, total, point):
        if combination == "convexo":
            return along(q, total, point[:-1])
        if combination == "afin" and not rays.any():
            return max(cone(q, total), affine(q, total))
        if combination == "mayor_uno":
            best = cone(q, total)
            with_sum = along(q, total, point[:-1])
            # on sum >= 1 the bound by points holds only while their reduced costs are not negative
            return max(best, with_sum) if with_sum >= total else best
        return cone(q, total)
    return bound


def cut_multiplier(direction: np.ndarray, reach: np.ndarray) -> float:
    """The multiplier >= 0 of the half-space cut with the smallest sum |reach - m*direction|: a weighted median."""
    some = np.nonzero(direction)[0]
    if not len(some):
        return 0.0
    order = some[np.argsort(reach[some] / direction[some])]
    weight = np.cumsum(np.abs(direction[order]))
    mid = order[np.searchsorted(weight, 0.5 * weight[-1])]
    return max(0.0, float(reach[mid] / direction[mid]))


def vanishing_bound(total: float, left: float) -> float:
    """Bound without a box: none unless the reduced costs vanish, whose absolute sum is ``left``."""
    return float(total) if left <= 1e-9 * max(1.0, abs(total)) else -np.inf


def box_bound(direction: np.ndarray, m_box: float | None, cut: str | None = None):
    """Lower bound of the pricing problem over the box, from duals."""
    def bound(q, total, point):
        reach = direction + q
        if cut == "sign":
            left = np.where(direction > 0, np.maximum(-reach, 0.0),
                            np.where(direction < 0, np.maximum(reach, 0.0), np.abs(reach))).sum()
        elif cut == "halfspace":
            left = np.abs(reach - cut_multiplier(direction, reach) * direction).sum()
        else:
            left = np.abs(reach).sum()
        return vanishing_bound(total, left) if m_box is None else total - m_box * left
    return bound


def squared_bound(cost: float):
    """Lower bound of (|w|^2+b^2)/2 + C*hinge for G = I: the dual value of the repaired duals."""
    def bound(q, total, point):
        return total - 0.5 * float(q @ q)
    return bound
