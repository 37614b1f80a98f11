"""Dual ascent by row blocks: max-margin problems over any number of features, solved to a proven gap.

All problems here are  min r(w) + C*sum(xi)  with y_i(x_i.w + b) >= 1 - xi_i, and r the norm, half the squared norm, or the
linear term of pricing over a box.  The matrix lies in row blocks of a bounded number of cells (``packed``); duals are kept by
block, the vectors X'(y*pi), the best weights and the dual that proves the bound by part of the features; the driver holds sums.
An epoch moves one number per feature of a block to the blocks and back, and no cells:

1.  A block goes through its rows a few times; a row's dual moves to the best place for the weights as the block sees them.  A
    block counts its own change as often as there are blocks, which keeps the sum of all changes an ascent.  It also sums the
    hinge on a grid of candidates between the best weights so far and the present ones, at several lengths and biases.
2.  With several blocks, each then looks where its rows stand with the weights of all changes, and sends those that are furthest
    off to one joint block, of a block's size.  There they move together, each change counted once: rows whose duals still have
    far to go would need many epochs at a K-th of the way.

The weights follow from the duals: eta*v for the norm, with eta the length of the best weights so far (which is what the
optimum asks for), eta = 1 for the squared norm.  The bias is the multiplier of sum(y*pi) = 0.

Pricing over a box takes proximal steps from a centre, clipped to the box; few rows hold such a step, the others lie beyond the
margin with a dual of 0.  An epoch scores all rows in their blocks, and deals the cells of the working rows alone to
tasks: those with a dual, or within the margin where the step begins.  The step grows while the
box makes up most of the gap, and shrinks while the working rows do.

Every epoch gives a feasible dual, by scaling the heavier class down, and thereby a proven bound; for the norms the best mix of
it and the best one so far is kept.  Epochs end when objective and bound meet.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from widemargin.functions.skew import hot_keys, with_slice
from widemargin.operators.newton import vanishing_bound
from widemargin.operators.packed import (FAR, IDS, LINES, LINK, MESSAGE, MOVED, ROWS, STATE, SUMS, TOTAL, Packed, array, found, line,
                                         lines, received, row_sums)
from widemargin.session import bucketed, cut_lineage

#: Cells of one row block, on average; it is worked off in one task.
BLOCK_CELLS = 1 << 23
#: Times a block goes through its rows in one epoch: the only one, one of several, the joint one.
PASSES, SHORT_PASSES, JOINT_PASSES = 30, 10, 10
#: Cells of a block of working rows of pricing.
WORK_CELLS = 1 << 21
MAX_EPOCHS = 300
_WORKED = "kind byte, id long, copy int, a double, b double"
_FEATURE, _ROW = 0, 1
# candidates: shares of the way from the best weights to the present ones, lengths, steps of the bias
_SHARES = np.array([0.15, 0.4, 0.7, 1.0])
_LENGTHS = np.array([0.05, 0.2, 0.5, 0.8, 0.92, 1.0, 1.08, 1.25, 1.5])
# and, with several blocks, those that lift rows just below the margin
_FINE_LENGTHS = np.array([0.97, 0.99, 1.005, 1.01, 1.02, 1.04])
# pricing: times that a block moves the multiplier of a half space in one pass, passes from one visit of all its rows to the next,
# visits of rows that a block may make however few it has, step of the bias as a share of that of a row's weights
_CUT_MOVES, _LOOK_AGAIN, _VISITS, _BIAS_SHARE = 8, 10, 30_000, 0.01
_MIXES = np.linspace(0.0, 1.0, 9)
_BIAS = np.array([0.0, 0.003, -0.003, 0.01, -0.01, 0.03, -0.03, 0.1, -0.1, 0.3, -0.3, 1.0, -1.0])
# rows with a dual of 0 are looked at in every fifth pass; a row that is less off than this needs no joint block
_LOOK_ALL, _OFF = 5, 1e-4


@dataclass
class Ascended:
    """Result of an ascent; ``duals`` are those that prove ``lower``."""

    weights: DataFrame      # feature_id, weight
    b: float
    objective: float
    lower: float
    sum_xi: float
    epochs: int
    status: str
    duals: DataFrame        # row_id, y, margin, pi
    blocks: int

    @property
    def gap(self) -> float:
        return (self.objective - self.lower) / max(1.0, abs(self.objective))


class StoredMatrix:
    """A matrix stored once, in row blocks, for any number of ascents."""

    def __init__(self, matrix: DataFrame, labels: DataFrame, hot: DataFrame | None = None, block_cells: int = BLOCK_CELLS,
                 by_feature: DataFrame | None = None):
        """``by_feature`` is a matrix of these rows that already lies by (feature_id, _slice), with its ``hot`` features."""
        self._hot, self._by_feature = hot, by_feature
        self.matrix = (matrix if by_feature is None else by_feature).select("row_id", "feature_id", "value")
        self.labels = cut_lineage(labels.select("row_id", "y"))
        facts = self.matrix.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value") * F.col("value")).alias("q")).first()
        sides = {r["y"]: r["n"] for r in self.labels.groupBy(F.signum("y").cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
        self.plus, self.minus = sides.get(1, 0), sides.get(-1, 0)
        self.mean_square = (facts["q"] or 0.0) / max(1, self.plus + self.minus) or 1.0
        self.cells, self.block_cells, self.blocks = facts["n"], block_cells, int(max(1, -(-facts["n"] // block_cells)))

    @cached_property
    def packed(self) -> Packed:
        return Packed(self.matrix, self.labels, self.blocks, self.cells)

    @cached_property
    def hot(self) -> DataFrame:
        return cut_lineage(hot_keys(self._labelled(), "feature_id")) if self._hot is None else self._hot

    @cached_property
    def by_feature(self) -> DataFrame:
        """The cells of labelled rows by (feature_id, _slice)."""
        if self._by_feature is not None:
            return self._by_feature
        return bucketed(with_slice(self._labelled(), "feature_id", "row_id", self.hot), "feature_id", "_slice")

    def _labelled(self) -> DataFrame:
        return self.matrix.join(self.labels.select("row_id"), "row_id", "left_semi")

    def longest_row(self) -> float:
        """Largest sum of absolute values of a row."""
        rows = self._labelled().groupBy("row_id").agg(F.sum(F.abs("value")).alias("l"))
        return rows.agg(F.max("l")).first()[0] or 0.0


# ---------------------------------------------------------------- inside a block
def _by_row(cells, row_ids: np.ndarray):
    """Cells of one block in the order of the rows: (starts, places of the features, values, first cell of each feature)."""
    at = np.searchsorted(row_ids, cells.column("row_id").to_numpy())
    order = np.argsort(at, kind="stable")
    feature, value = cells.column("feature_id").to_numpy()[order], cells.column("value").to_numpy()[order]
    ids, first, place = np.unique(feature, return_index=True, return_inverse=True)
    starts = np.searchsorted(at[order], np.arange(len(row_ids) + 1))
    return starts, ids, place, value, order[first]


def climb(places, values, y, pi, u, b, step, bias_step, cost, low, high, weight, passes, rng):
    """Coordinate ascent over the rows of a block: the new duals.

    ``places`` and ``values`` are the cells of each row.  The weights are ``u`` cut to [low, high]; a change of a dual counts
    ``weight`` times.  Rows with a dual of 0 are looked at in every fifth pass only.
    """
    pi, u, limited, at_work = pi.copy(), u.copy(), low is not None, np.ones(len(y), bool)
    divisor = weight * (step * np.array([x @ x for x in values]) + bias_step)
    for turn in range(passes):
        moved, every = 0.0, turn % _LOOK_ALL == 0
        for i in rng.permutation(len(y) if every else np.flatnonzero(at_work)):
            j, x = places[i], values[i]
            at = u[j]
            w = np.minimum(np.maximum(at, low[j]), high[j]) if limited else at
            change = min(max(pi[i] + (1.0 - y[i] * (x @ w + b)) / divisor[i], 0.0), cost) - pi[i]
            if change:
                pi[i] += change
                u[j] = at + (weight * step * change * y[i]) * x
                b += weight * bias_step * change * y[i]
                moved = max(moved, abs(change))
            at_work[i] = pi[i] > 0
        if every and moved <= 1e-9 * cost:
            break
    return pi


def _limits(g: np.ndarray, box: float | None, cut: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lowest, highest weight) of each feature."""
    low, high = np.full(len(g), -np.inf if box is None else -box), np.full(len(g), np.inf if box is None else box)
    return (np.where(g < 0, 0.0, low), np.where(g > 0, 0.0, high)) if cut == "sign" else (low, high)


def row_step(x, u, low, high, y, b, step, bias_step, least, most) -> float:
    """Change of one dual, in [least, most], that brings its row to the margin.

    Most weights lie at a limit and do not follow: the margin is piecewise linear in the change, so a bracketed Newton
    search finds the place.
    """
    change, below, above = 0.0, least, most
    for _ in range(12):
        moved = u + step * change * y * x
        left = 1.0 - y * (x @ np.minimum(np.maximum(moved, low), high) + b) - bias_step * change
        if abs(left) <= 1e-9:
            break
        below, above = (change, above) if left > 0 else (below, change)
        free = x[(moved > low) & (moved < high)]
        ahead = change + left / (step * (free @ free) + bias_step)
        if not below < ahead < above:
            ahead = most if ahead >= above == most else least if ahead <= below == least else (below + above) / 2
        if ahead == change:
            break
        change = ahead
    return change


def climb_limited(starts, place, value, y, pi, u, b, step, bias_step, cost, low, high, visits, rng, cut=None):
    """Coordinate ascent over the rows of a block whose weights are ``u`` cut to [low, high]: the new duals.

    Rows beyond the margin with a dual of 0 are looked at in every tenth pass only.  ``cut`` is (g, multiplier, what features
    outside the block add to g.w): the multiplier of g.w <= 0 then moves along between the rows.
    """
    pi, u, at_work, settled = pi.copy(), u.copy(), np.ones(len(y), bool), False
    rows = [slice(a, z) for a, z in zip(starts[:-1], starts[1:])]
    if cut is not None:
        g, multiplier, rest = cut
        square_g = step * (g @ g)
    turn = 0
    while visits > 0:
        every, worst = settled or turn % _LOOK_AGAIN == 0, 0.0
        todo = rng.permutation(len(y) if every else np.flatnonzero(at_work))
        for k, i in enumerate(todo):
            if cut is not None and k % max(1, len(todo) // _CUT_MOVES) == 0 and square_g:
                change = max(multiplier + (g @ np.minimum(np.maximum(u, low), high) + rest) / square_g, 0.0) - multiplier
                multiplier += change
                u -= step * change * g
            j, x = place[rows[i]], value[rows[i]]
            uj, lj, hj = u[j], low[j], high[j]
            left = 1.0 - y[i] * (x @ np.minimum(np.maximum(uj, lj), hj) + b)
            at_work[i] = pi[i] > 0 or left > 0
            if (pi[i] < cost) if left > 0 else (pi[i] > 0):
                worst = max(worst, abs(left))
                change = row_step(x, uj, lj, hj, y[i], b, step, bias_step, -pi[i], cost - pi[i])
                pi[i] = min(max(pi[i] + change, 0.0), cost)
                u[j] = uj + step * change * y[i] * x
                b += bias_step * change * y[i]
        if every and worst <= 1e-6:
            break
        settled, turn, visits = worst <= 1e-6, turn + 1, visits - len(todo) - 1
    return pi


def _limited_solver(p: dict) -> Callable:
    """The function of one block of working rows for the parameters of an epoch of pricing."""
    def solve(cells, rows):
        import pyarrow as pa
        rows = rows.sort_by([("row_id", "ascending"), ("copy", "ascending")])
        ids, copy, y, old = (rows.column(c).to_numpy() for c in ("row_id", "copy", "y", "pi"))
        y = y.astype(float)
        cells = cells.group_by(["row_id", "feature_id"]).aggregate([("value", "sum"), ("u", "min"), ("g", "min")])
        cells = cells.rename_columns(["row_id", "feature_id", "value", "u", "g"])
        starts, features, place, value, first = _by_row(cells, ids)
        u, g = (cells.column(n).to_numpy()[first] for n in ("u", "g"))
        low, high = _limits(g, p["box"], p["cut"])
        cut = None
        if p["cut"] == "halfspace":
            cut = g, p["multiplier"], p["side"] - g @ np.minimum(np.maximum(u, low), high)
        # a change counts as often as there are blocks
        new = climb_limited(starts, place, value, y, old, u, p["start"], p["blocks"] * p["step"], p["blocks"] * p["bias_step"], p["cost"],
                            low, high, max(_VISITS, p["passes"] * len(ids)), np.random.default_rng([p["epoch"], int(ids[0]) & 0xFFFFFFFF]), cut)
        row_of = np.repeat(np.arange(len(ids)), np.diff(starts))
        sums = [np.bincount(place, (new * (y * side > 0))[row_of] * value, len(features)) for side in (1, -1)]
        parts = [(_FEATURE, features, np.zeros(len(features)), sums), (_ROW, ids, copy, [new, y])]
        return pa.concat_tables([pa.table({"kind": np.full(len(i), kind, np.int8), "id": i.astype(np.int64), "copy": c.astype(np.int32),
                                           "a": a.astype(float), "b": b.astype(float)}) for kind, i, c, (a, b) in parts])
    return solve


def _hinges(shares: np.ndarray, biases: np.ndarray, cost: float, centre: float, start: float) -> Callable:
    """Sums over rows: the hinge of each candidate, what the rows worked on leave open, cells of the rows to work on next."""
    def sums(batches):
        import pyarrow as pa
        total = np.zeros(len(shares) * len(biases) + 2)
        for batch in batches:
            y, pi, best, z, ahead, cells, worked = (batch.column(n).to_numpy(zero_copy_only=False)
                                                    for n in ("y", "pi", "zb", "z", "zu", "cells", "worked"))
            for i, share in enumerate(shares):
                score = (1 - share) * best + share * z
                total[i * len(biases):(i + 1) * len(biases)] += [np.maximum(0.0, 1.0 - y * (score + bias)).sum() for bias in biases]
            slack = 1.0 - y * (z + centre)
            total[-2] += (cost * np.maximum(slack, 0) - pi * slack)[worked].sum()
            total[-1] += cells[(pi > 0) | (y * (ahead + start) < 1)].sum()
        yield pa.RecordBatch.from_pydict({"id": pa.array(np.arange(len(total))), "a": pa.array(total)})
    return sums


def _cells(pieces) -> tuple[list, list]:
    """(places, values) of each row of a block."""
    places, values = [], []
    for _, _, starts, place, value in pieces:
        place = place.astype(np.intp)
        places += [place[a:z] for a, z in zip(starts[:-1], starts[1:])]
        values += [value[a:z] for a, z in zip(starts[:-1], starts[1:])]
    return places, values


def _seen(light, features, p: dict) -> tuple:
    """(weights before limits, lowest, highest, g) of the features of a block."""
    size = sum(len(f) for f in features.values())
    u = p["length"] * received(light, "a") if found(light, MESSAGE) else np.zeros(size)
    g = received(light, "b") if p["signed"] and found(light, MESSAGE) else np.zeros(size)
    return (u, *_limits(g, np.inf, "sign"), g) if p["signed"] else (u, None, None, g)


def _rows_of(light, y, p: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(duals, scores of the best weights, duals that prove the bound) after what the last epoch came to."""
    at = found(light, ROWS)
    if not at:
        return np.zeros(len(y)), np.zeros(len(y)), np.zeros(len(y))
    pi, z, best, hold = (array(light, n, at[0]) for n in "abcd")
    pi = pi.copy()
    for k in found(light, MOVED):
        pi[array(light, "a", k, np.int64)] = array(light, "b", k)
    hold = p["mix"][0] * hold + p["mix"][1] * np.where(y > 0, p["factors"][0], p["factors"][1]) * pi
    return p["scale"] * pi, p["keep"] * best + p["add"] * z, hold


def _climber(p: dict) -> Callable:
    """The function of one block for the parameters of an epoch."""
    def solve(block, pieces, features, light):
        y = np.concatenate([piece[1] for piece in pieces])
        old, best, hold = _rows_of(light, y, p)
        u, low, high, _ = _seen(light, features, p)
        c = u if low is None else np.minimum(np.maximum(u, low), high)
        z = np.concatenate([row_sums(starts, c[place] * value) for _, _, starts, place, value in pieces])
        rng = np.random.default_rng([p["epoch"], int(pieces[0][0][0]) & 0xFFFFFFFF if len(pieces[0][0]) else block])
        new = climb(*_cells(pieces), y, old, u, p["start"], p["step"], p["bias_step"], p["cost"], low, high, p["blocks"], p["passes"], rng)
        hinge = np.zeros((len(p["shares"]), len(p["biases"])))
        for k in range(0, len(y), 4096):
            part = slice(k, k + 4096)
            score = (1 - p["shares"])[:, None] * best[part] + p["lengths"][:, None] * z[part]
            for i, bias in enumerate(p["biases"]):
                hinge[:, i] += np.maximum(0.0, 1.0 - y[part] * (score + bias)).sum(1)
        sums, begun = [np.zeros(len(u)), np.zeros(len(u))], 0
        for ids, side, starts, place, value in pieces:
            given = np.repeat(new[begun:begun + len(ids)], np.diff(starts)) * value
            positive = np.repeat(side > 0, np.diff(starts))
            sums[0] += np.bincount(place, given * positive, len(u))
            sums[1] += np.bincount(place, given * ~positive, len(u))
            begun += len(ids)
        out = [line(ROWS, -1, block, a=new, b=z, c=best, d=hold),
               line(TOTAL, -1, block, t=np.concatenate([[new[y > 0].sum(), new[y < 0].sum(), new.max(initial=0.0)], hinge.ravel()]))]
        begun = 0
        for part in sorted(features):
            end = begun + len(features[part])
            out.append(line(SUMS, part, block, a=sums[0][begun:end], b=sums[1][begun:end]))
            begun = end
        return lines(out)
    return solve


def _looker(p: dict) -> Callable:
    """The rows of one block that are furthest off, with their cells, for the joint block."""
    def look(block, pieces, features, light):
        y = np.concatenate([piece[1] for piece in pieces])
        pi = array(light, "a", found(light, ROWS)[0])
        u, low, high, g = _seen(light, features, p)
        c = u if low is None else np.minimum(np.maximum(u, low), high)
        left = 1.0 - y * (np.concatenate([row_sums(starts, c[place] * value) for _, _, starts, place, value in pieces]) + p["start"])
        off = np.where(pi <= 0, np.maximum(left, 0.0), np.where(pi >= p["cost"], np.maximum(-left, 0.0), np.abs(left)))
        size = np.concatenate([np.diff(starts) for _, _, starts, _, _ in pieces])
        order = np.argsort(-off, kind="stable")
        rows = np.sort(order[(np.cumsum(size[order]) <= p["joint_cells"]) & (off[order] > _OFF)])
        places, values = _cells(pieces)
        nothing = [np.zeros(0, np.int64)]
        used, place = np.unique(np.concatenate([places[i] for i in rows] or nothing), return_inverse=True)
        ids = np.concatenate([features[k] for k in sorted(features)] or nothing)
        return lines([line(FAR, -1, block, a=rows.astype(np.int64), b=np.concatenate([y[rows], pi[rows]]), c=np.cumsum(np.append(0, size[rows])).astype(np.int64),
                           d=place.astype(np.int32), e=np.concatenate([values[i] for i in rows] or [np.zeros(0)]), t=ids[used].astype(np.int64)),
                      line(MESSAGE, -1, block, a=u[used], b=g[used])])
    return look


def _joint(p: dict) -> Callable:
    """The rows that are furthest off move together, each change counted once."""
    def solve(key, table):
        far, sent = found(table, FAR), found(table, MESSAGE)
        held = [array(table, "t", k, np.int64) for k in far]
        ids, inside = np.unique(np.concatenate(held), return_inverse=True)
        ends = np.cumsum([0] + [len(h) for h in held])
        u, g = np.zeros(len(ids)), np.zeros(len(ids))
        places, values, y, pi, owner = [], [], [], [], []
        for n, (k, m) in enumerate(zip(far, sent)):
            to = inside[ends[n]:ends[n + 1]]
            u[to], g[to] = array(table, "a", m), array(table, "b", m)
            starts, place, value = array(table, "c", k, np.int64), to[array(table, "d", k, np.int32)].astype(np.intp), array(table, "e", k)
            places += [place[a:z] for a, z in zip(starts[:-1], starts[1:])]
            values += [value[a:z] for a, z in zip(starts[:-1], starts[1:])]
            sides, duals = np.split(array(table, "b", k), 2)
            y.append(sides)
            pi.append(duals)
        y, old = np.concatenate(y), np.concatenate(pi)
        low, high = _limits(g, np.inf, "sign") if p["signed"] else (None, None)
        new = climb(places, values, y, old, u, p["start"], p["step"], p["bias_step"], p["cost"], low, high, 1, JOINT_PASSES, np.random.default_rng([p["epoch"]]))
        sums = [np.zeros(len(ids)), np.zeros(len(ids))]
        for j, x, side, change in zip(places, values, y, new - old):
            if change:
                sums[0 if side > 0 else 1][j] += change * x
        out, begun = [], 0
        for k in far:
            rows = array(table, "a", k, np.int64)
            out.append(line(MOVED, -1, int(table.column("block")[k].as_py()), a=rows, b=new[begun:begun + len(rows)]))
            begun += len(rows)
        part = np.mod(ids, p["parts"])
        out += [line(SUMS, int(k), a=sums[0][part == k], b=sums[1][part == k], c=ids[part == k]) for k in np.unique(part)]
        change = new - old
        out.append(line(TOTAL, t=np.array([change[y > 0].sum(), change[y < 0].sum(), new.max(initial=0.0)])))
        return lines(out)
    return solve


def _inside(v: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The nearest weights with the signs that ``g`` allows; no ``g``, no signs."""
    return np.where(g > 0, np.minimum(v, 0.0), np.where(g < 0, np.maximum(v, 0.0), v)) if len(g) else v


def _measured(vp, vn, wb, hold, g, factors) -> np.ndarray:
    """Sums over features: products of the new and the best weights, squares of mixes of the held dual and the new one."""
    v, repaired = _inside(vp - vn, g), factors[0] * vp - factors[1] * vn
    mixes = [_inside((1 - s) * hold + s * repaired, g) for s in _MIXES]
    return np.array([v @ v, v @ wb, wb @ wb, *[m @ m for m in mixes]])


def _gather(p: dict) -> Callable:
    """The features of a part take what the blocks, or the joint block, return."""
    def gather(key, links, light):
        if not len(links):
            return lines([])
        part, own = key[0].as_py(), found(links, IDS)[0]
        ids, g = array(links, "a", own, np.int64), array(links, "b", own)
        at = found(light, STATE)
        vp, vn, wb, hold = (array(light, n, at[0]).copy() if at else np.zeros(len(ids)) for n in "abcd")
        if p["first"]:
            hold = p["mix"][0] * hold + p["mix"][1] * (p["factors"][0] * vp - p["factors"][1] * vn)
            wb = p["keep"] * wb + p["add"] * p["length"] * _inside(vp - vn, g)
            vp, vn = np.zeros(len(ids)), np.zeros(len(ids))
        place = dict(zip(links.column("block").to_numpy()[(linked := found(links, LINK))], linked))
        for k in found(light, SUMS):
            block = light.column("block")[k].as_py()
            to = np.searchsorted(ids, array(light, "c", k, np.int64)) if block < 0 else array(links, "a", place[block], np.int32)
            vp[to] += array(light, "a", k)
            vn[to] += array(light, "b", k)
        out = [line(STATE, part, a=vp, b=vn, c=wb, d=hold)]
        v = vp - vn
        for block, k in place.items():
            to = array(links, "a", k, np.int32)
            out.append(line(MESSAGE, part, int(block), a=v[to], **({"b": g[to]} if len(g) else {})))
        if p["last"]:
            out.append(line(TOTAL, part, t=_measured(vp, vn, wb, hold, g, p["now"])))
        return lines(out)
    return gather


# ---------------------------------------------------------------- the problems
class Norm:
    """r = |w|, or |w|**2 / 2 with ``squared``.

    ``signs`` (feature_id, g) keeps w_j <= 0 where g > 0 and w_j >= 0 where g < 0.  The weights are then the nearest point
    of that cone to eta*v, and a dual is feasible where the nearest point to v is no longer than 1.
    """

    def __init__(self, stored: StoredMatrix, squared: bool = False, signs: DataFrame | None = None):
        self.squared, self.eta = squared, 1.0 if squared else 1.0 / np.sqrt(stored.mean_square)
        self.signs, self.mean_square, self.many = signs, stored.mean_square, stored.blocks > 1
        self.products = dict.fromkeys(("cc", "cb", "bb"), 0.0)
        self.held = 0.0

    def links(self, packed: Packed) -> DataFrame:
        """The links of the parts, with g of their features where there are signs."""
        if self.signs is None:
            return packed.links

        def attach(key, links, signs):
            own = found(links, IDS)
            if not own:
                return lines([])
            ids, g = array(links, "a", own[0], np.int64), np.zeros(0)
            place = np.searchsorted(ids, signs.column("feature_id").to_numpy())
            known = np.flatnonzero(ids[np.minimum(place, len(ids) - 1)] == signs.column("feature_id").to_numpy())
            g = np.zeros(len(ids))
            g[place[known]] = signs.column("g").to_numpy()[known]
            rows = links.to_pylist()
            rows[own[0]]["b"] = g.tobytes()
            return lines(rows)
        keyed = self.signs.select(F.pmod("feature_id", F.lit(packed.parts)).cast("int").alias("part"), "feature_id", F.col("g").cast("double").alias("g"))
        return cut_lineage(packed.links.groupBy("part").cogroup(keyed.groupBy("part")).applyInArrow(attach, LINES))

    def grid(self) -> tuple[np.ndarray, np.ndarray]:
        """(share, share times length) of each candidate."""
        lengths = np.concatenate([_LENGTHS, _FINE_LENGTHS]) if self.many else _LENGTHS
        share, length = np.meshgrid(_SHARES, lengths, indexing="ij")
        return share.ravel(), (share * length).ravel()

    def cost_of(self, share, length) -> np.ndarray:
        p = self.products
        square = np.maximum((1 - share) ** 2 * p["bb"] + 2 * (1 - share) * length * p["cb"] + length ** 2 * p["cc"], 0.0)
        return square / 2 if self.squared else np.sqrt(square)

    def rescale(self, plus: float, minus: float, largest: float, centre: float, cost: float) -> float:
        """The multiple of the new duals to go on from; the length follows from it.

        The length grows by orders of magnitude in the first epochs, and K blocks each take only a K-th of the way to the
        duals that belong to it; along the ray through the duals the best point is known in one step.
        """
        square, balance = self.products["cc"] / self.eta ** 2, plus - minus
        gain, most = plus + minus - centre * balance, cost / max(largest, 1e-300)
        if gain <= 0 or square <= 0:
            return 1.0

        def best() -> float:
            return float(min(gain / (self.eta * (square + self.mean_square * balance ** 2)), most))
        old, first = self.eta, best()
        if not self.squared:
            self.eta = float(max(old * first * np.sqrt(square), 0.3 * old))
        scale = best()
        change = scale * self.eta / old
        self.products["cc"], self.products["cb"] = self.products["cc"] * change ** 2, self.products["cb"] * change
        return scale

    def measure(self, sums: np.ndarray, total: float) -> tuple[float, np.ndarray]:
        """(bound, shares of the held dual and of the new one in the dual that gives it)."""
        p, share = self.products, _MIXES
        p["cc"], p["cb"], p["bb"] = (float(x) for x in sums[:3])
        if not self.squared and not self.many:
            # the best weights so far have the length that the duals stand for; slowly down, so that a start from 0 goes on
            self.eta = float(max(np.sqrt(p["bb"]), 0.3 * self.eta))
        p["cc"], p["cb"] = p["cc"] * self.eta ** 2, p["cb"] * self.eta
        square, sums = sums[3:], (1 - share) * self.held + share * total
        # any dual times a factor up to 1 is feasible
        scale = np.minimum(1.0, sums / np.maximum(square, 1e-300)) if self.squared else 1 / np.maximum(1.0, np.sqrt(square))
        value = scale * sums - (scale ** 2 * square / 2 if self.squared else 0.0)
        k = int(value.argmax())
        self.held = float(sums[k] * scale[k])
        return float(value[k]), scale[k] * np.array([1 - share[k], share[k]])


class Pricing:
    """r = -g.w over |w_j| <= box, with the cut -g.w >= 0 ("halfspace") or -g_j w_j >= 0 for all j ("sign")."""

    def __init__(self, stored: StoredMatrix, gradient: DataFrame, box: float | None, cut: str | None):
        if cut not in (None, "halfspace", "sign"):
            raise ValueError(f"unknown cut {cut}")
        self.gradient = gradient.select("feature_id", F.col("grad").alias("g")).where(F.col("g") != 0)
        self.box, self.cut, self.multiplier, self.side = box, cut, 0.0, 0.0
        facts = self.gradient.agg(F.count(F.lit(1)).alias("n"), F.sum(F.abs("g")).alias("l")).first()
        # the step that takes a feature of average gradient to the box
        self.tau = (1.0 if box is None else box) * facts["n"] / facts["l"] if facts["n"] else 1.0 / stored.mean_square
        self.linear = {"gb": 0.0, "gc": 0.0}
        self.rows_gap = None

    def features(self, spark) -> DataFrame:
        return self.gradient.select("feature_id", "g", *[F.lit(0.0).alias(n) for n in ("vp", "vn", "w0", "wb")])

    def reach(self) -> Column:
        return F.col("g") * F.lit(1.0 - self.multiplier)

    def clipped(self, w: Column) -> Column:
        if self.box is None and self.cut != "sign":
            return w
        box = float("inf") if self.box is None else float(self.box)
        low, high = F.lit(-box), F.lit(box)
        if self.cut == "sign":
            low, high = F.when(F.col("g") < 0, F.lit(0.0)).otherwise(low), F.when(F.col("g") > 0, F.lit(0.0)).otherwise(high)
        return F.least(F.greatest(w, low), high)

    def start(self) -> Column:
        return F.col("w0") + self.tau * (self.reach() + F.col("vp") - F.col("vn"))

    def cost_of(self, share) -> np.ndarray:
        return -(1 - share) * self.linear["gb"] - share * self.linear["gc"]

    def next_centre(self, state: DataFrame) -> DataFrame:
        if self.cut == "halfspace":
            self.multiplier = self._multiplier(state)
        return state.withColumn("w0", self.clipped(self.start()))

    def _multiplier(self, state: DataFrame) -> float:
        """Smallest multiplier, up to a thousandth of its bracket, that brings the step into the half space."""
        def sides(values):
            v = F.col("vp") - F.col("vn")
            found = state.agg(*[F.sum(F.col("g") * self.clipped(F.col("w0") + self.tau * (F.col("g") * F.lit(float(1 - m)) + v))).alias(f"m{k}")
                                for k, m in enumerate(values)]).first()
            return np.array([x or 0.0 for x in found])
        values = np.append(0.0, 4.0 ** np.arange(-4, 12))
        if self.multiplier:
            values = self.multiplier * np.array([0.0, 0.5, 0.8, 0.95, 1.0, 1.05, 1.25, 2.0, 16.0, 1024.0])
        for turn in range(2):
            inside = np.flatnonzero(sides(values) <= 0)
            if not len(inside):
                return float(values[-1])
            k = int(inside[0])
            if k == 0:
                return float(values[0])
            values = np.linspace(values[k - 1], values[k], 17)
        return float(values[-1])

    def measure(self, state: DataFrame, factors: tuple[float, float], total: float, complement: float) -> float:
        """Bound of the duals; the step of the next epoch follows."""
        from widemargin.operators.pricing import box_price
        s = factors[0] * F.col("vp") - factors[1] * F.col("vn")
        priced = state.select("*", F.col("g").alias("grad"), s.alias("s"), (self.reach() + F.col("vp") - F.col("vn")).alias("r"))
        r, w = F.col("r"), F.col("w0")
        far = F.abs(r) if self.cut != "sign" else F.when(F.col("g") == 0, F.abs(r)).otherwise(F.greatest(-F.signum("g") * r, F.lit(0.0)))
        # any multiplier gives a bound
        tried = self.multiplier * np.linspace(0.8, 1.2, 9) if self.cut == "halfspace" and self.multiplier else [self.multiplier]
        found = priced.agg(F.least(*[F.sum(box_price(self.cut, m)) for m in tried], F.lit(float("inf"))).alias("short"), F.sum(F.col("g") * w).alias("gc"),
                           F.sum(F.col("g") * F.col("wb")).alias("gb"), F.sum(far).alias("far"), F.sum(r * w).alias("rw")).first()
        found = {k: 0.0 if x is None or (k == "short" and x == float("inf")) else x for k, x in found.asDict().items()}
        self.linear = {"gb": found["gb"], "gc": found["gc"]}
        bound = vanishing_bound(total, found["short"]) if self.box is None else total - self.box * found["short"]
        if self.box is None:
            self.tau *= 2
        else:
            # what the box and what the rows make up of the gap, one epoch back, as the rows are known then
            now = self.box * found["far"] - found["rw"]
            if self.rows_gap is not None:
                self.tau *= float(np.clip((self.rows_gap / max(complement, 1e-9)) ** 0.3, 0.5, 2.0))
            self.rows_gap = max(now, 1e-9)
        if self.cut == "halfspace":
            self.side = state.agg(F.sum(F.col("g") * self.clipped(self.start())).alias("s")).first()[0] or 0.0
        return bound


# ---------------------------------------------------------------- the loops
def _balanced(plus: float, minus: float) -> tuple[float, float]:
    """Factors of the two classes that scale the heavier one down."""
    return min(1.0, minus / max(plus, 1e-300)), min(1.0, plus / max(minus, 1e-300))


def _totals(out: DataFrame) -> list[np.ndarray]:
    """One short array per block or part."""
    return [np.frombuffer(bytes(r["t"])) for r in out.where(F.col("kind") == TOTAL).select("t").collect()]


def ascend(stored: StoredMatrix, problem: Norm, cost: float = 1.0, tol: float = 1e-3, passes: int | None = None,
           max_epochs: int = MAX_EPOCHS) -> Ascended:
    """Epochs until (objective - bound) <= tol * max(1, |objective|)."""
    spark, blocks, cost = stored.matrix.sparkSession, stored.blocks, float(cost)
    packed = stored.packed
    links = problem.links(packed)

    def of(out, *kinds):
        return out.where(F.col("kind").isin(*kinds))

    def take(out, **options):
        """The parts after what ``out`` returns, with the state so far."""
        return cut_lineage(links.groupBy("part").cogroup(of(out, SUMS, STATE).groupBy("part")).applyInArrow(_gather(p | options), LINES))
    rows = state = moved = spark.createDataFrame([], LINES)
    centre, balance, best, b, hinge, lower = 0.0, 0.0, np.inf, 0.0, 0.0, -np.inf
    status = "max_iter"
    # what an epoch came to, for the rows and features at the next one
    p = {"cost": cost, "blocks": blocks, "parts": packed.parts, "signed": problem.signs is not None, "keep": 1.0, "add": 0.0, "mix": (1.0, 0.0),
         "factors": (1.0, 1.0), "scale": 1.0, "passes": passes or (PASSES if blocks == 1 else SHORT_PASSES), "joint_cells": max(1, stored.block_cells // blocks)}
    for epoch in range(max_epochs):
        step, bias_step = problem.eta, problem.eta * stored.mean_square
        share, length = problem.grid()
        tried = np.unique(np.concatenate([centre + _BIAS, b + _BIAS]))
        p |= {"epoch": epoch, "step": step, "bias_step": bias_step, "start": centre + bias_step * balance, "shares": share, "lengths": length,
              "biases": tried, "length": step * p["scale"]}
        out = packed.by_block(_climber(p), of(state, MESSAGE).unionByName(rows).unionByName(moved))
        totals = _totals(out)
        plus, minus = (float(sum(t[k] for t in totals)) for k in (0, 1))
        largest = max(t[2] for t in totals)
        hinges = sum(t[3:] for t in totals).reshape(len(share), len(tried))
        objective = problem.cost_of(share, length)[:, None] + cost * hinges
        i, k = np.unravel_index(objective.argmin(), objective.shape)
        done = {"keep": 1.0, "add": 0.0}
        if objective[i, k] < best:
            best, b, hinge, done = float(objective[i, k]), float(tried[k]), float(hinges[i, k]), {"keep": float(1 - share[i]), "add": float(length[i])}
        centre += bias_step * (plus - minus)
        rows = of(out, ROWS)
        factors = _balanced(plus, minus)
        state = take(of(state, STATE).unionByName(out), first=True, last=blocks == 1, now=factors, **done)
        if blocks > 1:
            p |= {"length": step, "start": centre}
            far = packed.by_block(_looker(p), of(state, MESSAGE).unionByName(rows))
            joint = cut_lineage(far.groupBy("part").applyInArrow(_joint(p), LINES))
            more = _totals(joint)
            up, down = (float(sum(t[k] for t in more)) for k in (0, 1))
            plus, minus, largest = plus + up, minus + down, max([largest, *[t[2] for t in more]])
            centre += bias_step * (up - down)
            moved, factors = of(joint, MOVED), _balanced(plus, minus)
            state = take(of(state, STATE).unionByName(joint), first=False, last=True, now=factors)
        balance = plus - minus
        sums = sum(_totals(state), np.zeros(3 + len(_MIXES)))
        bound, mix = problem.measure(sums, factors[0] * plus + factors[1] * minus)
        lower = max(lower, bound)
        p |= done | {"mix": (float(mix[0]), float(mix[1])), "factors": factors, "scale": 1.0}
        if best - lower <= tol * max(1.0, abs(best)):
            status = "optimal"
            break
        if blocks > 1:
            # the duals, and all that is linear in them, go on from the best multiple of themselves
            p["scale"] = float(problem.rescale(plus, minus, largest, centre, cost))
            balance *= p["scale"]

    def weights_of(key, links, state):
        import pyarrow as pa
        at = found(state, STATE)
        ids, w = (array(links, "a", found(links, IDS)[0], np.int64), array(state, "c", at[0])) if at else (np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"feature_id": ids[w != 0], "weight": w[w != 0]})

    def duals_of(block, pieces, features, light):
        import pyarrow as pa
        ids, y = (np.concatenate([piece[k] for piece in pieces]) for k in (0, 1))
        _, z, hold = _rows_of(light, y, p)
        return pa.table({"row_id": ids, "y": y.astype(np.int32), "margin": y * (z + b), "pi": hold})
    weights = cut_lineage(links.groupBy("part").cogroup(of(state, STATE).groupBy("part")).applyInArrow(weights_of, "feature_id long, weight double"))
    duals = packed.by_block(duals_of, rows.unionByName(moved), "row_id long, y int, margin double, pi double")
    return Ascended(weights, b, best, lower, hinge, epoch + 1, status, duals, blocks)


def descend(stored: StoredMatrix, problem: Pricing, cost: float = 1.0, tol: float = 1e-3, passes: int = PASSES,
            max_epochs: int = MAX_EPOCHS, biases: tuple = ()) -> Ascended:
    """Epochs of pricing until (objective - bound) <= tol * max(1, |objective|)."""
    spark, cost, zero, packed = stored.matrix.sparkSession, float(cost), F.lit(0.0), stored.packed
    state = problem.features(spark)
    # the cells belong to the first of several rows of one id
    copy = (F.row_number().over(Window.partitionBy("row_id").orderBy("y")) - 1).alias("copy")
    rows = stored.labels.select("row_id", copy, "y", zero.alias("zb"), zero.alias("hold"))
    out = spark.createDataFrame([], _WORKED)
    centre, balance, best, b, hinge, lower = 0.0, 0.0, np.inf, 0.0, 0.0, -np.inf
    status = "max_iter"
    # one class alone is held by the bias
    share = _BIAS_SHARE if stored.plus and stored.minus else 1.0
    # a short step of the weights would leave the classes out of balance, and the bound with them
    slowest = share * problem.tau * stored.mean_square
    for epoch in range(max_epochs):
        step, bias_step = problem.tau, max(slowest, share * problem.tau * stored.mean_square)
        start = centre + bias_step * balance
        lookup = state.select("feature_id", F.col("w0").alias("c"), problem.start().alias("u"), problem.clipped(problem.start()).alias("e"), "g")
        sent = packed.messages(lookup, ["c", "e", "u", "g"])
        scored = packed.scores(sent, {"z": "a", "zu": "b"}).withColumn("copy", F.lit(0))
        duals = out.where(F.col("kind") == _ROW).select(F.col("id").alias("row_id"), "copy", F.col("a").alias("pi"), F.lit(True).alias("worked"))
        rows = cut_lineage(rows.join(duals, ["row_id", "copy"], "left").join(scored, ["row_id", "copy"], "left").select(
            "row_id", "copy", "y", F.coalesce("pi", zero).alias("pi"), "zb", "hold", F.coalesce("z", zero).alias("z"), F.coalesce("zu", zero).alias("zu"),
            F.coalesce("cells", F.lit(0)).alias("cells"), F.coalesce("worked", F.lit(False)).alias("worked")))
        tried = np.unique(np.concatenate([centre + _BIAS, b + _BIAS, np.array(biases)]))
        facts = rows.mapInArrow(_hinges(_SHARES, tried, cost, centre, start), "id long, a double").groupBy("id").agg(F.sum("a").alias("a"))
        sums = np.zeros(len(_SHARES) * len(tried) + 2)
        for r in facts.collect():
            sums[r["id"]] = r["a"]
        objective = problem.cost_of(_SHARES)[:, None] + cost * sums[:-2].reshape(len(_SHARES), -1)
        i, k = np.unravel_index(objective.argmin(), objective.shape)
        if objective[i, k] < best:
            best, b, hinge, add = float(objective[i, k]), float(tried[k]), float(sums[i * len(tried) + k]), float(_SHARES[i])
            rows, state = (t.withColumn(n, F.lit(1 - add) * F.col(n) + F.lit(add) * F.col(m)) for t, n, m in ((rows, "zb", "z"), (state, "wb", "w0")))
        if best - lower <= tol * max(1.0, abs(best)):
            status = "optimal"
            break
        # the rows that hold the step, dealt anew in each epoch
        blocks = int(max(1, -(-sums[-1] // min(stored.block_cells, WORK_CELLS))))
        p = {"epoch": epoch, "blocks": blocks, "passes": passes, "cost": cost, "step": step, "bias_step": bias_step, "start": start, "box": problem.box,
             "cut": problem.cut, "multiplier": problem.multiplier, "side": problem.side}
        block = F.pmod(F.xxhash64("row_id", F.lit(epoch)), F.lit(blocks)).cast("int").alias("block")
        work = cut_lineage(rows.where((F.col("pi") > 0) | (F.col("y") * (F.col("zu") + F.lit(start)) < 1)).select("row_id", "copy", "y", "pi"))
        cells = packed.cells_of(work.where("copy = 0").select("row_id"), sent, {"u": "c", "g": "d"}).select(block, "*")
        out = cut_lineage(cells.groupBy("block").cogroup(work.select(block, "*").groupBy("block"))
                          .applyInArrow(_limited_solver(p), _WORKED))
        moved = (out.where(F.col("kind") == _FEATURE).groupBy(F.col("id").alias("feature_id"))
                 .agg(F.sum("a").alias("_vp"), F.sum("b").alias("_vn")))
        state = cut_lineage(state.drop("vp", "vn").join(moved, "feature_id", "full_outer").select(
            "feature_id", *[F.coalesce(n, zero).alias(m) for n, m in (("_vp", "vp"), ("_vn", "vn"), ("g", "g"), ("w0", "w0"), ("wb", "wb"))]))
        sides = {r["side"]: r["a"] for r in out.where(F.col("kind") == _ROW).groupBy((F.col("b") > 0).alias("side")).agg(F.sum("a").alias("a")).collect()}
        plus, minus = sides.get(True, 0.0), sides.get(False, 0.0)
        balance = plus - minus
        centre += bias_step * balance
        factors = _balanced(plus, minus)
        state = problem.next_centre(state)
        bound = problem.measure(state, factors, factors[0] * plus + factors[1] * minus, float(sums[-2]))
        if bound > lower:
            lower = bound
            held = out.where(F.col("kind") == _ROW).select(F.col("id").alias("row_id"), "copy", (
                F.when(F.col("b") > 0, factors[0]).otherwise(factors[1]) * F.col("a")).alias("_hold"))
            rows = rows.join(held, ["row_id", "copy"], "left").withColumn("hold", F.coalesce("_hold", zero))
        rows = rows.select("row_id", "copy", "y", "zb", "hold")
        if best - lower <= tol * max(1.0, abs(best)):
            status = "optimal"
            break
        if problem.box is None and epoch >= 12 and not np.isfinite(lower):
            status = "unbounded_suspected"
            break
    weights = state.where(F.col("wb") != 0).select("feature_id", F.col("wb").alias("weight"))
    duals = rows.select("row_id", "y", (F.col("y") * (F.col("zb") + F.lit(b))).alias("margin"), F.col("hold").alias("pi"))
    return Ascended(weights, b, best, lower, hinge, epoch + 1, status, duals, stored.blocks)


def fit_norm(stored: StoredMatrix, cost: float = 1.0, tol: float = 1e-3, squared: bool = False, signs: DataFrame | None = None,
             **options) -> Ascended:
    """min |w| + C*sum(xi), or with half the squared norm; the bias is free, ``signs`` as in ``Norm``."""
    if not stored.plus or not stored.minus:
        # one class only: the zero vector with a bias has no slack
        side = 1.0 if stored.plus else -1.0
        none = stored.matrix.sparkSession.createDataFrame([], "feature_id long, weight double")
        duals = stored.labels.select("row_id", "y", F.lit(1.0).alias("margin"), F.lit(0.0).alias("pi"))
        return Ascended(none, side, 0.0, 0.0, 0.0, 0, "optimal", duals, stored.blocks)
    return ascend(stored, Norm(stored, squared, signs), cost, tol, **options)


def fit_price(stored: StoredMatrix, gradient: DataFrame, cost: float = 1.0, box: float | None = 1e4, cut: str | None = None,
              tol: float = 1e-3, **options) -> Ascended:
    """min C*sum(xi) - g.w over the box; the gradient is (feature_id, grad)."""
    far = ()
    if not stored.plus or not stored.minus:
        reach = 1.0 + (box or 1e4) * stored.longest_row()
        far = (-reach, reach)
    return descend(stored, Pricing(stored, gradient, box, cut), cost, tol, biases=far, **options)
