"""Projections, bounds and steps of the pool-sized solver, against brute force and random points."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from widemargin.operators.newton import (Regulariser, box_bound, box_set, combination_bound, combination_set, minimise,
                                         nonnegative_fit, to_simplex)
from widemargin.operators.rows import hinge_terms, split_terms

KINDS = ("convexo", "afin", "conico", "mayor_uno", "libre")
vectors = st.lists(st.floats(-20, 20), min_size=2, max_size=8).map(np.array)


def evaluator(z, y):
    def evaluate(points, width, after=None):
        points = np.atleast_2d(points)
        return split_terms(hinge_terms(z, y, points, width), len(points), z.shape[1])
    return evaluate


def data(seed, n=60, k=5):
    rng = np.random.default_rng(seed)
    z = rng.normal(size=(n, k))
    y = np.where(z[:, 0] + 0.5 * rng.normal(size=n) > 0, 1.0, -1.0)
    return z, y


@given(vectors)
def test_simplex_projection_is_feasible_and_nearest(v):
    p = to_simplex(v)
    assert p.min() >= 0 and abs(p.sum() - 1) < 1e-9
    rng = np.random.default_rng(0)
    others = rng.dirichlet(np.ones(len(v)), 50)
    assert np.linalg.norm(v - p) <= np.linalg.norm(v - others, axis=1).min() + 1e-9


@given(vectors, st.sampled_from(KINDS), st.integers(0, 2))
def test_combination_projection_is_idempotent(v, kind, n_rays):
    rays = np.zeros(len(v), bool)
    rays[:min(n_rays, len(v) - 1)] = True
    project = combination_set(kind, rays)
    once = project(v)
    assert np.allclose(project(once), once, atol=1e-9)
    assert once[rays].min(initial=0.0) >= 0


@given(vectors, st.floats(0.1, 10), st.sampled_from((None, "halfspace", "sign")))
def test_box_projection_is_feasible(v, m, cut):
    g = np.roll(v, 1) - 0.3
    w = box_set(m, g, cut)(v)
    assert np.abs(w).max() <= m + 1e-9
    if cut == "halfspace":
        assert g @ w <= 1e-6 * (1 + np.abs(g).sum() * m)
    if cut == "sign":
        assert (g * w).max() <= 1e-9


@pytest.mark.parametrize("seed", range(5))
def test_nonnegative_fit_satisfies_its_conditions(seed):
    rng = np.random.default_rng(seed)
    w = rng.normal(size=(9, 6))
    gram, q = w.T @ w, rng.normal(size=6)
    signed = np.array([True, True, True, True, False, False])
    x, solved = nonnegative_fit(gram, q, signed)
    pull = q - gram @ x
    assert solved and x[signed].min() >= 0
    assert pull[signed].max() <= 1e-6 and np.abs(pull[~signed]).max() <= 1e-6


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("n_rays", (0, 2))
def test_master_bounds_enclose_random_points(kind, n_rays):
    z, y = data(1)
    rng = np.random.default_rng(2)
    w = rng.normal(size=(7, 5))
    gram, rays = w.T @ w, np.zeros(5, bool)
    rays[5 - n_rays:] = n_rays > 0
    project = combination_set(kind, rays)
    start = np.append(project(np.full(5, 0.2)), 0.0)
    found = minimise(evaluator(z, y), Regulariser(gram), project, start, 1.0, combination_bound(gram, kind, rays), 1e-3, 300)
    assert found.lower <= found.objective + 1e-9
    assert np.allclose(project(found.point[:-1]), found.point[:-1], atol=1e-7)
    for _ in range(300):
        x = project(rng.normal(size=5) * 2)
        b = rng.normal()
        value = np.sqrt(x @ gram @ x) + np.maximum(0, 1 - y * (z @ x + b)).sum()
        assert value >= found.lower - 1e-7


@pytest.mark.parametrize("cut", (None, "halfspace", "sign"))
@pytest.mark.parametrize("m", (0.5, 5.0, 1e4))
def test_pricing_is_proven_close_to_its_bound(cut, m):
    z, y = data(3)
    g = np.random.default_rng(4).normal(size=5)
    found = minimise(evaluator(z, y), Regulariser(np.zeros((5, 5)), kind="none", linear=-g), box_set(m, g, cut),
                     np.zeros(6), 1.0, box_bound(g, m, cut), 1e-2, 300)
    assert found.gap <= 2e-2
    assert np.abs(found.point[:-1]).max() <= m * (1 + 1e-9)


def test_separable_rows_reach_no_slack():
    z = np.array([[2.0, 0], [3, 1], [-2, 0], [-3, -1]])
    y = np.array([1.0, 1, -1, -1])
    rays = np.zeros(2, bool)
    found = minimise(evaluator(z, y), Regulariser(np.eye(2)), combination_set("libre", rays), np.zeros(3), 100.0,
                     combination_bound(np.eye(2), "libre", rays), 1e-4, 300)
    assert found.hinge < 1e-2 and abs(found.objective - 0.5) < 0.05


def test_scaling_the_rows_does_not_break_the_steps():
    z, y = data(5, 200, 4)
    y[:150] = -1.0
    for factor in (1.0, 25.0):
        rays = np.zeros(4, bool)
        found = minimise(evaluator(z * factor, y), Regulariser(np.eye(4)), combination_set("libre", rays), np.zeros(5),
                         1.0, combination_bound(np.eye(4), "libre", rays), 1e-3, 300)
        assert found.gap <= 1e-2


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10_000), st.floats(0.05, 4))
def test_smoothed_sums_lie_below_the_exact_ones(seed, width):
    z, y = data(seed, 20, 3)
    point = np.random.default_rng(seed).normal(size=(1, 4))
    sums = split_terms(hinge_terms(z, y, point, width), 1, 3)
    assert sums["smooth"][0] <= sums["hinge"][0] + 1e-9
    assert sums["smooth"][0] >= sums["hinge"][0] - 0.5 * width * len(y) - 1e-9


def test_unknown_types_are_refused():
    with pytest.raises(ValueError):
        combination_set("something", np.zeros(2, bool))
    with pytest.raises(ValueError):
        box_set(1.0, np.zeros(2), "something")
