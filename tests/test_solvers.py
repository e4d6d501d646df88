import numpy as np
import pytest

from convexus.operators import solvers


@pytest.mark.parametrize("seed", range(40))
def test_qp_is_optimal_and_l1_proves_its_gap(seed):
    r = np.random.default_rng(seed)
    n, p = int(r.integers(5, 50)), int(r.integers(1, 7))
    x = r.normal(size=(n, p))
    y = x @ r.dirichlet(np.ones(p)) + 0.1 * r.normal(size=n)
    w, gap = solvers.simplex_qp(x.T @ x, x.T @ y)
    best, _ = solvers.best_support(x.T @ x, x.T @ y)
    assert gap <= 1e-9 and w.min() >= 0 and abs(w.sum() - 1) < 1e-12
    assert ((y - x @ w) ** 2).sum() <= ((y - x @ best) ** 2).sum() + 1e-9
    u = solvers.projected_gradient(x.T @ x, x.T @ y)
    assert abs(((y - x @ w) ** 2).sum() - ((y - x @ u) ** 2).sum()) <= 1e-6
    v, gap = solvers.simplex_l1(x, y, np.ones(n))
    assert gap < 1e-6
    loss = np.abs(y - x @ v).mean()
    for _ in range(50):
        assert loss <= np.abs(y - x @ r.dirichlet(np.ones(p))).mean() + 1e-6


def test_two_peers_agree_with_weighted_median():
    r = np.random.default_rng(3)
    for _ in range(20):
        x, m = r.normal(size=(31, 2)), r.random(31) + 0.1
        y = x @ [0.4, 0.6] + 0.2 * r.normal(size=31)
        t = solvers.weighted_median_fraction(y, x[:, 0], x[:, 1], m)
        w, _ = solvers.simplex_l1(x, y, m)
        loss = lambda t: (m * np.abs(y - t * x[:, 0] - (1 - t) * x[:, 1])).sum() / m.sum()
        assert abs(loss(t) - loss(w[0])) < 1e-6


@pytest.mark.parametrize("weights", [[0, 1, 0, 0], [0.25, 0.25, 0.25, 0.25], [0, 0.6, 0, 0.4]])
def test_a_mixture_is_found_again(weights):
    t = np.arange(1, 91)[:, None]
    x = np.sin(t * [1.0, 1.7, 2.9, 4.3])
    y = x @ weights
    fit, held = slice(0, 45), slice(45, 90)
    got, gap = solvers.simplex_qp(x[fit].T @ x[fit], x[fit].T @ y[fit])
    assert gap <= 1e-9 and np.abs(y[held] - x[held] @ got).max() <= 1e-8


def test_l1_on_many_rows_needs_no_square_matrix():
    import tracemalloc

    r = np.random.default_rng(2)
    x = r.normal(size=(20_000, 4))
    y = x @ [0.1, 0.2, 0.3, 0.4] + 0.1 * r.normal(size=20_000)
    tracemalloc.start()
    w, gap = solvers.simplex_l1(x, y, np.ones(20_000))
    assert tracemalloc.get_traced_memory()[1] < 60e6 and gap < 1e-6 and np.abs(w - [0.1, 0.2, 0.3, 0.4]).max() < 0.02
    tracemalloc.stop()


def test_minimum_norm_shares_between_equal_peers():
    x = np.random.default_rng(1).normal(size=(50, 3))
    x = np.c_[x, x[:, 0]]
    g, c = x.T @ x, x.T @ (x @ [0.6, 0.4, 0, 0])
    w = solvers.minimum_norm(g, c, solvers.simplex_qp(g, c)[0])
    assert np.allclose(w, [0.3, 0.4, 0, 0.3], atol=1e-6)


def test_projection_and_intervals():
    assert np.allclose(solvers.project_simplex(np.array([0.2, 0.9, -1.0])), [0.15, 0.85, 0])
    g, c = np.diag([1.0, 1.0]), np.array([0.5, 0.5])
    low, high = solvers.weight_interval(g, c, np.array([0.5, 0.5]), 0, 0.02)
    assert low == pytest.approx(0.4, abs=1e-6) and high == pytest.approx(0.6, abs=1e-6)


def test_gates():
    assert solvers.repaired(np.array([0.5, 0.5]))[1] is False
    assert solvers.repaired(np.array([1.0 + 1e-9, -1e-9]))[1] is True
    with pytest.raises(ValueError):
        solvers.repaired(np.array([1.1, -0.1]))
