"""Fits on the probability simplex, in numpy; each checks what it returns."""

from __future__ import annotations

import itertools

import numpy as np


def full(triangle, n: int) -> np.ndarray:
    g = np.zeros((n, n))
    g[np.triu_indices(n)] = triangle
    return g + np.triu(g, 1).T


def project_simplex(v: np.ndarray) -> np.ndarray:
    u = np.sort(v)[::-1]
    theta = ((np.cumsum(u) - 1) / np.arange(1, len(v) + 1)).max()
    return np.maximum(v - theta, 0)


def kkt_gap(g: np.ndarray, c: np.ndarray, w: np.ndarray) -> float:
    """How far w is from optimal for w'Gw - 2c'w: the Frank-Wolfe gap, scaled."""
    grad = g @ w - c
    return float((grad @ w - grad.min()) / max(1.0, abs(np.trace(g)) / len(w)))


def simplex_qp(g: np.ndarray, c: np.ndarray, tolerance: float = 1e-9) -> tuple[np.ndarray, float]:
    """(weights, gap) minimizing w'Gw - 2c'w for w >= 0, sum w = 1.

    An active set: start at the best vertex, free the peer with the least gradient, solve the equality-constrained
    problem on the free peers (the least-norm solution where it is singular) and step back to the
    boundary where a weight would turn negative.
    """
    p = len(c)
    w = np.zeros(p)
    w[int(np.argmin(np.diag(g) - 2 * c))] = 1.0
    scale = max(1e-300, abs(np.trace(g)) / p)
    free = w > 0
    for _ in range(50 * p):
        grad = (g @ w - c) / scale
        level = grad @ w
        j = int(np.argmin(np.where(free, np.inf, grad))) if not free.all() else -1
        if j < 0 or grad[j] >= level - 1e-13:
            break
        free[j] = True
        for _ in range(p + 1):
            at = np.flatnonzero(free)
            k = np.block([[g[np.ix_(at, at)] / scale, np.ones((len(at), 1))], [np.ones((1, len(at))), np.zeros((1, 1))]])
            goal = np.linalg.lstsq(k, np.r_[c[at] / scale, 1.0], rcond=1e-13)[0][:-1]
            if (goal >= -1e-14).all():
                w = np.zeros(p)
                w[at] = np.maximum(goal, 0)
                break
            step, now = 1.0, w[at]
            down = goal < now - 1e-300
            ratio = np.where(down & (goal < 0), now / np.where(down, now - goal, 1), np.inf)
            step = min(1.0, ratio.min())
            new = np.maximum(now + step * (goal - now), 0)
            new[int(np.argmin(ratio))] = 0.0
            w = np.zeros(p)
            w[at] = new
            free = w > 0
        w /= w.sum()
        free = w > 0
    gap = kkt_gap(g, c, w)
    if gap > max(tolerance, 1e-7):
        w, gap = best_support(g, c)
    return w, gap


#: Peers whose supports are all tried: 4,095 small systems, about a second.
MOST_PEERS = 12


def best_support(g: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, float]:
    """The same minimum from every set of peers: with one of a set as origin the others' weights are free, and the set counts if its optimum is a mixture."""
    p = len(c)
    if p > MOST_PEERS:
        raise ValueError(f"the active set failed, and supports of more than {MOST_PEERS} peers are not tried one by one")
    best, least = np.zeros(p), np.inf
    for mask in range(1, 1 << p):
        at = [i for i in range(p) if mask >> i & 1]
        o, rest = at[0], at[1:]
        q = g[np.ix_(rest, rest)] - g[rest, o][:, None] - g[o, rest][None, :] + g[o, o]
        h = c[rest] - c[o] - g[rest, o] + g[o, o]
        v = np.linalg.pinv(q, hermitian=True) @ h if rest else np.zeros(0)
        value = v @ q @ v - 2 * h @ v + g[o, o] - 2 * c[o]
        if (v >= 0).all() and v.sum() <= 1 and value < least:
            best, least = np.zeros(p), value
            best[rest], best[o] = v, 1 - v.sum()
    return best, kkt_gap(g, c, best)


def projected_gradient(g: np.ndarray, c: np.ndarray, rounds: int = 20_000, tolerance: float = 1e-12) -> np.ndarray:
    """The same minimum by accelerated projected gradient steps: slow, and independent of the active set, which it cross-checks."""
    step = 1 / max(1e-300, float(np.linalg.eigvalsh(g).max()))
    w = ahead = np.full(len(c), 1 / len(c))
    pace = 1.0
    for _ in range(rounds):
        new = project_simplex(ahead - step * (g @ ahead - c))
        if (ahead - new) @ (new - w) > 0:  # past the minimum: start anew
            pace = 1.0
        after = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead = new + (pace - 1) / after * (new - w)
        moved, w, pace = np.abs(new - w).max(), new, after
        if moved < tolerance:
            break
    return w


def minimum_norm(g: np.ndarray, c: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Of all optimal weights (same prediction Xw) the one of least norm: projects onto w + null(G), staying on the simplex."""
    values, vectors = np.linalg.eigh(g)
    null = vectors[:, values <= max(values.max(), 0) * 1e-12]
    null = null - np.outer(np.ones(len(w)), np.ones(len(w)) @ null) / len(w) if null.size else null
    if not null.size or np.abs(null).max() < 1e-12:
        return w
    # Dykstra between the affine set of equal predictions (and sum) and the non-negative orthant, from the least-norm point.
    rows = np.vstack([vectors[:, values > max(values.max(), 0) * 1e-12].T, np.ones(len(w))])
    inverse, target = np.linalg.pinv(rows), rows @ w
    x, p, q = np.zeros(len(w)), np.zeros(len(w)), np.zeros(len(w))
    for _ in range(20000):
        y = x + p
        a = y - inverse @ (rows @ y - target)
        p = y - a
        z = a + q
        new = np.maximum(z, 0)
        q = z - new
        if np.abs(new - x).max() < 1e-14:
            x = new
            break
        x = new
    return x / x.sum() if abs(x.sum() - 1) < 1e-6 else w


def weighted_median_fraction(y: np.ndarray, a: np.ndarray, b: np.ndarray, m: np.ndarray) -> float:
    """The weight of a in [0, 1] that minimizes sum m |y - wa - (1-w)b|: a weighted median of ratios, the smallest minimizer."""
    d = a - b
    on = np.abs(d) > 0
    if not on.any():
        return 0.0
    r, q = (y - b)[on] / d[on], (m * np.abs(d))[on]
    order = np.argsort(r, kind="stable")
    at = np.searchsorted(np.cumsum(q[order]), q.sum() / 2)
    return float(np.clip(r[order][min(at, len(r) - 1)], 0, 1))


def simplex_l1(x: np.ndarray, y: np.ndarray, m: np.ndarray, tolerance: float = 1e-9) -> tuple[np.ndarray, float]:
    """(weights, duality gap) minimizing sum m |y - Xw| / sum m on the simplex, by a primal-dual interior point on the LP.

    Split residuals u - v = y - Xw. The gap is that of a dual feasible point, so it bounds the error.
    """
    n, p = x.shape
    m = m / m.sum()
    # min m'(u+v), Xw + u - v = y, 1'w = 1, all >= 0
    forth = lambda z: np.r_[x @ z[:p] + z[p : p + n] - z[p + n :], z[:p].sum()]
    back = lambda u: np.r_[x.T @ u[:n] + u[n], u[:n], -u[:n]]
    b, cost = np.r_[y, 1.0], np.r_[np.zeros(p), m, m]
    w = np.full(p, 1 / p)
    r = y - x @ w
    pad = max(1e-3, np.abs(r).mean())
    z = np.r_[w, np.maximum(r, 0) + pad, np.maximum(-r, 0) + pad]
    dual, slack = np.zeros(n + 1), np.maximum(cost, m.min() * 0.5)
    slack[:p] = max(1e-2, np.abs(x).max())
    dual[n] = -slack[0] - 0.0
    loss = lambda w: float(m @ np.abs(y - x @ w))
    best, bound = z[:p] / z[:p].sum(), -np.inf

    def polished(w: np.ndarray) -> np.ndarray:
        """The vertex nearby: the support's weights that make the smallest residuals zero."""
        at = np.flatnonzero(w > 1e-6)
        near = np.argsort(np.abs(y - x @ w), kind="stable")[: max(1, len(at) - 1)]
        system = np.vstack([x[np.ix_(near, at)], np.ones(len(at))])
        v = np.linalg.lstsq(system, np.r_[y[near], 1.0], rcond=None)[0]
        out = np.zeros(p)
        out[at] = np.maximum(v, 0)
        return out / out.sum() if out.sum() > 0 else w

    old = np.seterr(all="ignore")
    for _ in range(100):
        # What the iterates prove: |lambda_i| <= m_i is dual feasible with value y'lambda - max_j (X'lambda)_j.
        now = np.where(z[:p] < 1e-12, 0, z[:p])
        now = now / now.sum()
        lam = np.clip(dual[:n], -m, m)
        bound = max(bound, float(y @ lam - (x.T @ lam).max()))
        if not np.isfinite(now).all():
            break
        best = min((best, now, polished(now)), key=loss)
        if loss(best) - bound <= tolerance or loss(now) > 1e3 * max(loss(best), tolerance):
            break
        rp, rd = b - forth(z), cost - back(dual) - slack
        mu = z @ slack / len(z)
        d = z / slack
        # (A D A') dy = rhs by its structure: a diagonal E, p columns and one border, so p + 1 unknowns.
        dx, e = d[:p], d[p : p + n] + d[p + n :]
        xe = x / e[:, None]
        border = np.block([[np.eye(p) + (xe.T @ x) * dx, -np.ones((p, 1))], [dx[None, :], np.zeros((1, 1))]])

        def solve(rhs, dx=dx, e=e, xe=xe, border=border):
            s_nu = np.linalg.solve(border, np.r_[xe.T @ rhs[:n], rhs[n]])
            return np.r_[(rhs[:n] - x @ (dx * s_nu[:p])) / e, s_nu[p]]

        def step(centre):
            rc = centre - z * slack
            dy = solve(rp + forth(d * (rd - rc / z)))
            ds = rd - back(dy)
            return rc / slack - d * ds, dy, ds

        def most(v, dv_):
            neg = dv_ < 0
            return min(1.0, 0.9995 * float((-v[neg] / dv_[neg]).min())) if neg.any() else 1.0

        try:
            dz, dy, ds = step(0.0)
        except np.linalg.LinAlgError:  # as near as the numbers allow; the gap below tells how near
            break
        after = (z + most(z, dz) * dz) @ (slack + most(slack, ds) * ds) / len(z)
        dz, dy, ds = step((after / mu) ** 3 * mu)
        z, f = z + most(z, dz) * dz, most(slack, ds)
        dual, slack = dual + f * dy, slack + f * ds
    np.seterr(**old)
    return best, max(loss(best) - bound, 0.0)


def weight_interval(g: np.ndarray, c: np.ndarray, w: np.ndarray, peer: int, slack: float) -> tuple[float, float]:
    """Least and greatest weight of a peer among weights whose objective is within ``slack`` of the optimum, by bisection on fixed weights."""
    base = w @ g @ w - 2 * c @ w

    def cost(t: float) -> float:
        rest = [i for i in range(len(w)) if i != peer]
        if not rest or t >= 1:
            return g[peer, peer] - 2 * c[peer]
        scale = 1 - t
        v, _ = simplex_qp(g[np.ix_(rest, rest)] * scale, c[rest] - t * g[rest, peer])
        full_w = np.zeros(len(w))
        full_w[rest], full_w[peer] = scale * v, t
        return full_w @ g @ full_w - 2 * c @ full_w

    ends = []
    for edge in (0.0, 1.0):
        inside, outside = float(w[peer]), edge
        if cost(outside) <= base + slack:
            ends.append(outside)
            continue
        for _ in range(50):
            mid = (inside + outside) / 2
            inside, outside = (mid, outside) if cost(mid) <= base + slack else (inside, mid)
        ends.append(inside)
    return ends[0], ends[1]


def repaired(w: np.ndarray, low: float = -1e-14, total: float = 1e-12) -> tuple[np.ndarray, bool]:
    """Weights that pass the gates, clipped and normalized if need be; gross violations raise."""
    if w.min() < -1e-7 or abs(w.sum() - 1) > 1e-7 or not np.isfinite(w).all():
        raise ValueError("weights are off the simplex")
    if w.min() >= low and abs(w.sum() - 1) <= total:
        return w, False
    w = np.maximum(w, 0)
    return w / w.sum(), True


def golden_section(f, low: float, high: float, steps: int = 80) -> float:
    ratio = (np.sqrt(5) - 1) / 2
    a, b = low, high
    x, y = b - ratio * (b - a), a + ratio * (b - a)
    fx, fy = f(x), f(y)
    for _ in range(steps):
        if fx <= fy:
            b, y, fy = y, x, fx
            x = b - ratio * (b - a)
            fx = f(x)
        else:
            a, x, fx = x, y, fy
            y = a + ratio * (b - a)
            fy = f(y)
    return (a + b) / 2
