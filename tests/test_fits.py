"""The queries that fit in numpy, against plain versions on the collected design."""

import numpy as np
import pytest

from convexus import catalog
from convexus.operators import solvers
from convexus.operators.pairs import aligned_splits


@pytest.fixture(scope="module")
def design(spark, sf_dir):
    pdf = aligned_splits(spark, sf_dir).toPandas()
    return {s: (np.stack(p[p.side == "fit"].x.to_list()), np.stack(p[p.side == "eval"].x.to_list())) for s, p in pdf.groupby("split_seed")}


@pytest.fixture(scope="module")
def subsets(spark, sf_dir):
    return {(r["split_seed"], r["target"], tuple(r["peers"])): r for r in catalog.QUERIES["subset_fits"](spark, sf_dir).collect()}


def test_residual_full(spark, sf_dir, design):
    rows = catalog.QUERIES["residual_full"](spark, sf_dir).collect()
    assert len(rows) == 5 * len(design)
    for r in rows:
        fit, held = design[r["split_seed"]]
        p, t = list(r["peers"]), r["target"]
        x, y = fit[:, p], fit[:, t]
        best, _ = solvers.best_support(x.T @ x, x.T @ y)
        assert ((y - x @ np.array(r["weights"])) ** 2).sum() <= ((y - x @ best) ** 2).sum() + 1e-12
        assert r["mix_error"] == pytest.approx(np.abs(held[:, t] - held[:, p] @ np.array(r["weights"])).mean(), abs=1e-12)
        assert r["kkt_gap"] <= 1e-7


def test_removals_and_shapley_follow_from_subsets(spark, sf_dir, design, subsets):
    assert len(subsets) == 15 * 5 * len(design)
    for r in catalog.QUERIES["peer_removal_full"](spark, sf_dir).collect():
        peers = [i for i in range(5) if i != r["target"]]
        less = tuple(i for i in peers if i != r["removed"])
        want = subsets[r["split_seed"], r["target"], less]["mix_error"] - subsets[r["split_seed"], r["target"], tuple(peers)]["mix_error"]
        assert r["inflation"] == pytest.approx(want, abs=1e-12)
    shares = {}
    for r in catalog.QUERIES["shapley_coverage"](spark, sf_dir).collect():
        shares.setdefault((r["split_seed"], r["target"]), []).append(r["share"])
    for (s, t), v in shares.items():
        whole = subsets[s, t, tuple(i for i in range(5) if i != t)]["mix_error"]
        assert sum(v) == pytest.approx(np.abs(design[s][1][:, t]).mean() - whole, abs=1e-12)


def test_mae_full_is_proven(spark, sf_dir):
    for r in catalog.QUERIES["mae_full"](spark, sf_dir).collect():
        assert r["duality_gap"] < 1e-7 and abs(sum(r["weights"]) - 1) < 1e-9 and min(r["weights"]) >= 0


def test_intervals_hold_the_weights(spark, sf_dir):
    for r in catalog.QUERIES["weight_intervals"](spark, sf_dir).collect():
        assert r["low"] - 1e-9 <= r["weight"] <= r["high"] + 1e-9


def test_ridge_and_temperature(spark, sf_dir, design):
    for r in catalog.QUERIES["ridge_affine"](spark, sf_dir).collect():
        fit, t = design[r["split_seed"]][0], r["target"]
        x = np.c_[np.delete(fit, t, 1), np.ones(len(fit))]
        w = np.linalg.solve(x.T @ x + 1e-6 * np.diag([1, 1, 1, 1, 0]), x.T @ fit[:, t])
        assert np.allclose([*r["coefficients"], r["intercept"]], w, atol=1e-8)
    for r in catalog.QUERIES["temperature_fit"](spark, sf_dir).collect():
        assert 0.05 <= r["temperature"] <= 20.001 and r["nll"] <= r["nll_raw"] + 1e-12


def test_temperature_is_the_best_of_a_grid(spark, sf_dir):
    from convexus.plans.vector_queries import logits

    rows = [(r["vec_id"] // 100, np.array(r["z"]), r["label"] % 64) for r in logits(spark, sf_dir).where("label IS NOT NULL").collect()]
    for r in catalog.QUERIES["temperature_fit"](spark, sf_dir).collect():
        own = [(z, g) for k, z, g in rows if k == r["grp"]]

        def loss(t, own=own):
            return np.mean([np.log(np.exp(z / t - (z / t).max()).sum()) + (z / t).max() - z[g] / t for z, g in own])

        assert len(own) == r["n"] and loss(r["temperature"]) == pytest.approx(r["nll"], abs=1e-9)
        assert all(r["nll"] <= loss(t) + 1e-9 for t in np.exp(np.linspace(np.log(0.05), np.log(20), 60)))


def test_intervals_hold_every_mixture_that_is_good_enough(spark, sf_dir, design):
    r = np.random.default_rng(0)
    tried = np.vstack([r.dirichlet(np.full(4, a), 4000) for a in (0.2, 1.0, 5.0)])
    rows = {(x["split_seed"], x["target"], x["peer"]): x for x in catalog.QUERIES["weight_intervals"](spark, sf_dir).collect()}
    for s, (fit, _) in design.items():
        for t in range(5):
            p = [i for i in range(5) if i != t]
            loss = lambda w, fit=fit, t=t, p=p: ((fit[:, t] - fit[:, p] @ w) ** 2).mean()
            best = loss(np.array([rows[s, t, k]["weight"] for k in p]))
            for w in tried:
                if loss(w) <= 1.01 * best:
                    assert all(rows[s, t, k]["low"] - 1e-6 <= v <= rows[s, t, k]["high"] + 1e-6 for k, v in zip(p, w, strict=True))


def test_absolute_loss_beats_every_mixture_tried(spark, sf_dir, design):
    r = np.random.default_rng(1)
    tried = np.vstack([r.dirichlet(np.full(4, a), 3000) for a in (0.2, 1.0, 5.0)])
    for row in catalog.QUERIES["mae_full"](spark, sf_dir).collect():
        fit, t = design[row["split_seed"]][0], row["target"]
        p = [i for i in range(5) if i != t]
        loss = lambda w, fit=fit, t=t, p=p: np.abs(fit[:, t] - fit[:, p] @ w).mean()
        assert loss(np.array(row["weights"])) == pytest.approx(row["objective"], abs=1e-12)
        assert all(row["objective"] <= loss(w) + 1e-9 for w in tried)


def test_shares_add_up_to_the_whole_coverage(spark, sf_dir, design, subsets):
    total = {}
    for r in catalog.QUERIES["shapley_coverage"](spark, sf_dir).collect():
        total[r["split_seed"], r["target"]] = total.get((r["split_seed"], r["target"]), 0.0) + r["share"]
    for (s, t), got in total.items():
        whole = subsets[s, t, tuple(i for i in range(5) if i != t)]["mix_error"]
        assert got == pytest.approx(np.abs(design[s][1][:, t]).mean() - whole, abs=1e-12)


def test_regressor_of_each_city(spark, sf_dir):
    from convexus.plans.traffic_queries import calendar_features, lag_lead_features

    f = lag_lead_features(spark, sf_dir).join(calendar_features(spark, sf_dir), "event_id").toPandas()
    f = f.dropna(subset=["lag1", "lag2", "target"])
    for r in catalog.QUERIES["city_regressor"](spark, sf_dir).collect():
        own = f[f.city == r["city"]]
        x = np.c_[np.ones(len(own)), own[["lag1", "lag2", "dow_sin", "dow_cos", "tod_sin", "tod_cos"]].to_numpy(float)]
        y = own["target"].to_numpy(float)
        w = np.linalg.solve(x.T @ x + 1e-6 * len(own) * np.diag([0.0] + [1.0] * 6), x.T @ y)
        assert r["n"] == len(own) and np.allclose(r["coefficients"], w, rtol=1e-5, atol=1e-7) and r["mse"] == pytest.approx(((y - x @ w) ** 2).mean(), rel=1e-6)


def test_plane_of_the_models_and_their_hull(spark, sf_dir):
    from convexus.operators import ecosystem

    wide = ecosystem.align(ecosystem.responses(spark, sf_dir), ecosystem.MODELS, ["question", "dose"]).toPandas()
    x = np.stack(wide["x"].to_list())
    x = x - x.mean(1, keepdims=True)
    _, s, v = np.linalg.svd(x, full_matrices=False)
    rows = {r["model"]: r for r in catalog.QUERIES["pca_hull_geometry"](spark, sf_dir).collect()}
    at = np.array([[rows[m]["x"], rows[m]["y"]] for m in ecosystem.MODELS])
    assert np.allclose(np.abs(at), np.abs(v[:2].T * s[:2]), atol=1e-8)
    assert rows["ASIA"]["explained"] == pytest.approx((s[:2] ** 2).sum() / (s**2).sum())
    for i, m in enumerate(ecosystem.MODELS):
        side = [[np.sign((at[j] - at[i])[0] * (at[k] - at[i])[1] - (at[j] - at[i])[1] * (at[k] - at[i])[0]) for k in range(5) if k not in (i, j)] for j in range(5) if j != i]
        assert rows[m]["on_hull"] == any(abs(sum(s)) == 3 for s in side)
