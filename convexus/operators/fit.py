"""Simplex fits of every (target, split) from sufficient statistics or rows, one small numpy solve per group."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gram, solvers


def mse_fits(aligned: DataFrame, keys: list[str], n_models: int, subsets: bool = False) -> DataFrame:
    """keys, target, peers, weights, objective, kkt_gap: each target on all its peers (with ``subsets``, on every non-empty set of them).

    The data are read once for the Gram matrices; removals and subsets are sub-matrices of these.
    """
    sums = gram.gram(aligned, keys, n_models)
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in sums.select(*keys).schema] + ["target int", "peers array<int>", "weights array<double>", "objective double", "kkt_gap double"])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for _, row in pdf.iterrows():
            g = solvers.full(row["g"], n_models) / row["mass"]
            for t in range(n_models):
                peers = [i for i in range(n_models) if i != t]
                for chosen in [list(c) for k in range(1, len(peers) + 1) for c in itertools.combinations(peers, k)] if subsets else [peers]:
                    w, gap = solvers.simplex_qp(g[np.ix_(chosen, chosen)], g[chosen, t])
                    w, _ = solvers.repaired(w)
                    value = max(0.0, float(g[t, t] - 2 * w @ g[chosen, t] + w @ g[np.ix_(chosen, chosen)] @ w))
                    rows.append([*row[keys], t, chosen, w.tolist(), value, gap])
        return pd.DataFrame(rows, columns=[*keys, "target", "peers", "weights", "objective", "kkt_gap"])

    return sums.groupBy(*keys).applyInPandas(solve, schema)


def mae_fits(aligned: DataFrame, keys: list[str], n_models: int) -> DataFrame:
    """The absolute-loss fits, each target a linear program with its proven gap. Equal rows are one with a mass; the distinct rows of a key (questions by doses, bounded by the design) meet in one group, of about 30 doubles a row."""
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in aligned.select(*keys).schema] + ["target int", "weights array<double>", "objective double", "duality_gap double"])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        x, m = np.stack(pdf["x"].to_list()), pdf["m"].to_numpy(np.float64)
        order = np.lexsort(x.T)
        x, m = x[order], m[order]
        rows = []
        for t in range(n_models):
            peers = [i for i in range(n_models) if i != t]
            w, gap = solvers.simplex_l1(x[:, peers], x[:, t], m)
            rows.append([*pdf[keys].iloc[0], t, w.tolist(), float(m @ np.abs(x[:, t] - x[:, peers] @ w) / m.sum()), gap])
        return pd.DataFrame(rows, columns=[*keys, "target", "weights", "objective", "duality_gap"])

    return aligned.groupBy(*keys, "x").agg(F.count("*").alias("m")).groupBy(*keys).applyInPandas(solve, schema)


def evaluate(rows: DataFrame, fits: DataFrame, keys: list[str]) -> DataFrame:
    """Held-out mean |residual| of fits with peers and weights; the fits are few (targets by keys) and are joined on the keys."""
    guess = F.aggregate(F.zip_with("weights", "peers", lambda w, p: w * F.get("x", p)), F.lit(0.0), lambda s, v: s + v)
    return rows.join(fits, keys).groupBy(*keys, "target", "peers").agg(F.avg(F.abs(F.get("x", F.col("target")) - guess)).alias("mix_error"), F.first("weights").alias("weights"), F.first("objective").alias("objective"), F.first("kkt_gap").alias("kkt_gap"))
