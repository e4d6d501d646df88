"""Queries that fit in numpy: compared with plain versions in the tests."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import ecosystem, fit, solvers
from ..operators.pairs import aligned_splits
from ..registry import query
from .vector_queries import logits


@query("residual_full")
def residual_full(spark, sf_dir):
    """Every target on its four peers: fit, held-out error, weights and the proof of optimality."""
    rows = aligned_splits(spark, sf_dir)
    fits = fit.mse_fits(rows.where("side = 'fit'"), ["split_seed"], 5)
    return fit.evaluate(rows.where("side = 'eval'"), fits, ["split_seed"])


@query("subset_fits")
def subset_fits(spark, sf_dir):
    """Every target on every non-empty set of its peers, from one Gram matrix for each split."""
    rows = aligned_splits(spark, sf_dir)
    return fit.evaluate(rows.where("side = 'eval'"), fit.mse_fits(rows.where("side = 'fit'"), ["split_seed"], 5, subsets=True), ["split_seed"])


@query("peer_removal_full")
def peer_removal_full(spark, sf_dir):
    """What removing one of four peers adds to the held-out error, with ranks."""
    f = subset_fits(spark, sf_dir)
    whole = f.where(F.size("peers") == 4).select("split_seed", "target", F.col("mix_error").alias("all_peers"))
    less = f.where(F.size("peers") == 3).withColumn("removed", F.element_at(F.array_except(F.array_except(F.sequence(F.lit(0), F.lit(4)), "peers"), F.array("target")), 1))
    j = less.join(whole, ["split_seed", "target"]).select("split_seed", "target", "removed", (F.col("mix_error") - F.col("all_peers")).alias("inflation"))
    return j.withColumn("place", F.rank().over(Window.partitionBy("split_seed", "target").orderBy(F.desc(F.round("inflation", 12)))))


@query("mae_full")
def mae_full(spark, sf_dir):
    return fit.mae_fits(aligned_splits(spark, sf_dir).where("side = 'fit'"), ["split_seed"], 5)


@query("weight_intervals")
def weight_intervals(spark, sf_dir):
    """How far each peer's weight can move while the loss stays within 1% of the best."""
    from ..operators.gram import gram

    sums = gram(aligned_splits(spark, sf_dir).where("side = 'fit'"), ["split_seed"], 5)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in pdf.iterrows():
            g = solvers.full(row["g"], 5) / row["mass"]
            for t in range(5):
                p = [i for i in range(5) if i != t]
                gg, c = g[np.ix_(p, p)], g[p, t]
                w, _ = solvers.simplex_qp(gg, c)
                slack = 0.01 * max(0.0, g[t, t] - 2 * c @ w + w @ gg @ w)
                for k, peer in enumerate(p):
                    low, high = solvers.weight_interval(gg, c, w, k, slack)
                    out.append((row["split_seed"], t, peer, w[k], low, high))
        return pd.DataFrame(out, columns=["split_seed", "target", "peer", "weight", "low", "high"])

    return sums.groupBy("split_seed").applyInPandas(solve, "split_seed long, target int, peer int, weight double, low double, high double")


@query("temperature_fit")
def temperature_fit(spark, sf_dir):
    """The temperature of each hundred of ids that fits the gold options best: golden section over log T on a group's few rows."""
    rows = logits(spark, sf_dir).select(F.floor(F.col("vec_id") / 100).alias("grp"), "z", (F.col("label") % 64).alias("gold"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        z, gold = np.stack(pdf["z"].to_list()), pdf["gold"].to_numpy()

        def loss(log_t: float) -> float:
            s = z / np.exp(log_t)
            s = s - s.max(1, keepdims=True)
            return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(s)), gold]).mean())

        t = solvers.golden_section(loss, np.log(0.05), np.log(20))
        return pd.DataFrame({"grp": [pdf["grp"].iloc[0]], "temperature": [float(np.exp(t))], "nll": [loss(t)], "nll_raw": [loss(0.0)], "n": [len(pdf)]})

    return rows.where("gold IS NOT NULL").groupBy("grp").applyInPandas(solve, "grp long, temperature double, nll double, nll_raw double, n long")


@query("label_bias_fit", "WITH " + """z AS (SELECT label, list_transform(embedding, lambda x: x::DOUBLE) AS z FROM embeddings WHERE embedding IS NOT NULL),
u AS (SELECT label, i, z[i] AS v FROM z, range(1, 65) q(i)), c AS (SELECT label, i, avg(v) AS m FROM u GROUP BY ALL), a AS (SELECT label, avg(m) AS m FROM c GROUP BY label)
SELECT label, (i - 1)::INTEGER AS place, round(c.m - a.m, 9) AS bias FROM c JOIN a USING (label)""")  # fmt: skip
def label_bias_fit(spark, sf_dir):
    """Additive position effects of each label that sum to zero: in a balanced design the least-squares fit is the centred means."""
    cells = logits(spark, sf_dir).groupBy("label").agg(F.array(*[F.avg(F.get("z", F.lit(i))) for i in range(64)]).alias("m"))
    bias = F.transform("m", lambda x: x - vectors.total(F.col("m")) / 64)
    return cells.select("label", F.posexplode(bias).alias("place", "bias")).select("label", "place", F.round("bias", 9).alias("bias"))


@query("pca_hull_geometry")
def pca_hull_geometry(spark, sf_dir):
    """The models in the plane of their two principal axes, their hull and spread: an eigenproblem of the models' 5 x 5 Gram matrix."""
    from ..operators.gram import gram

    wide = ecosystem.align(ecosystem.responses(spark, sf_dir), ecosystem.MODELS, ["question", "dose"]).withColumn("k", F.lit(0))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        g = solvers.full(pdf["g"].iloc[0], 5)
        centre = np.eye(5) - 1 / 5
        values, axes = np.linalg.eigh(centre @ g @ centre)
        order = np.argsort(-values)[:2]
        at = axes[:, order] * np.sqrt(np.maximum(values[order], 0))
        at *= np.sign(at[np.abs(at).argmax(0), [0, 1]])
        hull: list[int] = []
        for turn in (sorted(range(5), key=lambda i: tuple(at[i])), sorted(range(5), key=lambda i: tuple(at[i]), reverse=True)):
            part: list[int] = []
            for i in turn:
                while len(part) > 1 and np.cross(np.r_[at[part[-1]] - at[part[-2]], 0], np.r_[at[i] - at[part[-2]], 0])[2] <= 0:
                    part.pop()
                part.append(i)
            hull += part[:-1]
        return pd.DataFrame({"model": ecosystem.MODELS, "x": at[:, 0], "y": at[:, 1], "on_hull": [i in hull for i in range(5)], "explained": [float(values[order].sum() / max(values.sum(), 1e-300))] * 5})

    return gram(wide, ["k"], 5).groupBy("k").applyInPandas(solve, "model string, x double, y double, on_hull boolean, explained double")
