"""Sufficient statistics of squared-loss fits: one Gram matrix of all models serves every target and peer set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gram(aligned: DataFrame, keys: list[str], n_models: int, x: str = "x", weight: str | None = None) -> DataFrame:
    """keys, ``g`` (row-major upper triangle of sum of w x_i x_j), ``mass`` and ``n``: plain sums, combined on the map side."""
    w = F.col(weight) if weight else F.lit(1.0)
    sums = [F.sum(w * F.get(x, F.lit(i)) * F.get(x, F.lit(j))) for i in range(n_models) for j in range(i, n_models)]
    return aligned.groupBy(*keys).agg(F.array(*sums).alias("g"), F.sum(w).alias("mass"), F.count("*").alias("n"))
