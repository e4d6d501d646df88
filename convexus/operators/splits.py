"""Deterministic splits and samples by hash order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import stable_key


def hash_order(seed, category: str, key: str):
    return stable_key(seed, F.col(category), F.col(key).cast("string"))


def half_split(questions: DataFrame, seeds: list[int], category: str = "category", key: str = "question", strict: bool = False) -> DataFrame:
    """split_seed, category, key, side: per category the first half in hash order fits, the rest evaluates.

    An odd category gives its middle question to the evaluation; with ``strict`` it raises. Questions are distinct first.
    """
    rows = questions.select(category, key).distinct().crossJoin(F.broadcast(questions.sparkSession.createDataFrame([(s,) for s in seeds], "split_seed long")))
    w = Window.partitionBy("split_seed", category)
    n = F.count("*").over(w)
    place = F.row_number().over(w.orderBy(hash_order(F.col("split_seed").cast("string"), category, key), key))
    if strict:
        n = F.when(n % 2 == 0, n).otherwise(F.raise_error(F.lit("a category has an odd number of questions")))
    return rows.withColumn("side", F.when(place <= F.floor(n / 2), "fit").otherwise("eval")).select("split_seed", category, key, "side")


def stratified_sample(rows: DataFrame, per_category: int, seed: int, category: str, key: str) -> DataFrame:
    """The first rows of each category in hash order."""
    w = Window.partitionBy(category).orderBy(hash_order(str(seed), category, key), key)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_category)


def horizon_split(rows: DataFrame, entity: list[str], order: list[str], horizon: int, fit: float = 0.6, tune: float = 0.8) -> DataFrame:
    """Adds position, length and split: train, validation and test in time order, with ``horizon`` rows dropped (null) before each cut."""
    w = Window.partitionBy(*entity)
    rows = rows.withColumn("position", F.row_number().over(w.orderBy(*order)) - 1).withColumn("n_rows", F.count("*").over(w))
    a, b = F.floor(fit * F.col("n_rows")), F.floor(tune * F.col("n_rows"))
    p = F.col("position")
    return rows.withColumn("split", F.when(p < a - horizon, "train").when((p >= a) & (p < b - horizon), "validation").when(p >= b, "test"))
