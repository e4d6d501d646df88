"""Joins that refuse repeated keys, and gates that raise when a table is not what it should be."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    """``df``, of which a key that comes twice raises when the rows are read; null keys are keys. One aggregation, no second reading."""
    rest = [c for c in df.columns if c not in keys]
    held = df.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in rest])
    checked = F.when(F.col("_n") == 1, F.lit(True)).otherwise(F.raise_error(F.lit(f"{what}: a key is repeated")).cast("boolean"))
    return held.where(checked).select(*df.columns)


def merge(left: DataFrame, right: DataFrame, on: list[str], validate: str, how: str = "inner") -> DataFrame:
    """A join that raises where a side that must be unique (``1:1``, ``1:m``, ``m:1``) repeats a key."""
    if validate not in ("1:1", "1:m", "m:1"):
        raise ValueError(validate)
    if validate[0] == "1":
        left = once(left, on, "left")
    if validate[-1] == "1":
        right = once(right, on, "right")
    return left.join(right, on, how)


def require(df: DataFrame, condition, message: str) -> DataFrame:
    """``df``; a row that fails the condition (null fails) raises when it is read."""
    return df.where(F.when(F.coalesce(condition, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def grid_gaps(seen: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n: cells of the expected grid that are missing (0) or repeated (2 and more), and cells outside it (-n)."""
    n = seen.groupBy(*keys).agg(F.count("*").alias("_n"))
    both = expected.select(*keys).distinct().withColumn("_e", F.lit(1)).join(n, keys, "full_outer")
    count = F.coalesce(F.col("_n"), F.lit(0))
    return both.select(*keys, F.when(F.col("_e").isNull(), -count).otherwise(count).alias("n")).where("n <> 1")
