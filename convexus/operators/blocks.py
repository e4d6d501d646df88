"""Products of rows that share a common key, in blocks of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a key and side that meet in one cell, about.
SIZE = 256


def block_join(left: DataFrame, right: DataFrame, on: list[str], left_id: str, right_id: str, n: str = "n_rows") -> DataFrame:
    """Every pair of rows with equal ``on``, as an inner join gives it, with each key's product dealt into cells.

    ``n`` (in both, the same for a key) says how many rows a key has. A key of up to SIZE rows has one cell; a larger
    one has its rows dealt by hash of their id, so that no cell grows with the key.
    """
    parts = F.greatest(F.ceil(F.col(n) / SIZE), F.lit(1)).cast("long")
    every = F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))
    l = left.withColumn("_p", F.pmod(F.xxhash64(left_id), parts)).withColumn("_q", every).drop(n)
    r = right.withColumn("_q", F.pmod(F.xxhash64(right_id), parts)).withColumn("_p", every).drop(n)
    return l.join(r, [*on, "_p", "_q"]).drop("_p", "_q")
