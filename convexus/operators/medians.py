"""Weighted medians on the unit interval, and joins with tables whose size is known."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bits of a median found at a time, and how often: 36 bits, so medians are exact to 1.5e-11.
BITS, LEVELS = 18, 2
#: Tables of at most so many rows are broadcast.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` for a join, broadcast if the number of its rows, which the caller knows, allows it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def weighted_medians(rows: DataFrame, keys: list[str], value: str, mass: str, name: str = "median") -> DataFrame:
    """keys, median: the least value up to which half the key's mass lies; 0 where that is negative, 1 where it is above 1.

    No key's values meet in one task: each level sums masses of 262,146 bins at most for a key, finds the median's bin from their
    running totals, and the next level looks into that bin only.
    """
    rows = rows.select(*keys, F.col(value).alias("_v"), F.col(mass).alias("_m")).where("_v IS NOT NULL AND _m > 0")
    scale = 1 << BITS
    bin_of = lambda level: F.least(F.greatest(F.floor(F.col("_v") * float(scale**level)), F.lit(-1)), F.lit(scale**level)).cast("long")
    found = None
    for level in range(1, LEVELS + 1):
        live = rows if found is None else rows.join(found, keys).where(bin_of(level - 1) == F.col("_head"))
        start = [F.lit(0.0).alias("_before"), F.lit(None).cast("double").alias("_whole")] if found is None else [F.first("_before").alias("_before"), F.first("_whole").alias("_whole")]
        bins = live.groupBy(*keys, bin_of(level).alias("_bin")).agg(F.sum("_m").alias("_m"), *start)
        w = Window.partitionBy(*keys)
        upto = F.sum("_m").over(w.orderBy("_bin")) + F.col("_before")
        whole = F.coalesce("_whole", F.sum("_m").over(w))
        hit = bins.select(*keys, "_bin", upto.alias("_upto"), whole.alias("_whole"), (upto - F.col("_m")).alias("_before")).where("_upto >= _whole / 2")
        found = hit.groupBy(*keys).agg(F.min(F.struct("_bin", "_before", "_whole")).alias("h")).select(*keys, F.col("h._bin").alias("_head"), "h._before", "h._whole")
    last = rows.join(found, keys).where(bin_of(LEVELS) == F.col("_head")).groupBy(*keys).agg(F.min("_v").alias("_v"))
    return last.select(*keys, F.least(F.greatest("_v", F.lit(0.0)), F.lit(1.0)).alias(name))
