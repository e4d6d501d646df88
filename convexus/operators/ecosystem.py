"""Responses of models to questions under doses, their alignment and masses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import staged
from ..sources.tables import table

MODELS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
KEYS = ["question", "dose"]


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with model (region of the supplier), question (brand), category, dose (year of shipping less 1995) and track."""
    item = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_discount", "l_quantity", "l_linenumber", "l_shipdate")
    nation = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")  # 25 and 5 rows
    supplier = table(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "r_name")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    rows = item.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select(
        F.col("r_name").alias("model"),
        F.col("p_brand").alias("question"),
        F.substring("p_brand", 1, 7).alias("category"),
        (F.year("l_shipdate") - 1995).alias("dose"),
        (F.col("l_linenumber") % 3).alias("track"),
        F.col("l_discount").alias("value"),
        F.col("l_quantity").alias("mass"),
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model, question, category, dose, track, total, n: the sums of which every response is made, staged, so that a query scans the line items once."""
    sums = lambda: lines(spark, sf_dir).groupBy("model", "question", "category", "dose", "track").agg(F.sum("value").alias("total"), F.count("value").alias("n"))
    return staged(spark, ("cells", sf_dir), sums)


def responses(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """model, question, category, dose (and track): the mean response of each cell."""
    return cells(spark, sf_dir).groupBy("model", "question", "category", "dose", *extra).agg(F.try_divide(F.sum("total"), F.sum("n")).alias("response"))


def align(frame: DataFrame, roster: list[str], keys: list[str], value: str = "response", model: str = "model") -> DataFrame:
    """One row per key with the responses of the roster in order (``x``); keys that lack a model or have one twice are left out.

    One aggregation instead of a join per model."""
    cells = [F.max(F.when(F.col(model) == m, F.col(value))) for m in roster]
    counts = [F.sum(F.when(F.col(model) == m, 1).otherwise(0)) for m in roster]
    wide = frame.where(F.col(model).isin(roster)).groupBy(*keys).agg(F.array(*cells).alias("x"), F.array(*counts).alias("_n"))
    return wide.where(F.forall("_n", lambda n: n == 1) & F.forall("x", lambda v: v.isNotNull())).drop("_n")


def row_weights(dose: Column, tracks: int = 3) -> Column:
    """Every question weighs the same at each dose: 1 where clean (dose 0), else shared by the tracks."""
    return F.when(dose == 0, F.lit(1.0)).otherwise(1.0 / tracks)
