"""Stratified cluster bootstrap by hash-indexed draws, so that any engine can replay it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import draw


def multiplicities(questions: DataFrame, n_replicates: int, seed: int, category: str = "category", key: str = "question") -> DataFrame:
    """replicate, category, key, m: how often each question is drawn when each category is drawn from itself with replacement; zeros stay."""
    w = Window.partitionBy(category)
    ids = questions.select(category, key).distinct().withColumn("i", F.row_number().over(w.orderBy(key)) - 1).withColumn("n", F.count("*").over(w).cast("int"))
    slots = ids.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_replicates - 1))).alias("replicate"))
    drawn = slots.select("replicate", category, draw(F.col("n"), str(seed), F.col("replicate").cast("string"), F.col(category), F.col("i").cast("string")).alias("i"))
    counts = drawn.groupBy("replicate", category, "i").agg(F.count("*").alias("m"))
    return slots.join(counts, ["replicate", category, "i"], "left").select("replicate", category, key, F.coalesce("m", F.lit(0)).alias("m"))


def weighted_means(losses: DataFrame, counts: DataFrame, keys: list[str], value: str, question: str = "question") -> DataFrame:
    """Per replicate and key the mean of ``value`` with multiplicities as weights; rows are weighted, not repeated. No mass raises."""
    j = losses.join(counts.select("replicate", question, "m"), question)
    total = F.sum("m")
    mean = F.when(total > 0, F.sum(F.col("m") * F.col(value)) / total).otherwise(F.raise_error(F.lit("a bootstrap replicate has no mass")))
    return j.groupBy("replicate", *keys).agg(mean.alias(value))


def summary(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, median, 95% percentile interval and sign shares over replicates."""
    return values.groupBy(*keys).agg(
        F.avg(value).alias("mean"),
        F.percentile(value, F.lit(0.5)).alias("median"),
        F.percentile(value, F.lit(0.025)).alias("low"),
        F.percentile(value, F.lit(0.975)).alias("high"),
        F.avg((F.col(value) > 0).cast("double")).alias("p_positive"),
        F.avg((F.col(value) < 0).cast("double")).alias("p_negative"),
        F.count("*").alias("n_replicates"),
    )
