"""Windowed sums over event streams; coverage statistics are plain sums, so batches add up."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import staging


def shared_folder(spark: SparkSession) -> str:
    """A folder of its own in the one that driver and executors share, without which a stream can't resume."""
    found = staging.shared_folder(spark)
    if found is None:
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{found}/stream-{uuid.uuid4().hex}"


def window_moments(events: DataFrame, keys: list[str], time: str, value: str, width: str = "1 day", late: str = "30 days") -> DataFrame:
    """keys, window_start, n, s1, s2: count, sum and sum of squares of each tumbling window; rows later than ``late`` are dropped from a stream, whose state so stays bounded."""
    rows = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if events.isStreaming else events
    out = rows.groupBy(*keys, F.window(time, width).alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("s1"), F.sum(F.col(value) * F.col(value)).alias("s2"))
    return out.select(*keys, F.col("w.start").alias("window_start"), "n", "s1", "s2")


def run_to_end(stream: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """Runs a stream over all that is there now and returns the last state of each key.

    Every batch writes its changed rows to a folder of its own number, so a batch that is run again after a failure
    replaces itself; the checkpoint resumes where the last committed batch ended.
    """
    spark = stream.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    values = [c for c in stream.columns if c not in keys]
    rows = spark.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out/batch=*")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, *[F.col(f"v.{c}").alias(c) for c in values])


def stream_parquet(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """A stream of the files of a folder with a given name."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", 1).parquet(folder)
