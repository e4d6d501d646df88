"""Shards of Parquet files that carry their counts and digests, and are checked before they are used."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import canonical_json, table_digest

MARK = "shard_rows bigint, shard_digest string, shard_version string"


def _files(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def write_shard(df: DataFrame, path: str, version: str) -> None:
    """Writes a shard, reads it back, and only then its mark (rows, digest, version); one that reads otherwise is moved aside and raises.

    Rows have no order, so the digest is a sum over rows: one partial sum for each task.
    """
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}/rows")
    wrote, read = table_digest(df).first(), table_digest(spark.read.schema(df.schema).parquet(f"{path}/rows")).first()
    if wrote != read:
        files, here = _files(spark, path)
        files.rename(here, _files(spark, f"{path}.quarantine")[1])
        raise ValueError(f"{path} does not read as it was written")
    spark.createDataFrame([(read["n_rows"], read["digest"], version)], MARK).coalesce(1).write.mode("overwrite").parquet(f"{path}/mark")


def shard_state(spark: SparkSession, path: str, schema, version: str) -> str:
    """``absent``, ``unmarked``, ``version``, ``rows``, ``digest`` (what differs) or ``valid``."""
    files, here = _files(spark, path)
    if not files.exists(here):
        return "absent"
    if not files.exists(_files(spark, f"{path}/mark/_SUCCESS")[1]):
        return "unmarked"
    mark = spark.read.schema(MARK).parquet(f"{path}/mark").first()
    if mark["shard_version"] != version:
        return "version"
    found = table_digest(spark.read.schema(schema).parquet(f"{path}/rows")).first()
    return "rows" if found["n_rows"] != mark["shard_rows"] else "digest" if found["digest"] != mark["shard_digest"] else "valid"


def read_shards(spark: SparkSession, paths: list[str], schema, version: str) -> DataFrame:
    """The union of shards that are all valid; any other raises before a row is read."""
    bad = {p: s for p in paths if (s := shard_state(spark, p, schema, version)) != "valid"}
    if bad:
        raise ValueError(f"shards that are not valid: {bad}")
    return spark.read.schema(schema).parquet(*[f"{p}/rows" for p in paths])


def row_digests(df: DataFrame) -> DataFrame:
    """``df`` and the SHA-256 of each row's canonical JSON."""
    return df.withColumn("row_sha256", F.sha2(canonical_json(*df.columns), 256))
