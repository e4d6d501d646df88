"""Typed readers of tables, lines, manifests and shards; deterministic writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines with a declared schema; a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_tsv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("header", True).option("mode", "FAILFAST").csv(path)


def canonical_json(*columns: str):
    """Compact JSON of some columns, keys in order; null fields are kept."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def table_digest(df: DataFrame, *keys: str) -> DataFrame:
    """(n_rows, digest): SHA-256s of the canonical rows, summed over 32-bit parts, so the order of rows has no effect.

    One partial sum per task: the rows are never gathered to be hashed in sequence.
    """
    line = F.sha2(canonical_json(*df.columns), 256)
    parts = [F.sum(F.conv(F.substring(line, 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)")) for k in range(8)]
    return df.agg(F.count("*").alias("n_rows"), F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256).alias("digest"))


def write_lines(df: DataFrame, path: str, *keys: str) -> None:
    """JSON lines in canonical form, range-partitioned and sorted by keys; the commit protocol makes the write atomic."""
    out = df.select(*keys, canonical_json(*df.columns).alias("value"))
    out.repartitionByRange(*keys).sortWithinPartitions(*keys).select("value").write.mode("overwrite").text(path)


def write_parquet(df: DataFrame, path: str, *partition_by: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Doubles are written in their shortest exact form, so a read gives the same values."""
    df.write.mode("overwrite").option("header", True).csv(path)


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def tree_digest(inventory: DataFrame, root: str) -> DataFrame:
    """One digest over (relative path, sha256) in order of path; one row per file, as a manifest has."""
    name = F.regexp_replace("path", "^.*?" + root.rstrip("/").split("/")[-1] + "/", "")
    line = F.concat_ws(" ", name, "sha256")
    return inventory.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("digest"))


def inventory_diff(before: DataFrame, after: DataFrame, key: str, *values: str) -> DataFrame:
    """Rows by key that differ: status added, removed or changed."""
    b, a = before.select(key, F.struct(*values).alias("old")), after.select(key, F.struct(*values).alias("new"))
    both = b.join(a, key, "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return both.select(key, status.alias("status"))


def verified_shards(spark: SparkSession, path: str, schema: T.StructType | str, manifest: DataFrame) -> DataFrame:
    """Union of a folder's Parquet shards whose row counts the manifest (file, rows) confirms; a mismatch raises when the result is read."""
    rows = spark.read.schema(schema).parquet(path).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    seen = rows.groupBy("file").agg(F.count("*").alias("seen"))
    bad = manifest.join(seen, "file", "full_outer").where(~F.col("rows").eqNullSafe(F.col("seen")))
    gate = bad.agg(F.count("*").alias("bad")).select(F.assert_true(F.col("bad") == 0, "shards differ from the manifest").alias("ok"))
    return rows.crossJoin(F.broadcast(gate)).where("ok IS NULL").drop("ok")  # one row
