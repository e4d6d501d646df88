"""Helpers that the training-data operators share: scratch tables, blocks of texts, workers' memory, quantiles and connected components."""

from __future__ import annotations

import ctypes
import mmap
import tempfile
import uuid
from collections.abc import Callable, Iterable
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes and rows of one batch on its way to a Python worker, at most (a longer row is a batch of its own).
BATCH_BYTES, BATCH_ROWS = 4 << 20, 4096
#: Memory that a worker may hold between two blocks.
WORKER_BYTES = 224 << 20
#: Bytes of text in a bucket of blocks, about.
BUCKET_BYTES = 128 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; one of its own where that is unset and the session is local (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="convexus-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def file_system(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


class Scratch:
    """Tables written to the shared folder, each in a folder of its own.

    Writing cuts the lineage: what was read back survives any executor, and a second reading
    sees the same rows in the same files. What is not dropped before goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        files, root = file_system(spark, self.root)
        files.mkdirs(root)
        files.deleteOnExit(root)

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def save(self, df: DataFrame, table: str) -> DataFrame:
        with small_batches(self.spark):
            df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(table))
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def drop(self, *tables: str) -> None:
        for table in tables:
            files, path = file_system(self.spark, self.path(table))
            files.delete(path, True)


@contextmanager
def small_batches(spark: SparkSession):
    """Within, batches for Python workers are bounded by bytes, so that long texts do not add up to the memory of an executor."""
    ours = {"spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES), "spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS)}
    before = {k: spark.conf.get(k, None) for k in ours}
    for k, v in ours.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def free_name(columns: Iterable[str], wish: str) -> str:
    """``wish``, with underscores before it until no column is called so (case aside)."""
    taken = {c.lower() for c in columns}
    while wish.lower() in taken:
        wish = "_" + wish
    return wish


def give_back(most: int = 0) -> None:
    """Returns freed memory of this worker to the system, if it holds more than ``most`` bytes: memory that is used again at once had better stay.

    Nothing here makes cycles, so there is no garbage to look for, which would take longer than many a task.
    """
    if most:
        try:
            with open("/proc/self/statm") as file:
                if int(file.read().split()[1]) * mmap.PAGESIZE < most:
                    return
        except OSError:  # no such file outside Linux
            return
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc keeps it otherwise
    if trim:
        trim(0)


def tidy(run: Callable, *forget: Callable[[], None]) -> Callable:
    """``run`` (batches to batches), after which the worker lets go of all that it held: workers are reused and idle ones would keep it."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            for f in forget:
                f()
            give_back()

    return wrapped


def partitions(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


class Blocks:
    """A table dealt into blocks of about ``size`` bytes of text, written once and bucketed by block.

    Cogrouping answers with a block moves the answers only. Columns: ``block``, ``row`` (unique) and those of the table.
    """

    def __init__(self, docs: DataFrame, text: str, scratch: Scratch, size: int):
        spark = docs.sparkSession
        self.block, self.row = free_name(docs.columns, "_block"), free_name(docs.columns, "_row")
        self.bytes = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`").cast("string")))).first()[0] or 0
        parts = -(-self.bytes // (size * max(1, docs.rdd.getNumPartitions()))) or 1
        place = F.monotonically_increasing_id()
        block = F.spark_partition_id().cast("long") * parts + F.pmod(F.xxhash64(place), F.lit(parts))
        own = docs.select(block.alias(self.block), place.alias(self.row), *[F.col(f"`{c}`") for c in docs.columns])
        self.name, self.scratch, self.spark = f"convexus_blocks_{uuid.uuid4().hex}", scratch, spark
        # A task writes to no more buckets than it has blocks, and a bucket stays bounded however large the table.
        buckets = min(100_000, max(partitions(spark), -(-self.bytes // BUCKET_BYTES)))
        own.write.bucketBy(buckets, self.block).option("path", scratch.path("blocks")).option("compression", "zstd").saveAsTable(self.name)
        self.table = spark.table(self.name)

    def _columns(self, columns: list[str]) -> DataFrame:
        return self.table.select(self.block, self.row, *[F.col(f"`{c}`") for c in columns])

    def each(self, columns: list[str], run: Callable, schema: str) -> DataFrame:
        """``run`` (the number of a block, its rows) to rows."""
        block = self.block

        def numbered(part: pa.Table) -> pa.Table:
            try:
                return run(part.column(block)[0].as_py(), part)
            finally:
                give_back(WORKER_BYTES)

        return self._columns(columns).groupBy(self.block).applyInArrow(numbered, schema)

    def cogroup(self, columns: list[str], answers: DataFrame, run: Callable, schema: str) -> DataFrame:
        """``run`` (the block's rows, its answers) to rows; ``answers`` has a column ``block``."""

        def held(left: pa.Table, right: pa.Table) -> pa.Table:
            try:
                return run(left, right)
            finally:
                give_back(WORKER_BYTES)

        return self._columns(columns).groupBy(self.block).cogroup(answers.groupBy("block")).applyInArrow(held, schema)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        self.scratch.drop("blocks")


def quantiles(rows: DataFrame, scratch: Scratch, quantile: float, group: str = "lang", value: str = "value") -> DataFrame:
    """(group, n, value): the smallest value with at least ``quantile`` of the group's values at or below it, exactly.

    Values are longs from 0 to 2^48 - 1; null has no place. ``rows`` is read three times: 16 bits of the answer are found each
    time from counts (at most 65,536 for a group), so a group's values never meet in one task. Groups must be few.
    """
    rows = rows.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).alias("v"))
    found = rows.groupBy("g").agg(F.count("*").alias("n")).select("g", "n", F.greatest(F.ceil(F.col("n") * quantile), F.lit(1)).cast("long").alias("rank"), F.lit(0).cast("long").alias("head"))
    found = scratch.save(found, "quantiles48")
    for shift in (32, 16, 0):
        live = rows.join(F.broadcast(found.select("g", "head")), "g").where(F.shiftright("v", shift + 16) == F.col("head"))
        bins = live.groupBy("g", F.shiftright("v", shift).alias("bin")).agg(F.count("*").alias("c"))
        upto = F.sum("c").over(Window.partitionBy("g").orderBy("bin"))
        first = bins.withColumn("upto", upto).join(F.broadcast(found.select("g", "rank")), "g").where("upto >= rank")
        first = first.groupBy("g").agg(F.min(F.struct("bin", (F.col("upto") - F.col("c")).alias("before"))).alias("x"))
        found = scratch.save(found.join(F.broadcast(first), "g").select("g", "n", (F.col("rank") - F.col("x.before")).alias("rank"), F.col("x.bin").alias("head")), f"quantiles{shift}")
    return found.select(F.col("g").alias(group), "n", F.col("head").alias(value))


def connected_components(edges: DataFrame, scratch: Scratch, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component): the smallest node that links reach, for every node that has an edge.

    Alternates large-star and small-star steps until every edge leads from a node with no other edge to a root.
    Each step takes minima by partial aggregation and joins them back by plain inner joins, of which adaptive execution splits
    the partition of a hub (one side repeats there, the hub's single row); every step is a written table. Self-loops
    are ignored; no edges give no rows.
    """
    edge = scratch.save(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u > v").distinct(), "cc0")
    pair = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    step = 0
    while True:
        ends = edge.select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.lit(1).alias("up")), F.struct(F.col("v").alias("a"), F.lit(0).alias("up")))).alias("e")).select("e.*")
        kinds = ends.groupBy("a").agg(F.sum("up").alias("ups"), F.min("up").alias("low"))
        if not kinds.agg(F.max((F.col("ups") > 1) | ((F.col("ups") > 0) & (F.col("low") == 0)))).first()[0]:
            break
        # Large star: every larger neighbour of a node goes to the least of its neighbourhood (itself included).
        least = edge.select(F.explode(F.array(pair("u", "v"), pair("v", "v"))).alias("e")).groupBy(F.col("e.a").alias("v")).agg(F.min("e.b").alias("m"))
        large = edge.join(least, "v").select("u", F.col("m").alias("v"))
        # Small star: a node and its smaller neighbours go to the least of these.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(pair("u", "m"), pair("v", "m"))).alias("e"))
        new = scratch.save(small.select(F.col("e.a").alias("u"), F.col("e.b").alias("v")).where("u > v").distinct(), f"cc{step + 1}")
        scratch.drop(f"cc{step}")
        edge, step = new, step + 1
    return edge.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edge.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
