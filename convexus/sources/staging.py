"""The shared folder, and tables that one query writes once and reads as often as it needs them."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_SCOPE: contextvars.ContextVar[dict | None] = contextvars.ContextVar("staged tables of the query at work", default=None)


def shared_folder(spark: SparkSession) -> str | None:
    """spark.checkpoint.dir; where that is unset, a temporary folder in a local session (tests) and None on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and spark.sparkContext.master.startswith("local["):
        found = tempfile.mkdtemp(prefix="convexus-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/") if found else None


@contextlib.contextmanager
def scope():
    """A query: what it stages is written once; scopes within scopes are the outer one's."""
    if _SCOPE.get() is not None:
        yield
        return
    token = _SCOPE.set({})
    try:
        yield
    finally:
        _SCOPE.reset(token)


def staged(spark: SparkSession, key: tuple, make: Callable[[], DataFrame]) -> DataFrame:
    """``make()``, within a query written to the shared folder at its first use; outside, or without such a folder, the plan itself.

    Written rows are the same at every reading and survive any executor; the files go when the driver ends.
    """
    held = _SCOPE.get()
    if held is None or (folder := shared_folder(spark)) is None:
        return make()
    if key not in held:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/staged-{uuid.uuid4().hex}")
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        df = make()
        df.write.mode("overwrite").parquet(path.toString())
        held[key] = spark.read.schema(df.schema).parquet(path.toString())
    return held[key]
