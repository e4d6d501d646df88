"""Sharding by fixed virtual slots and a versioned slot-to-shard map."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, file_system, shared_dir

SLOTS = 4096


def slot_of(key, n_slots: int = SLOTS):
    """A record's virtual slot; it never changes, whatever the number of shards."""
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit(""))), F.lit(n_slots)).cast("int")


def even_map(n_slots: int, n_shards: int) -> np.ndarray:
    """Version 0: slots dealt in turn."""
    return np.arange(n_slots) % n_shards


def loads(shard: np.ndarray, weight: np.ndarray, n_shards: int) -> np.ndarray:
    """Bytes of each shard."""
    out = np.zeros(n_shards, np.int64)
    np.add.at(out, shard, weight.astype(np.int64))
    return out


def rebalance(shard: np.ndarray, weight: np.ndarray, n_shards: int) -> np.ndarray:
    """The next version of a map: single slots are moved from the heaviest to the lightest shard while that evens them.

    Every edit moves the slot nearest to half the gap, so most slots stay where they are.
    """
    shard, weight = shard.copy(), weight.astype(np.int64)
    load = loads(shard, weight, n_shards)
    for _ in range(8 * len(shard)):
        light = int(load.argmin())
        for heavy in np.argsort(-load, kind="stable"):
            gap = int(load[heavy] - load[light])
            own = np.flatnonzero((shard == heavy) & (weight > 0) & (weight < gap))
            if len(own):
                break
        else:
            break
        slot = own[np.abs(2 * weight[own] - gap).argmin()]
        shard[slot] = light
        load[heavy] -= weight[slot]
        load[light] += weight[slot]
    return shard


def grow(shard: np.ndarray, weight: np.ndarray, n_shards: int) -> np.ndarray:
    """The next version of a map with more shards: slots move into the new, empty ones only, until these hold their share."""
    shard, weight = shard.copy(), weight.astype(np.int64)
    load = loads(shard, weight, n_shards)
    first = int(shard.max(initial=-1)) + 1
    share = int(weight.sum()) // n_shards
    for new in range(first, n_shards):
        while load[new] < share:
            for heavy in np.argsort(-load[:first], kind="stable"):
                # Neither does the new shard exceed its share by more than the old one gives up, nor the old one fall below it.
                own = np.flatnonzero((shard == heavy) & (weight > 0) & (weight <= load[heavy] - load[new] - 1))
                if len(own):
                    break
            else:
                break
            slot = own[np.abs(weight[own] - min(share - load[new], load[heavy] - share)).argmin()]
            if abs(load[new] + weight[slot] - share) >= abs(load[new] - share):
                break
            shard[slot] = new
            load[heavy] -= weight[slot]
            load[new] += weight[slot]
    return shard


class SlotMaps:
    """The versions of one map, tables (vslot, shard) in the shared folder, under a name that later runs find again."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/slot-maps/{name}"

    def versions(self) -> list[int]:
        files, root = file_system(self.spark, self.root)
        if not files.exists(root):
            return []
        names = [s.getPath() for s in files.listStatus(root)]
        done = [p for p in names if files.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName().removeprefix("version=")) for p in done if p.getName().startswith("version="))

    def table(self, version: int) -> DataFrame:
        return self.spark.read.schema("vslot int, shard int").parquet(f"{self.root}/version={version}")

    def load(self, version: int | None = None) -> tuple[int, np.ndarray]:
        """A version (the last one, unless named) and its shards by slot; a map has a few thousand rows."""
        known = self.versions()
        version = max(known, default=None) if version is None else version
        if version not in known:
            raise KeyError(f"no version {version} of {self.root}")
        rows = sorted((r["vslot"], r["shard"]) for r in self.table(version).collect())
        return version, np.array([s for _, s in rows], np.int64)

    def save(self, shard: np.ndarray) -> int:
        """Stores the next version beside the earlier ones, and says which it is. A version is never written twice."""
        version = max(self.versions(), default=-1) + 1
        rows = [(i, int(s)) for i, s in enumerate(shard)]
        self.spark.createDataFrame(rows, "vslot int, shard int").coalesce(1).write.mode("errorifexists").parquet(f"{self.root}/version={version}")
        return version

    def drop(self) -> None:
        files, root = file_system(self.spark, self.root)
        files.delete(root, True)


def slot_bytes(records: DataFrame, n_slots: int) -> np.ndarray:
    """Bytes of each slot of a table with vslot and size. At most ``n_slots`` sums reach the driver, whatever the input."""
    out = np.zeros(n_slots, np.int64)
    for row in records.groupBy("vslot").agg(F.sum("size").alias("n")).collect():
        out[row["vslot"]] = row["n"]
    return out


def shard_records(docs: DataFrame, n_shards: int = 16, key: str = "doc_id", text: str = "text", n_slots: int = SLOTS, name: str | None = None) -> DataFrame:
    """doc key, size, text_crc32, law, shard, slot, grown_shard, then virtual_slot and map_version.

    Records are hashed by key into ``n_slots`` virtual slots. The map of slots to shards is the last stored version of
    ``name`` (a name of its own without one; version 0: dealt in turn), edited by the slots' bytes, so that
    the shards' bytes are near equal (law ``bytes``), and stored as the next version if that moves any slot. A slot with more
    than an eighth of a shard's share (a key that many rows have) is dealt on into as many further slots as it takes, by the
    record's place in the written table. ``slot`` is the record's place in its shard: the places of a virtual slot
    follow those of the ones before it. Null text is empty (size 1, crc 0); a null key hashes as an empty one; repeated
    rows each get a place; an empty table gives no rows; other columns are left out, whatever their names.
    """
    spark = docs.sparkSession
    scratch, maps = Scratch(spark, "shards"), SlotMaps(spark, name or f"run-{uuid.uuid4().hex}")
    words = F.coalesce(F.col(text), F.lit(""))
    rows = scratch.save(docs.select(
        F.col(key).alias("key"),
        (F.octet_length(words) + 1).cast("long").alias("size"),
        F.crc32(words.cast("binary")).cast("long").alias("text_crc32"),
        slot_of(F.col(key), n_slots).alias("vslot"),
        F.monotonically_increasing_id().alias("place"),
    ), "rows")
    weight = slot_bytes(rows, n_slots)
    limit = max(1, int(weight.sum()) // (8 * n_shards))
    pieces = np.maximum(1, -(-weight // limit))
    total = int(pieces.sum())  # n_slots + 8 * n_shards at most
    if total > n_slots:
        begin = n_slots + np.cumsum(pieces - 1) - (pieces - 1)
        hot = [(int(s), int(pieces[s]), int(begin[s])) for s in np.flatnonzero(pieces > 1)]
        rows = rows.join(F.broadcast(spark.createDataFrame(hot, "vslot int, pieces int, begin int")), "vslot", "left")
        turn = F.pmod(F.xxhash64("place"), F.col("pieces")).cast("int")
        rows = rows.withColumn("vslot", F.when(turn > 0, F.col("begin") + turn - 1).otherwise(F.col("vslot"))).drop("pieces", "begin")
        weight = slot_bytes(rows, total)
    known = maps.versions()
    if not known:
        maps.save(even_map(total, n_shards))
    version, before = maps.load()
    if len(before) < total:  # slots that are new go on being dealt in turn
        before = np.r_[before, np.arange(len(before), total) % n_shards]
    weight = np.r_[weight, np.zeros(len(before) - total, np.int64)]
    after = rebalance(before, weight, n_shards)
    if not known or (len(after) != len(maps.load(version)[1]) or (after != maps.load(version)[1]).any()):
        version = maps.save(after)
    # Where each virtual slot begins in its shard; both tables have a row for each slot at most.
    counts = maps.table(version).join(F.broadcast(rows.groupBy("vslot").agg(F.count("*").alias("n"))), "vslot", "left").fillna(0, ["n"])
    start = F.sum("n").over(Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1))
    places = counts.withColumn("start", F.coalesce(start, F.lit(0))).select("vslot", "shard", "start")
    place = F.row_number().over(Window.partitionBy("vslot").orderBy("key", "text_crc32", "size", "place"))
    out = rows.withColumn("rank", place).join(F.broadcast(places), "vslot").select(
        F.col("key").alias(key),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("start") + F.col("rank") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("vslot").alias("virtual_slot"),
        F.lit(version).alias("map_version"),
    )
    out = scratch.save(out, "out")
    scratch.drop("rows")
    if name is None:
        maps.drop()
    return out


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_records(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
