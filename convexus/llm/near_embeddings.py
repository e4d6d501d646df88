"""Embedding near-duplicates by cross-polytope hashing with multiprobe buckets."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, connected_components, partitions, tidy


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of the rows (a power of two wide), scaled to keep lengths."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


class CrossPolytope:
    """``tables`` hashes, each of ``parts`` pseudo-random rotations (three rounds of signs and Hadamard) and ``probes`` further buckets.

    A rotation's code is the nearest of the 2d signed axes. Probes replace the nearest axis of some part by
    the second or third nearest, in order of the distance lost. At a cosine of 0.93 in 64 dimensions one
    table misses a pair with a chance of about 0.30, so the nine tables used here miss about 2 in 100,000
    at the threshold itself and fewer above it.
    """

    def __init__(self, dims: int, tables: int = 9, parts: int = 2, probes: int = 3, seed: int = 20240607):
        self.width = max(2, 1 << max(0, dims - 1).bit_length())
        self.tables, self.parts, self.probes = tables, parts, probes
        self.signs = np.random.default_rng([seed, self.width]).choice([-1.0, 1.0], (tables, parts, 3, self.width))

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """[row, table, bucket]: the own bucket first, then the probes."""
        x = np.zeros((len(unit), self.width))
        x[:, : unit.shape[1]] = unit
        combos = list(itertools.product(range(3 if self.width > 2 else 2), repeat=self.parts))
        out = np.empty((len(unit), self.tables, min(self.probes + 1, len(combos))), np.int64)
        for t in range(self.tables):
            axis, lost = [], []
            for p in range(self.parts):
                y = x
                for s in self.signs[t, p]:
                    y = hadamard(y * s)
                a = np.abs(y)
                near = np.argsort(-a, 1, kind="stable")[:, :3]
                far = np.take_along_axis(a, near, 1)
                axis.append(2 * near + (np.take_along_axis(y, near, 1) < 0))
                lost.append((far[:, :1] - far) ** 2)
            code = np.stack([sum(axis[p][:, c[p]] * (2 * self.width) ** p for p in range(self.parts)) for c in combos], 1)
            cost = np.stack([sum(lost[p][:, c[p]] for p in range(self.parts)) for c in combos], 1)
            cost[:, 0] = -1
            best = np.argsort(cost, 1, kind="stable")[:, : out.shape[2]]
            out[:, t] = np.take_along_axis(code, best, 1)
        return out


def pairs_of_runs(cell: np.ndarray):
    """All pairs (i < j) of rows of equal ``cell``; cells are runs."""
    n = len(cell)
    edge = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if n else np.zeros(0, np.int64)
    end = np.repeat(np.r_[edge[1:], n], np.diff(np.r_[edge, n]))
    count = end - np.arange(n) - 1
    left = np.repeat(np.arange(n), count)
    return left, left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count)


def linked_pairs(keys: np.ndarray, kind: np.ndarray, half: np.ndarray, nodes: np.ndarray, unit: np.ndarray, hasher: CrossPolytope, least: float, most: int = 1 << 20):
    """Pairs of rows of one cell with a cosine of at least ``least``, each given by one bucket of all those where the two meet.

    keys[row]: (cell, table, bucket); kind: 0 in the row's own bucket, else a probe; half: 0, or the side (1, 2) in a
    cell of two different chunks of a bucket, of which only pairs across count.
    """
    rows, run = [], np.r_[True, (keys[1:] != keys[:-1]).any(1)] if len(keys) else np.zeros(0, bool)
    cell = np.cumsum(run)
    begin = 0
    while begin < len(keys):  # whole cells, about ``most`` pairs at a time
        ends = np.flatnonzero(np.r_[run[begin + 1 :], True]) + begin + 1
        size = np.diff(np.r_[begin, ends]).astype(np.float64)
        upto = int(ends[max(0, np.searchsorted(np.cumsum(size * (size - 1) / 2), most, "right") - 1)])
        a, b = pairs_of_runs(cell[begin:upto])
        a, b = a + begin, b + begin
        ok = (kind[a] * kind[b] == 0) & (nodes[a] != nodes[b]) & ((half[a] == 0) | (half[a] != half[b]))
        a, b = a[ok], b[ok]
        for s in range(0, len(a), 1 << 17):
            x, y = a[s : s + (1 << 17)], b[s : s + (1 << 17)]
            near = np.einsum("ij,ij->i", unit[x], unit[y]) >= least
            rows.append(np.stack([x[near], y[near]], 1))
        begin = upto
    hit = np.concatenate(rows) if rows else np.zeros((0, 2), np.int64)
    if not len(hit):
        return hit
    used, place = np.unique(hit, return_inverse=True)
    place = place.reshape(hit.shape)
    codes = hasher.codes(unit[used])
    keep = np.zeros(len(hit), bool)
    for s in range(0, len(hit), 1 << 17):
        part = slice(s, s + (1 << 17))
        x, y = codes[place[part, 0]], codes[place[part, 1]]
        # The two meet in a table where one's bucket is among the other's buckets; the first such table and the least such bucket count.
        none = np.iinfo(np.int64).max
        met = np.minimum(np.where((x == y[:, :, :1]).any(2), y[:, :, 0], none), np.where((y == x[:, :, :1]).any(2), x[:, :, 0], none))
        first = (met < none).argmax(1)
        keep[part] = (first == keys[hit[part, 0], 1]) & (met[np.arange(len(first)), first] == keys[hit[part, 0], 2])
    return hit[keep]


def near_duplicates(vectors: DataFrame, least: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label", tables: int = 9, probes: int = 3, chunk: int = 2048) -> DataFrame:
    """One row per vector: key, n_links, component_id, kept.

    Vectors with equal labels and a cosine of at least ``least`` in double precision are linked; n_links counts
    the other vectors linked directly, component_id is the smallest key that links reach. Equal vectors of a
    label are one node with a count, whatever their keys; different vectors of one key are nodes of their own. Nodes meet in
    their cross-polytope buckets; a bucket of more than ``chunk`` entries is split into chunks, and each pair of chunks is
    compared in a task of its own. Entries are keys only; a vector joins those whose bucket has others too. A pair is
    counted in the first bucket where it meets and only counts and star edges leave a task.
    Null labels, null, empty and zero vectors and those with null or non-finite components link with nothing;
    vectors meet only those of their length; however small or large, components are scaled before they are
    squared; repeated rows are vectors of their own; rows of null key are dropped.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "near-embeddings")
    raw = lambda c: F.col(c).cast("array<double>")
    bad = F.exists(raw(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fit = F.coalesce(F.col(label).isNotNull() & F.col(vector).isNotNull() & ~bad & F.exists(raw(vector), lambda x: x != 0), F.lit(False))
    same = F.sha2(F.concat_ws("|", F.col(label).cast("string"), F.array_join(F.col(vector).cast("array<string>"), ",")), 256)
    rows = vectors.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), fit.alias("fit"), F.when(fit, F.col(vector)).alias("x"), F.when(fit, same).alias("same"), F.when(fit, F.col(label).cast("string")).alias("group"))
    rows = scratch.save(rows, "rows")
    distinct = rows.where("fit").groupBy("same").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("x").alias("x"), F.first("group").alias("group"))
    # Nodes are numbered as they are written, once.
    distinct = scratch.save(distinct.select(F.monotonically_increasing_id().alias("node"), "*"), "distinct")
    wide = "float" if "float" in vectors.schema[vector].dataType.simpleString() else "double"
    hashers: dict[int, CrossPolytope] = {}

    def hasher(dims: int) -> CrossPolytope:
        if dims not in hashers:
            hashers[dims] = CrossPolytope(dims, tables, 2, probes)
        return hashers[dims]

    def unit_rows(x: np.ndarray) -> np.ndarray:
        y = x.astype(np.float64)
        y /= np.abs(y).max(1, keepdims=True)  # else a square can leave the range
        return y / np.linalg.norm(y, axis=1, keepdims=True)

    def buckets(batches):
        for batch in batches:
            lengths = batch["x"].map(len).to_numpy()
            for dims in np.unique(lengths):
                same = batch[lengths == dims]
                for start in range(0, len(same), 1024):  # each row makes tables * (probes + 1) entries
                    own = same.iloc[start : start + 1024]
                    codes = hasher(int(dims)).codes(unit_rows(np.array(own["x"].to_list(), np.float64)))
                    n, t, p = codes.shape
                    at = np.repeat(np.arange(n), t * p)
                    yield pd.DataFrame({"group": own["group"].to_numpy()[at], "dims": int(dims), "t": np.tile(np.repeat(np.arange(t), p), n), "bucket": codes.ravel(), "probe": np.tile(np.arange(p) > 0, n * t).astype("int32"), "node": own["node"].to_numpy()[at]})

    where = ["group", "dims", "t", "bucket"]
    entries = scratch.save(distinct.select("node", "group", "x").mapInPandas(tidy(buckets), "group string, dims int, t int, bucket long, probe int, node long"), "entries")
    large = entries.groupBy(*where).agg(F.count("*").alias("n"), F.min("probe").alias("probe")).where("n > 1 and probe = 0").select(*where, F.ceil(F.col("n") / chunk).cast("int").alias("chunks"))
    mine = F.when(F.col("chunks") == 1, F.lit(0)).otherwise(F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    bits = F.transform("x", lambda v: v.cast(wide))
    entries = entries.join(large, where).join(distinct.select("node", "copies", bits.alias("x")), "node")
    entries = entries.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    entries = entries.withColumn("low", F.least("mine", "other")).withColumn("high", F.greatest("mine", "other"))
    entries = entries.withColumn("half", F.when(F.col("low") == F.col("high"), 0).when(F.col("mine") == F.col("low"), 1).otherwise(2))
    cells = entries.select("group", "dims", "t", "bucket", "low", "high", "half", "probe", "node", "copies", "x")
    at = ["group", "dims", "t", "bucket", "low", "high"]

    def compare(batches):
        held = None

        def solve(part: pd.DataFrame):
            dims = int(part["dims"].iloc[0])
            cell = part[at].ne(part[at].shift()).any(axis=1).cumsum().to_numpy()
            keys = np.stack([cell, part["t"].to_numpy(), part["bucket"].to_numpy()], 1)
            nodes, copies = part["node"].to_numpy(), part["copies"].to_numpy()
            unit = unit_rows(np.stack(part["x"].to_list()))
            hit = linked_pairs(keys, part["probe"].to_numpy(), part["half"].to_numpy(), nodes, unit, hasher(dims), least)
            if not len(hit):
                return None
            links = np.bincount(hit[:, 0], copies[hit[:, 1]], len(nodes)) + np.bincount(hit[:, 1], copies[hit[:, 0]], len(nodes))
            order = np.argsort(nodes, kind="stable")
            rank = np.empty(len(nodes), np.int64)
            rank[order] = np.arange(len(nodes))
            root = rank.copy()
            while True:  # the least of each component, as a rank of the node
                new = root.copy()
                np.minimum.at(new, hit[:, 0], root[hit[:, 1]])
                np.minimum.at(new, hit[:, 1], new[hit[:, 0]])
                new = np.minimum(new, new[order[new]])
                if (new == root).all():
                    break
                root = new
            on = np.flatnonzero(links)
            return pd.DataFrame({"node": nodes[on], "links": links[on].astype("int64"), "root": nodes[order[root[on]]]})

        for batch in batches:
            batch = batch if held is None else pd.concat([held, batch], ignore_index=True)
            last = (batch[at] != batch[at].iloc[-1]).any(axis=1).to_numpy()
            cut = int(np.flatnonzero(last).max() + 1) if last.any() else 0
            held = batch.iloc[cut:]
            ready = batch.iloc[:cut]
            for _, part in ready.groupby("dims", sort=False):
                if (found := solve(part)) is not None:
                    yield found
        if held is not None and len(held) and (found := solve(held)) is not None:
            yield found

    found = cells.repartition(partitions(spark), *at).sortWithinPartitions(*at).mapInPandas(tidy(compare), "node long, links long, root long")
    found = scratch.save(found, "found")
    scratch.drop("entries")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = scratch.save(connected_components(found.select(F.col("node").alias("u"), F.col("root").alias("v")), scratch), "parts")
    # The least key of a component: its nodes' are combined before they meet.
    named = parts.join(distinct.select("node", "id"), "node").groupBy("component").agg(F.min("id").alias("least"))
    parts = parts.join(named, "component").select("node", "least")
    classes = distinct.select("same", "node", "id", "copies").join(links, "node", "left").join(parts, "node", "left")
    classes = classes.select("same", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("least", "id").alias("component_id"))
    out = rows.select(F.col("id").alias(key), "same").join(classes, "same", "left")
    out = out.select(key, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", key).alias("component_id"))
    out = scratch.save(out.withColumn("kept", F.col(key) == F.col("component_id")), "out")
    scratch.drop("rows", "distinct", "found", "parts")
    return out


def op1_near_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


OP1_SQL = """
WITH RECURSIVE k AS (SELECT row_number() OVER () AS place, * FROM embeddings WHERE vec_id IS NOT NULL),
v AS (
  SELECT place, label, list_transform(embedding, lambda x: x::DOUBLE / list_max(list_transform(embedding, lambda y: abs(y::DOUBLE)))) AS x FROM k
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS (
  SELECT a.place AS u, b.place AS w FROM v a JOIN v b ON a.label = b.label AND a.place <> b.place
  WHERE len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.93),
reach AS (
  SELECT place AS node, place AS seen FROM k
  UNION
  SELECT node, w FROM reach JOIN e ON e.u = reach.seen),
c AS (SELECT node, min(vec_id) AS component_id FROM reach JOIN k ON place = seen GROUP BY node),
n AS (SELECT u, count(*) AS n_links FROM e GROUP BY u)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM k JOIN c ON node = place LEFT JOIN n ON u = place
"""
