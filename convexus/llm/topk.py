"""Exact top-k by integer inner product: columnar branch and bound."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A component that is not below this in size, scaled, does not fit a long.
LIMIT = 2.0**63


def search_block(queries: np.ndarray, cands: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, k: int, width: int = 16):
    """The k best of one block for each query: (query row, candidate row, score) arrays, ties to smaller ids.

    Candidates lie column by column. Distances grow one block of ``width`` dimensions at a time, those
    with most mass first; after each, a candidate stays only if its partial score plus the product of the
    remaining norms (Cauchy-Schwarz) can still reach the k-th best score known, and the columns that
    follow are read at the surviving places only.
    """
    dims = cands.shape[1]
    order = np.argsort(-(cands.astype(np.float64) ** 2).sum(0), kind="stable")
    columns, rows = np.ascontiguousarray(cands.T[order]), queries[:, order]
    most = dims * max(1.0, np.abs(columns.astype(np.float64)).max(initial=0)) * max(1.0, np.abs(rows.astype(np.float64)).max(initial=0))
    exact = most < 2.0**52
    # Sums that may leave 64 bits are Python's integers, and a score that does is an error below.
    kind = np.float64 if exact else np.int64 if most < 2.0**62 else object
    columns, rows = columns.astype(kind), rows.astype(kind)
    starts = list(range(0, dims, width))
    rest_c = [np.sqrt((columns[s:].astype(np.float64) ** 2).sum(0)) for s in starts] + [np.zeros(len(ids))]
    rest_q = [np.sqrt((rows[:, s:].astype(np.float64) ** 2).sum(1)) for s in starts] + [np.zeros(len(rows))]
    # Bounds are doubles: beyond the exact range they are off by a rounding of the largest sums.
    loose = [1e-6 if exact else 1e-6 + 1e-9 * x * rest_c[0].max(initial=0) for x in rest_q[0]]
    probe = np.linspace(0, len(ids) - 1, min(len(ids), 64)).astype(np.int64)
    seed = rows @ columns[:, probe]
    first = rows[:, :width] @ columns[:width]  # the one block that all candidates take part in
    out_q, out_c, out_s = [], [], []
    for i in range(len(rows)):
        own = ids[probe] == query_ids[i]
        known = np.sort(seed[i][~own])[::-1]
        floor = known[k - 1] if len(known) >= k else -np.inf
        alive, part = np.flatnonzero(ids != query_ids[i]), first[i]
        part = part[alive]
        for b in range(1, len(starts) + 1):
            slack = rest_q[b][i] * rest_c[b][alive]
            keep = (part.astype(np.float64) + slack * (1 + 1e-9) + loose[i] >= float(floor)).astype(bool)
            alive, part = alive[keep], part[keep]
            if b < len(starts) and len(alive):
                block = slice(starts[b], starts[b] + width)
                part = part + rows[i, block] @ columns[block, alive]
                if len(part) >= k and rest_c[b + 1].size:
                    low = part.astype(np.float64) - rest_q[b + 1][i] * rest_c[b + 1][alive] * (1 + 1e-9) - loose[i]
                    floor = max(float(floor), np.partition(low, -k)[-k])
        best = np.lexsort((ids[alive], -part))[:k] if kind is not object else np.array(sorted(range(len(alive)), key=lambda j, s=part, a=alive: (-s[j], ids[a[j]]))[:k], dtype=np.int64)
        if kind is object and any(not -(2**63) <= s < 2**63 for s in part[best]):
            raise OverflowError(f"a score of query {query_ids[i]} does not fit a long")
        out_q.append(np.full(len(best), i))
        out_c.append(alive[best])
        out_s.append(part[best])
    return np.concatenate(out_q), np.concatenate(out_c), np.concatenate(out_s).astype(np.int64)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, query_block: int = 2048, block: int = 16384, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest scores among all rows but its own, ties to the smaller id.

    Queries and candidates are dealt into blocks of bounded size and each pair of blocks is searched
    once; the blocks' k best meet in a final ranking. A component x counts as floor(scale * x); one that
    does not fit a long, and a score among the best that does not, is an error. Vectors that are null or hold null or non-finite components take no part, nor do null
    ids; vectors meet only those of the same length. A query given twice with one vector counts once;
    candidates given twice are two rows; a query with no candidate has no rows.
    """
    spark = vectors.sparkSession

    def digits(df: DataFrame) -> DataFrame:
        bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
        scaled = lambda x: x.cast("double") * scale
        whole = F.transform(vector, lambda x: F.when(F.abs(scaled(x)) < LIMIT, F.floor(scaled(x))).otherwise(F.raise_error(F.lit("a component does not fit a long")).cast("long")))
        return df.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & ~bad).select(F.col(key).cast("long").alias("id"), whole.alias("x"), F.size(vector).alias("dims"))

    cands, asked = digits(vectors), digits(queries).distinct()
    n_c, n_q = cands.count(), asked.count()
    blocks_c, blocks_q = max(1, -(-n_c // block)), max(1, -(-n_q // query_block))
    deal = lambda n: F.pmod(F.xxhash64("id", "x"), F.lit(n)).cast("int")
    # Equal rows are dealt by their place too, so that a vector that a third of the rows share is spread.
    spread = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(blocks_c)).cast("int")
    left = asked.withColumn("q", deal(blocks_q)).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(blocks_c - 1)))).withColumn("side", F.lit(0))
    right = cands.withColumn("c", spread).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(blocks_q - 1)))).withColumn("side", F.lit(1))

    def cell(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "tag": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})
        if not len(a) or not len(b) or not len(a["x"].iloc[0]):
            return none
        ids, asked_ids = b["id"].to_numpy(), a["id"].to_numpy()
        q, c, s = search_block(np.stack(a["x"].to_list()), np.stack(b["x"].to_list()), asked_ids, ids, k)
        return pd.DataFrame({"query_id": asked_ids[q], "tag": a["tag"].to_numpy()[q], "vec_id": ids[c], "score": s})

    keys = ["dims", "q", "c"]
    left = left.withColumn("tag", F.xxhash64("x"))
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(cell, "query_id long, tag long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "tag").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(rows, rows.where("vec_id % 50 = 0"))


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
