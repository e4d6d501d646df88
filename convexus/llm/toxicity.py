"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Remembered, chunks_of
from .common import Scratch, give_back, tidy

#: Hash space of the features; the classifier keeps at most FEATURES of them.
SPACE, FEATURES = 1 << 20, 4096
#: Scores from here on are toxic.
THRESHOLD = 0.3
WORD = re.compile(r"\w+")


def feature_hashes(chunk: str) -> tuple[int, ...]:
    """Of a piece of text without white space: its lower-case words and their beginnings of 4 to 6 letters."""
    found = set()
    for word in WORD.findall(chunk.lower()):
        found.add(zlib.crc32(word.encode("utf-8", "surrogatepass")) % SPACE)
        for n in (4, 5, 6):
            if len(word) > n:
                found.add(zlib.crc32(b"^" + word[:n].encode("utf-8", "surrogatepass")) % SPACE)
    return tuple(found)


def held_out(key):
    """crc32(key as text) mod 4 = 2: rows whose labels are never learned from. A null key counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def nn_pu(rows: np.ndarray, cols: np.ndarray, positive: np.ndarray, n_features: int, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 3e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model by the non-negative PU risk, in full batches with Adam.

    Entries (rows, cols) are the features present; ``positive`` marks the confirmed examples, the others are
    unlabelled. Risk: prior * mean loss(+) of positives + max(0, mean loss(-) of unlabelled - prior * mean
    loss(-) of positives); while the second part is negative its gradient is turned round, so that the model
    gives up what it has over-fitted.
    """
    weights, bias = np.zeros(n_features), float(np.log(prior / (1 - prior)))
    state = np.zeros((2, n_features + 1))
    n_pos, n_un = max(1, positive.sum()), max(1, (~positive).sum())
    for step in range(1, steps + 1):
        z = np.bincount(rows, weights[cols], len(positive)) + bias
        p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        negative_loss = np.logaddexp(0, z)
        rest = negative_loss[~positive].sum() / n_un - prior * negative_loss[positive].sum() / n_pos
        plus = np.where(positive, prior * (p - 1) / n_pos, 0.0)
        minus = np.where(positive, -prior * p / n_pos, p / n_un)
        grad = plus + minus if rest >= 0 else -minus
        g = np.append(np.bincount(cols, grad[rows], n_features) + decay * weights, grad.sum())
        state[0] = 0.9 * state[0] + 0.1 * g
        state[1] = 0.999 * state[1] + 0.001 * g * g
        move = rate * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - float(move[-1])
    return weights, bias


def features_known(hashes: np.ndarray) -> Remembered:
    """Chunk of text -> places of the model's features in it."""
    place = {int(h): i for i, h in enumerate(hashes)}
    return Remembered(lambda chunk: tuple(place[h] for h in feature_hashes(chunk) if h in place), lambda found: 40 + 8 * len(found), 32 << 20)


def present(known: Remembered, text: str | None) -> list[int]:
    """Places of the model's features that a text has."""
    return sorted(set().union(*map(known.__getitem__, set(chunks_of(text or "")))))


@dataclass
class ToxicityModel:
    """At most FEATURES feature hashes with weights; small enough to travel with every task."""

    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -20.0

    def score(self):
        """A column function: text to a score of 0 to 1."""
        hashes, weights, bias = self.hashes, self.weights, self.bias

        def scored(batches):
            known = features_known(hashes)
            try:
                for texts in batches:
                    z = np.array([weights[present(known, t)].sum() + bias for t in texts], np.float64)
                    yield pd.Series(1 / (1 + np.exp(-np.clip(z, -60, 60))))
            finally:
                known.clear()
                give_back()

        scored.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(scored, "double")


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most: int = 12_000, least_documents: int = 8) -> ToxicityModel:
    """Learns from confirmed toxic documents and unlabelled text.

    Positives are the at most ``most`` labelled toxic documents with the lowest hashes of their keys, unlabelled
    texts the at most ``2 * most`` keys so chosen, all outside the held-out part; a key of several rows counts once, with
    the least of its texts. The class prior is the share of label 1 among all labelled keys there. Features are those in at
    least ``least_documents`` of the sample and shifted by three standard errors, at most FEATURES, with the largest shift
    between the two. Null labels and keys and repeated labels (the largest counts) are no error; without a positive the
    model's scores are near 0. A text is worked on whole: a task needs a few times the bytes of its longest text.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key))).groupBy(key).agg(F.max(label).alias("y"))
    totals = known.agg(F.count("*").alias("n"), F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("p")).first()
    if not totals["p"]:
        return ToxicityModel()
    prior = min(0.95, max(0.001, totals["p"] / totals["n"]))
    order = F.xxhash64(key)
    sampled = known.where("y = 1").select(key, F.lit(True).alias("positive")).orderBy(order, key).limit(most)
    sampled = sampled.unionByName(docs.where(F.col(key).isNotNull() & ~held_out(F.col(key))).select(key, F.lit(False).alias("positive")).distinct().orderBy(order, key).limit(2 * most))
    # At most 3 * most rows, one for each key and side.
    sample = docs.select(key, text).join(F.broadcast(sampled), key).groupBy(key, "positive").agg(F.min(text).alias("words"))
    sample = scratch.save(sample.select("positive", "words"), "sample")

    def count(batches):
        table = np.zeros((2, SPACE), np.int64)
        memory = Remembered(feature_hashes, lambda found: 40 + 40 * len(found), 48 << 20)
        for batch in batches:
            for positive, words in zip(batch["positive"], batch["words"], strict=True):
                found = set().union(*map(memory.__getitem__, set(chunks_of(words or ""))))
                table[int(positive), list(found)] += 1
        used = np.flatnonzero(table.sum(0))
        yield pd.DataFrame({"hash": used, "p": table[1, used], "u": table[0, used]})

    sizes = {r["positive"]: r["n"] for r in sample.groupBy("positive").agg(F.count("*").alias("n")).collect()}
    n_pos, n_un = sizes.get(True, 0), sizes.get(False, 0)
    if not n_pos or not n_un:
        return ToxicityModel()
    counts = sample.mapInPandas(tidy(count), "hash long, p long, u long").groupBy("hash").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    rate_p, rate_u = (F.col("p") + 0.5) / (n_pos + 1), (F.col("u") + 0.5) / (n_un + 1)
    shift = F.abs(F.sqrt(rate_p) - F.sqrt(rate_u))
    sure = F.abs(rate_p - rate_u) / F.sqrt(rate_u * (1 - rate_u) / n_pos) >= 3
    chosen = counts.where((F.col("p") + F.col("u") >= least_documents) & sure).orderBy(F.desc(shift), "hash").limit(FEATURES).collect()
    if not chosen:
        return ToxicityModel(bias=float(np.log(prior / (1 - prior))))
    hashes = np.array(sorted(r["hash"] for r in chosen), np.int64)

    def select(batches):
        known = features_known(hashes)
        for batch in batches:
            yield pd.DataFrame({"positive": batch["positive"], "features": [np.array(present(known, t), np.int16).tobytes() for t in batch["words"]]})

    data = sample.mapInPandas(tidy(select), "positive boolean, features binary").toPandas()  # the bounded sample
    cols = [np.frombuffer(x, np.int16).astype(np.int64) for x in data["features"]]
    rows = np.repeat(np.arange(len(cols)), [len(c) for c in cols])
    weights, bias = nn_pu(rows, np.concatenate(cols), data["positive"].to_numpy(bool), len(chosen), prior)
    keep = np.abs(weights) > 1e-6
    scratch.drop("sample")
    return ToxicityModel(hashes[keep], weights[keep], bias)


def score_documents(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score, predicted for every whole text. Null texts score as empty ones; repeated rows and null keys stay."""
    out = Scratch(docs.sparkSession, "toxicity").save(docs.select(key, held_out(F.col(key)).alias("held_out"), model.score()(F.col(text)).alias("score")), "scores")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return score_documents(docs, fit(docs, labels))
