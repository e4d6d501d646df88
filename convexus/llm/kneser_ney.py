"""Quality by the perplexity of an interpolated modified Kneser-Ney model over characters.

Counts, probabilities and the scores of documents are joins sharded on the grams: a block of texts asks for the grams that
it has, the answers come back to the block, and neither the driver nor a broadcast ever holds grams.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Blocks, Scratch, quantiles, tidy

#: Order of the model and bits of a character (a UTF-16 code unit) within a gram's key.
ORDER, BITS = 4, 16
#: Noncharacters that stand before and after a text.
BEGIN, END = "\ufffe", "\uffff"
#: Trusted keys up to this many are broadcast (8 bytes each); more are joined by shuffle.
BROADCAST_KEYS = 4_000_000
POOL = "*"
#: Characters worked on at once, grams that a task holds for a language before they leave, bytes of text in a block.
STEP, HELD, BLOCK = 1 << 19, 1 << 18, 16 << 20
#: Losses are compared and ranked as whole billionths of a nat for each character.
UNIT = 1e9


def language(lang):
    """Two or three lower-case letters, else ``und``: so there are at most 18,253 languages."""
    return F.when(F.col(lang).rlike("^[a-z]{2,3}$"), F.col(lang)).otherwise("und")


def gram_chunks(texts: list[str]):
    """(keys, text of each key), STEP characters at a time: the gram that ends at each code unit of each text and at its end.

    A key is the gram's four 16-bit code units, the last one lowest; three beginnings precede each text.
    """
    raw = [f"{BEGIN * (ORDER - 1)}{t}{END}".encode("utf-16-le", "surrogatepass") for t in texts]
    sizes = np.array([len(r) // 2 for r in raw], np.int64)
    ends = np.cumsum(sizes)
    units = np.frombuffer(b"\0" * (2 * ORDER - 2) + b"".join(raw), "<u2")
    del raw
    for s in range(0, len(units) - (ORDER - 1), STEP):
        part = units[s : s + STEP + ORDER - 1].astype(np.uint64)
        n = len(part) - (ORDER - 1)
        keys = part[ORDER - 1 :].copy()
        for back in range(1, ORDER):
            keys |= part[ORDER - 1 - back : n + ORDER - 1 - back] << np.uint64(BITS * back)
        text = np.searchsorted(ends, np.arange(s, s + n), "right")
        inside = np.arange(s, s + n) - (ends - sizes)[text] >= ORDER - 1  # others begin before the text
        yield keys[inside].view(np.int64), text[inside]


def some_texts(column, at):
    """(places, texts) of a column's rows ``at``, about STEP characters at a time; null is empty, a longer text stands alone."""
    held, texts, size = [], [], 0
    for i in at:
        texts.append(column[int(i)].as_py() or "")
        held.append(i)
        size += len(texts[-1])
        if size >= STEP:
            yield np.array(held), texts
            held, texts, size = [], [], 0
    if held:
        yield np.array(held), texts


def runs(keys: np.ndarray, counts: np.ndarray | None = None):
    """Distinct keys and how often each occurs (or the sum of its counts)."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    if counts is None:
        keys = np.sort(keys)
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        return keys[first], np.diff(np.r_[first, len(keys)])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts[order], first)


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n): how often the texts (lang, text) of each language have each gram, and all texts under the pooled name.

    Counts are summed within a task before they leave; a task that holds HELD grams lets them go.
    """

    def run(batches):
        sums: dict[str, list] = {}
        held = 0

        def flush():
            for lang, (keys, counts) in sums.items():
                keys, counts = runs(np.concatenate(keys), np.concatenate(counts))
                for s in range(0, len(keys), 1 << 16):
                    k, c = keys[s : s + (1 << 16)], counts[s : s + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k), pa.array(c, pa.int64())], names=["lang", "gram", "n"])
            sums.clear()

        for batch in batches:
            langs = pd.Series(batch.column(0).to_pylist(), dtype=object)
            for lang, part in langs.groupby(langs):
                for keys, _ in (x for _, texts in some_texts(batch.column(1), part.index) for x in gram_chunks(texts)):
                    keys, counts = runs(keys)
                    for name in {lang, POOL}:
                        own = sums.setdefault(name, [[], []])
                        own[0].append(keys)
                        own[1].append(counts)
                        held += len(keys)
                    if held > 4 * HELD:
                        for own in sums.values():
                            keys, counts = runs(np.concatenate(own[0]), np.concatenate(own[1]))
                            own[:] = [[keys], [counts]]
                        held = sum(len(own[0][0]) for own in sums.values())
                        if held > HELD:
                            yield from flush()
                            held = 0
        yield from flush()

    return docs.select("lang", "text").mapInArrow(tidy(run), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def suffix(gram, order: int):
    """The last ``order`` characters of a gram's key."""
    return gram if order == ORDER else gram.bitwiseAND((1 << (BITS * order)) - 1)


def fit_orders(counts: DataFrame, scratch: Scratch) -> dict[int, tuple[DataFrame, DataFrame]]:
    """For each order (seen grams with what the discount leaves, contexts with their totals and freed mass) from counts (lang, gram, n).

    The highest order uses counts, lower ones continuation counts (distinct characters that precede).
    Each order's discounts D1, D2, D3+ follow from its counts of counts.
    """
    levels, seen = {}, counts.where("n > 0").select("lang", "gram", F.col("n").alias("c"))
    for order in range(ORDER, 0, -1):
        levels[order] = seen = scratch.save(seen, f"order{order}")
        seen = seen.select("lang", suffix(F.col("gram"), order - 1).alias("gram")).groupBy("lang", "gram").agg(F.count("*").alias("c"))
    out = {}
    for order, level in levels.items():
        of = lambda k: F.sum(F.when(F.col("c") == k, 1).otherwise(0))
        few = level.groupBy("lang").agg(*[of(k).alias(f"n{k}") for k in (1, 2, 3, 4)])
        y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
        # Counts of counts that small data lack give the usual fallbacks; a discount stays within its count.
        raw = lambda k: k - (k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}"))
        fit = lambda k, least: F.when(raw(k).isNull(), F.lit(least)).otherwise(F.greatest(F.least(raw(k), F.lit(float(k))), F.lit(0.0)))
        few = few.select("lang", *[fit(k, d).alias(f"d{k}") for k, d in ((1, 0.5), (2, 1.0), (3, 1.5))])
        discount = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        # One row for each language; the result is written, so that no use of the model plans or broadcasts this again.
        level = scratch.save(level.join(F.broadcast(few), "lang").select("lang", "gram", "c", discount.alias("d")), f"discounted{order}")
        scratch.drop(f"order{order}")
        heads = level.groupBy("lang", F.shiftrightunsigned("gram", BITS).alias("context")).agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("free"))
        out[order] = level.select("lang", F.col("gram").alias("own"), (F.col("c") - F.col("d")).alias("left")), scratch.save(heads, f"heads{order}")
    return out


def log_probabilities(orders: dict[int, tuple[DataFrame, DataFrame]], asked: DataFrame) -> DataFrame:
    """(lang, gram, logp) for distinct (lang, gram), by joins sharded on the grams.

    Each order is interpolated with the next lower one by the mass its discounts free, and the lowest with equal
    shares of the language's characters and one unknown. A context never seen passes on to the lower order whole.
    """
    vocabulary = orders[1][0].groupBy("lang").agg((F.count("*") + 1).alias("v"))
    asked = asked.join(F.broadcast(vocabulary), "lang", "left").withColumn("p", 1 / F.coalesce(F.col("v"), F.lit(256))).drop("v")
    for order in range(1, ORDER + 1):
        level, heads = orders[order]
        asked = asked.withColumn("own", suffix(F.col("gram"), order)).withColumn("context", F.shiftrightunsigned("own", BITS))
        asked = asked.join(level, ["lang", "own"], "left").join(heads, ["lang", "context"], "left")
        asked = asked.select("lang", "gram", F.when(F.col("total").isNull(), F.col("p")).otherwise(F.coalesce("left", F.lit(0.0)) / F.col("total") + F.col("free") * F.col("p")).alias("p"))
    return asked.select("lang", "gram", F.log(F.greatest("p", F.lit(1e-12))).alias("logp"))


class GramTable:
    """Open addressing over gram keys, for whole arrays at a time; only keys that it has may be asked for."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * max(1, len(keys)) - 1).bit_length())
        few = set(keys[(keys < 0) & (keys >= -len(keys) - 1)].tolist())
        self.empty = next(k for k in range(-1, -len(keys) - 2, -1) if k not in few)
        self.keys, self.values = np.full(1 << self.bits, self.empty, np.int64), np.zeros(1 << self.bits)
        place = self.slot(keys)
        while len(keys):
            free = self.keys[place] == self.empty
            self.keys[place[free]] = keys[free]
            done = self.keys[place] == keys
            self.values[place[done]] = values[done]
            keys, values, place = keys[~done], values[~done], (place[~done] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        place = self.slot(keys)
        out = self.values[place]
        wrong = np.flatnonzero(self.keys[place] != keys)
        place = place[wrong]
        while len(wrong):
            place = (place + 1) & ((1 << self.bits) - 1)
            hit = self.keys[place] == keys[wrong]
            out[wrong[hit]] = self.values[place[hit]]
            wrong, place = wrong[~hit], place[~hit]
        return out


@dataclass
class QualityModel:
    """Each order's tables in the shared folder, the languages that have a model, and thresholds of the loss (lang, value)."""

    scratch: Scratch
    orders: dict[int, tuple[DataFrame, DataFrame]]
    languages: list[str]
    limits: DataFrame | None = field(default=None)

    def with_language(self, docs: DataFrame, lang: str, out: str) -> DataFrame:
        """``docs`` and the language whose model scores a row: its own where trusted text has it, else the pooled one."""
        own = docs.sparkSession.createDataFrame([(x, x) for x in self.languages], f"_own string, `{out}` string")  # at most 18,254 rows
        held = docs.join(F.broadcast(own), language(lang) == F.col("_own"), "left").drop("_own")
        return held.withColumn(out, F.coalesce(F.col(f"`{out}`"), F.lit(POOL)))

    def losses(self, docs: DataFrame, columns: list[str], text: str = "text", lang: str = "lang") -> DataFrame:
        """``columns`` of each row and ``model_lang``, ``loss`` (the sum of -log p over the whole text and its end), ``units`` (their number).

        Null texts are empty ones. Blocks ask for their distinct grams; the log-probabilities are joined and go back to the blocks.
        Of ``docs`` columns called like these three are replaced. A task needs a few bytes for each character of a block and of its longest text.
        """
        scratch = Scratch(docs.sparkSession, "losses")
        columns = [c for c in columns if c.lower() not in ("model_lang", "loss", "units")]
        docs = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*columns, text, lang])])
        docs = self.with_language(docs, lang, "model_lang")
        blocks = Blocks(docs, text, scratch, BLOCK)

        def wanted(block: int, part: pa.Table) -> pa.Table:
            names, texts = part.column("model_lang").to_pylist(), part.column(text)
            langs, grams = [], []
            for lang, at in pd.Series(range(len(names))).groupby(np.array(names, object)):
                own: list[np.ndarray] = []
                for keys, _ in (x for _, some in some_texts(texts, at) for x in gram_chunks(some)):
                    own.append(np.unique(keys))
                    if len(own) == 16:
                        own = [np.unique(np.concatenate(own))]
                grams.append(np.unique(np.concatenate(own)))
                langs += [lang] * len(grams[-1])
            return pa.table([pa.array([block] * len(langs), pa.int64()), pa.array(langs, pa.string()), pa.array(np.concatenate(grams))], names=["block", "lang", "gram"])

        asked = scratch.save(blocks.each([text, "model_lang"], wanted, "block long, lang string, gram long"), "asked")
        scores = scratch.save(log_probabilities(self.orders, asked.select("lang", "gram").distinct()), "scores")

        def scored(left: pa.Table, right: pa.Table) -> pa.Table:
            n = left.num_rows
            loss, units = np.zeros(n), np.zeros(n, np.int64)
            if n:
                names, texts = np.array(left.column("model_lang").to_pylist(), object), left.column(text)
                theirs = np.array(right.column("lang").to_pylist(), object)
                grams, logp = right.column("gram").to_numpy(), right.column("logp").to_numpy()
                for lang in set(names):
                    at = np.flatnonzero(names == lang)
                    table = GramTable(grams[theirs == lang], logp[theirs == lang])
                    for rows, some in some_texts(texts, at):
                        for keys, place in gram_chunks(some):
                            loss[rows] -= np.bincount(place, table.get(keys), len(rows))
                            units[rows] += np.bincount(place, minlength=len(rows))
            return pa.table([*(left.column(c) for c in columns), left.column("model_lang"), pa.array(loss), pa.array(units)], names=[*columns, "model_lang", "loss", "units"])

        schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns), "model_lang string, loss double, units long"])
        answers = asked.join(scores, ["lang", "gram"]).select("block", "lang", "gram", "logp")
        out = scratch.save(blocks.cogroup(list(dict.fromkeys([*columns, text, "model_lang"])), answers, scored, schema), "out")
        blocks.drop()
        scratch.drop("asked", "scores")
        return out

    def judged(self, docs: DataFrame, columns: list[str], text: str = "text", lang: str = "lang") -> DataFrame:
        """``columns`` of each row and perplexity, threshold, kept: a loss at or below the threshold of the row's language, else of all."""
        rows = self.losses(docs, columns, text, lang)
        rows = rows.withColumn("_mean", F.floor(F.col("loss") / F.col("units") * UNIT).cast("long"))
        if self.limits is None:
            rows = rows.withColumn("_limit", F.lit(None).cast("long"))
        else:  # a row for each language
            own, pooled = self.limits.select(F.col("lang").alias("model_lang"), F.col("value").alias("_own")), self.limits.where(F.col("lang") == POOL).select(F.col("value").alias("_pooled"))
            rows = rows.join(F.broadcast(own), "model_lang", "left").join(F.broadcast(pooled), F.lit(True), "left").withColumn("_limit", F.coalesce("_own", "_pooled"))
        names = [F.col(f"`{c}`") for c in columns if c.lower() not in ("perplexity", "threshold", "kept")]
        limit = F.coalesce(F.exp(F.col("_limit") / UNIT), F.lit(float("inf")))
        return rows.select(*names, F.exp(F.col("loss") / F.col("units")).alias("perplexity"), limit.alias("threshold"), F.coalesce(F.col("_mean") <= F.col("_limit"), F.lit(True)).alias("kept"))


def fit(docs: DataFrame, labels: DataFrame, quantile: float = 0.99, key: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "quality") -> QualityModel:
    """The model of the trusted texts (label 1), and per language the ``quantile`` of perplexity in trusted texts kept out of the counts.

    Every trusted document outside the kept-out fifth (crc32 of the key mod 5 = 0) trains; the tables grow with the
    corpus. Languages without trusted text use one pooled model and threshold. Null keys are never trusted; a key
    labelled twice is trusted if any label is 1; without trusted text all documents are kept.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    fold = F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0
    trusted = scratch.save(labels.where((F.col(label) == 1) & F.col(key).isNotNull()).select(F.col(key).alias("_key")).distinct(), "trusted")
    small = trusted.count() <= BROADCAST_KEYS
    known = docs.select(F.col(key).alias("_key"), F.col(text).alias("text"), language(lang).alias("lang"), fold.alias("fold")).join(F.broadcast(trusted) if small else trusted, "_key")
    counts = scratch.save(count_grams(known.where(~F.col("fold"))), "counts")
    languages = sorted(r["lang"] for r in counts.select("lang").distinct().collect() if r["lang"] != POOL)  # at most 18,253
    model = QualityModel(scratch, fit_orders(counts, scratch), languages)
    if languages:
        kept_out = scratch.save(known.where("fold").select("text", "lang"), "kept_out")  # a join is not planned twice
        held = model.losses(kept_out, [])
        mean = F.floor(F.col("loss") / F.col("units") * UNIT).cast("long").alias("value")
        held = held.select(F.explode(F.array_distinct(F.array("model_lang", F.lit(POOL)))).alias("lang"), mean)
        model.limits = quantiles(held, scratch, quantile)
    scratch.drop("trusted", "counts", "kept_out")
    return model


def judge(docs: DataFrame, model: QualityModel, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """key, lang, n_chars, perplexity, threshold, kept for every row; rows at or below their language's threshold are kept."""
    docs = docs.select(key, lang, text, F.length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_chars"))
    return model.judged(docs, [key, lang, "n_chars"], text, lang)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return judge(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")))
