"""The corpus pipeline: quality, toxicity, near duplicates, repeated passages, packing.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame with the columns of
``documents``; the last one returns the packed pieces. Stages accept null keys and texts, repeated rows and empty tables as
their operators do (see there).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convexus.llm import kneser_ney, near_documents, packing, suffix_dedup, toxicity
from convexus.llm.common import Scratch


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns c0, c1, ..., and the new name of each: an operator's own columns can't clash with those."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is at most the threshold of their language."""
    model = kneser_ney.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    rows, name = _numbered(docs)
    return model.judged(rows, rows.columns, name["text"], name["lang"]).where("kept").select(*rows.columns).toDF(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.3."""
    model = toxicity.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return Scratch(spark, "clean").save(docs.where(model.score()(F.col("text")) < toxicity.THRESHOLD), "documents")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id, once; documents without an id stay."""
    classes = near_documents.near_duplicates(docs.select("doc_id", "text"))
    gone = classes.where(~F.col("kept")).select("doc_id").distinct()
    left = docs.where(F.col("doc_id").isNotNull()).join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id"])
    return left.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of strings of 200 bytes that also start elsewhere."""
    rows, name = _numbered(docs)
    out = suffix_dedup.remove_repeats(rows, text=name["text"])
    length = F.length(name["text"]).cast(docs.schema["n_chars"].dataType)
    return out.withColumn(name["n_chars"], length).select(*rows.columns).toDF(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 ids; ``ids`` holds little-endian 32-bit ids."""
    import public_tokenizers

    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids").cast("long"))


STAGES = [
    ("quality", keep_quality),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_dedup", drop_repeats),
    ("packing", pack),
]

#: No SQL expresses the models and tokenizers; tests/llm/test_pipeline.py compares each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return STAGES[-1][1](spark, docs, sf_dir)
