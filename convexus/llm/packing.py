"""Packing by concatenation and cutting at fixed windows."""

from __future__ import annotations

import json
import sys
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Remembered, chunks_of, letters_of, split_words, word_pattern
from .common import Scratch, tidy

_KNOWN: dict[str, Remembered] = {}


def token_bytes(path: str) -> Remembered:
    """This worker's memory of chunks (texts without white space) as little-endian 16-bit ids.

    White space ends words and is dropped by the vocabulary, so a text's ids are those of its chunks in turn, and a
    chunk's are those of its lower-case words, of which there are fewer. A chunk that may hold a special token goes whole.
    """
    if path not in _KNOWN:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        if tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids need more than 16 bits")
        with open(path, encoding="utf-8") as file:
            words, model = word_pattern(json.load(file)), tokenizer.model
        tokens = lambda word: [t.id for t in model.tokenize(letters_of(word))]
        get = Remembered(lambda word: np.array(tokens(word), "<u2").tobytes() if sys.byteorder == "big" else array("H", tokens(word)).tobytes(), len).__getitem__
        whole = lambda chunk: np.array(tokenizer.encode(chunk, add_special_tokens=False).ids, "<u2").tobytes()
        _KNOWN[path] = Remembered(lambda chunk: whole(chunk) if "<" in chunk else b"".join(map(get, split_words(words, chunk))), len, 160 << 20)
    return _KNOWN[path]


def tokenize(docs: DataFrame, path: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """First pass: (part, start, key, n, ids): each document's ids and ``end_id``, its partition, and how many ids of the partition precede it."""

    def run(batches):
        get, part, start = token_bytes(path).__getitem__, TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u2").tobytes()
        for batch in batches:
            ids = [b"".join(map(get, chunks_of(t.as_py() or ""))) + end for t in batch.column(1)]
            n = np.array([len(x) // 2 for x in ids], np.int64)
            starts = start + np.cumsum(n) - n
            start += int(n.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), pa.array(starts), batch.column(0), pa.array(n), pa.array(ids, pa.binary())], names=["part", "start", key, "n", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(tidy(run, _KNOWN.clear), f"part int, start long, `{key}` {kind}, n long, ids binary")


def pack(docs: DataFrame, path: str, window: int = 4096, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces: key, start, length, doc_tokens, sequence_id, offset, ids (little-endian 32-bit).

    Documents are concatenated in the order of the first pass's partitions and cut every ``window`` ids, so only
    the last sequence is shorter. The first pass writes each document's ids and its place in its partition;
    the partitions' totals (one number each) give every partition's global offset; the second pass cuts. A document
    across a boundary leaves a record on either side. Null and empty texts are the end id alone; repeated
    rows and null keys are documents like any other; other columns are left out, whatever their names; an empty table has
    no pieces. A vocabulary of more than 65,536 ids is refused.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    tokens = scratch.save(tokenize(docs, path, end_id, key, text), "tokens")
    totals = sorted((r["part"], r["n"]) for r in tokens.groupBy("part").agg(F.sum("n").alias("n")).collect())
    base, before = {}, 0
    for part, n in totals:
        base[part], before = before, before + n

    def cut(batches):
        for batch in (b.slice(s, 512) for b in batches for s in range(0, b.num_rows, 512)):
            rows: list[list] = [[] for _ in range(6)]
            at = []
            for i, (part, start, n, ids) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4)), strict=True)):
                first = base[part] + start
                wide = np.frombuffer(ids, "<u2").astype("<u4")
                done = 0
                while done < n:
                    place = first + done
                    size = min(n - done, window - place % window)
                    for column, value in zip(rows, (done, size, n, place // window, place % window, wide[done : done + size].tobytes()), strict=True):
                        column.append(value)
                    at.append(i)
                    done += size
            keys = batch.column(2).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, *(pa.array(c, pa.int64()) for c in rows[:5]), pa.array(rows[5], pa.binary())], names=[key, "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return tokens.mapInArrow(tidy(cut), f"`{key}` {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
