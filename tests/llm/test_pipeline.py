import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from convexus.llm import kneser_ney, toxicity
from tests.llm.test_texts import brute_repeats, plain_jaccard, shingle_list


def plain_quality(docs, labels):
    """Kept ids by the model's definition, with dictionaries of character grams."""
    n, begin, end = kneser_ney.ORDER, kneser_ney.BEGIN, kneser_ney.END
    trusted = {i for i, q, _ in labels if q == 1}
    fold = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    grams = lambda t: [s[i : i + n] for s in [begin * (n - 1) + t + end] for i in range(len(s) - n + 1)]

    def model(texts):
        levels = {n: Counter(g for t in texts for g in grams(t))}
        for k in range(n - 1, 0, -1):
            levels[k] = Counter(g[1:] for g in levels[k + 1])
        heads, discounts = {}, {}
        for k, level in levels.items():
            of = Counter(level.values())
            y = of[1] / (of[1] + 2 * of[2])
            discounts[k] = [max(0.0, min(j, j - (j + 1) * y * of[j + 1] / of[j])) if of[j] else d for j, d in ((1, 0.5), (2, 1.0), (3, 1.5))]
            for g, c in level.items():
                total, free = heads.get(g[:-1], (0, 0.0))
                heads[g[:-1]] = total + c, free + discounts[k][min(c, 3) - 1]

        def p(g):
            if not g:
                return 1 / (len(levels[1]) + 1)
            if g[:-1] not in heads or (len(g) == 1 and "" not in heads):
                return p(g[1:])
            total, free = heads[g[:-1]]
            c = levels[len(g)].get(g, 0)
            return ((c - discounts[len(g)][min(c, 3) - 1]) if c else 0) / total + free / total * p(g[1:])

        cache = {}
        return lambda t: -sum(cache[g] if g in cache else cache.setdefault(g, np.log(p(g))) for g in grams(t)) / (len(t) + 1)

    train = lambda lang: [t for i, t, x in docs if lang in (x, None) and i in trusted and not fold(i)]
    loss = {lang: model(train(lang) or train(None)) for lang in {x for _, _, x in docs}}
    value = {i: np.floor(loss[lang](t) * 1e9) for i, t, lang in docs}
    held = lambda lang: sorted(value[i] for i, _, x in docs if lang in (x, None) and i in trusted and fold(i))
    limit = lambda lang: (lambda v: v[int(np.ceil(0.99 * len(v))) - 1])((train(lang) and held(lang)) or held(None))
    return {i for i, _, lang in docs if value[i] <= limit(lang)}


def test_each_stage_against_a_plain_version(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = [(r["doc_id"], r["quality"], r["toxic"]) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()]
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    save = lambda df, name: (df.write.parquet(str(tmp_path / name)), spark.read.parquet(str(tmp_path / name)))[1]

    one = save(corpus_pipeline.keep_quality(spark, docs, sf_dir), "1")
    assert set(texts(one)) == plain_quality([(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()], labels)

    two = save(corpus_pipeline.drop_toxic(spark, one, sf_dir), "2")
    model = toxicity.fit(one, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    weights = dict(zip(model.hashes.tolist(), model.weights, strict=True))
    score = lambda t: 1 / (1 + np.exp(-(model.bias + sum(weights.get(h, 0.0) for h in {h for w in t.split() for h in toxicity.feature_hashes(w)}))))
    assert set(texts(two)) == {i for i, t in texts(one).items() if score(t) < 0.3}

    three = save(corpus_pipeline.drop_near_duplicates(spark, two, sf_dir), "3")
    held = texts(two)
    sets, root = {i: shingle_list(t) for i, t in held.items()}, {i: i for i in held}
    find = lambda i: i if root[i] == i else find(root[i])
    for i in held:
        for j in held:
            if i < j and set(sets[i]) & set(sets[j]) and (held[i] == held[j] or plain_jaccard(sets[i], sets[j]) >= 0.8):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert set(texts(three)) == {i for i in held if find(i) == i}

    four = save(corpus_pipeline.drop_repeats(spark, three, sf_dir), "4")
    keys, kept = list(texts(three)), texts(four)
    plain = brute_repeats([texts(three)[i].encode() for i in keys], 200)
    assert {i: len(kept[i].encode()) for i in keys} == {i: n - gone for i, (n, gone, _, _) in zip(keys, plain, strict=True)}
    assert all(hashlib.sha256(kept[i].encode()).hexdigest() == digest for i, (_, _, _, digest) in zip(keys, plain, strict=True))
    assert all(r["n_chars"] == len(r["text"]) for r in four.collect())

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = corpus_pipeline.pack(spark, four, sf_dir).collect()
    for i, t in kept.items():
        ids = [*tok.encode(t, add_special_tokens=False).ids, 2]
        own = sorted((r["start"], r["length"], r["ids_crc32"]) for r in pieces if r["doc_id"] == i)
        assert own == [(s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for s, n, _ in own] and sum(n for _, n, _ in own) == len(ids)
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in pieces)
    at = 0
    for s, o, n in places:
        assert (s, o) == divmod(at, 4096) and o + n <= 4096
        at += n


def test_odd_rows_and_clashing_columns(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.unionByName(docs.limit(3)).unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long"))).unionByName(docs.limit(1).withColumn("text", F.lit(None).cast("string")))
    clash = ["_n_bytes", "n_removed", "_kept_sha256", "_perplexity", "kept", "loss", "model_lang", "_block", "_row", "score", "class_id", "c0"]
    docs.withColumns({c: F.lit("mine") for c in clash}).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, sizes = now.columns, [now.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(str(tmp_path / str(k)))
        now = spark.read.parquet(str(tmp_path / str(k)))
        if name != "packing":
            assert now.columns == columns and all(now.where(F.col(c) != "mine").isEmpty() for c in clash)
        sizes.append(now.count())
    assert sizes[1] < sizes[0] and sizes[2] < sizes[1] and sizes[3] < sizes[2] and sizes[4] == sizes[3]
    assert spark.read.parquet(str(tmp_path / "2")).where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "suffix_dedup", "packing"]


def test_empty(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf_dir}/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
