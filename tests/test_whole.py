"""Queries that do the whole job, against brute force over small tables made here."""

import math
import re
from collections import Counter

import pytest

from convexus import catalog


def save(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def fold(s):
    return re.sub(r"[ \t\n\r\f\x0b]+", " ", s.lower()).strip(" ")


def test_tfidf_counts_common_terms(spark, tmp_path):
    """600 items share a term (three blocks), and some also a rare one."""
    rows = [(i, f"Common own{i} pair{i // 2}" + (" twelve" if i < 12 else "")) for i in range(600)]
    d = save(spark, tmp_path, "benchmark", rows, "item_id long, text string")
    tf = {i: Counter(t.lower().split()) for i, t in rows}
    df = Counter(w for c in tf.values() for w in c)
    v = {i: {w: n * (math.log(601 / (1 + df[w])) + 1) for w, n in c.items()} for i, c in tf.items()}
    norm = {i: math.sqrt(sum(x * x for x in c.values())) for i, c in v.items()}
    got = {(r["a"], r["b"]): r["similarity"] for r in catalog.QUERIES["tfidf_similarity"](spark, d).collect()}
    assert len(got) == 600 * 599 // 2
    for (a, b), s in got.items():
        assert s == pytest.approx(sum(x * v[b].get(w, 0) for w, x in v[a].items()) / norm[a] / norm[b], abs=1.1e-6)


def test_residual_curves_of_every_split_and_pair(spark, sf_dir):
    rows = catalog.QUERIES["residual_mass_curve"](spark, sf_dir).collect()
    sets = {(r["split_seed"], r["t"], r["a"], r["b"]) for r in rows}
    assert len(sets) == 3 * 30
    last = {}
    for r in rows:
        key = (r["split_seed"], r["t"], r["a"], r["b"])
        last[key] = max(last.get(key, (0, 0, 0)), (r["place"], r["share"], r["fraction"]))
    assert all(share == fraction == 1 for _, share, fraction in last.values())


def test_topk_overlap_of_every_split(spark, sf_dir):
    rows = catalog.QUERIES["topk_overlap"](spark, sf_dir).collect()
    assert {(r["split_seed"], r["t1"], r["t2"], r["k"]) for r in rows} == {(s, a, b, k) for s in (20260828, 20260829, 20260830) for a in range(5) for b in range(a + 1, 5) for k in range(1, 41)}


def test_every_eligible_distractor(spark, tmp_path):
    """600 items (nine cells): the first's text is in two others, one text is empty."""
    rows = [(i, {0: "Needle here", 301: "a  NEEDLE\there b", 598: "needle here", 7: " "}.get(i, f"text {i} x")) for i in range(600)]
    d = save(spark, tmp_path, "benchmark", rows, "item_id long, text string")
    got = [tuple(r) for r in catalog.QUERIES["eligible_distractors"](spark, d).collect()]
    want = {(i, j) for i, s in rows for j, t in rows if i % 4 != j % 4 and not (fold(s) and fold(s) in fold(t))}
    assert len(got) == len(set(got)) and set(got) == want and (0, 301) not in want


def test_every_item_gets_its_context(spark, tmp_path):
    """Sources of one word: 64 of them are needed, and the last item has them too."""
    import hashlib

    rows = [(i, f"W{i}") for i in range(100)]
    d = save(spark, tmp_path, "benchmark", rows, "item_id long, text string")
    key = lambda i, j: (hashlib.sha256(f"5\x1f{i}\x1f{j}".encode()).hexdigest()[:16], j)
    pool = {i: sorted((j for j, t in rows if j % 4 != i % 4 and s.lower() not in t.lower()), key=lambda j, i=i: key(i, j))[:64] for i, s in rows}
    got = {(r["item_id"], r["dose"]): r["text"] for r in catalog.QUERIES["context_injection"](spark, d).collect()}
    assert got == {(i, n): " ".join(f"W{j}" for j in pool[i][:n]) + f"\n\nW{i}" for i, _ in rows for n in (16, 64)}
    spans = {tuple(r[c] for c in ("item_id", "source", "place", "span_start", "span_end")) for r in catalog.QUERIES["source_spans"](spark, d).collect()}
    assert spans == {(i, j, k + 1, k, k + 1) for i, p in pool.items() for k, j in enumerate(p)}


@pytest.mark.parametrize("name", ["context_injection", "source_spans"])
def test_too_few_words_are_an_error(spark, tmp_path, name):
    d = save(spark, tmp_path, "benchmark", [(i, f"W{i}") for i in range(20)], "item_id long, text string")
    with pytest.raises(Exception, match="too few context words"):
        catalog.QUERIES[name](spark, d).collect()


def test_items_inside_longer_turns(spark, tmp_path):
    items = [(0, "The quick  brown fox jumps"), (1, "big red barn"), (2, "one two three four"), (3, "Short"), (4, "two words"), (5, "  "), (6, "is nowhere in any turn"), (7, "a a a a a a")]
    turns = [(0, 0, "He said: breaTHE QUICK brown\nfox JUMPSuit!"), (0, 1, "the quick brown fox walks"), (1, 0, "big  red\tbarns"), (1, 1, "x one two three fourth"), (2, 0, "shorts and two  words"), (2, 1, None), (3, 0, "a a a a a a a"), (3, 1, "a a a a a"), (4, 0, "big  red\tbarns"), (4, 0, "big  red\tbarns")]
    save(spark, tmp_path, "benchmark", items, "item_id long, text string")
    d = save(spark, tmp_path, "conversations", turns, "conv_id long, turn long, text string")
    got = sorted(tuple(r) for r in catalog.QUERIES["contains_folded"](spark, d).collect())
    assert got == sorted((i, c, t) for i, s in items for c, t, u in turns if u is not None and fold(s) and fold(s) in fold(u))
    assert len(got) == 8


@pytest.mark.parametrize("size", [1e5, 2e6])
def test_topk_of_large_components(spark, size):
    """Components whose scaled floors lie beyond 2^24, with near ties; scores are beyond 2^53, or near 2^63."""
    import random

    from convexus.llm.topk import top_k

    deal = random.Random(5)
    rows = [(i, [deal.choice([1.0, -1.0, 0.0]) * (size + deal.randrange(3)) for _ in range(24)]) for i in range(80)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in top_k(v, v.where("vec_id < 20"), k=5, block=32).collect())
    x = {i: [math.floor(256 * c) for c in e] for i, e in rows}
    dot = lambda a, b: sum(p * q for p, q in zip(x[a], x[b], strict=True))
    want = [(q, r + 1, c, dot(q, c)) for q in range(20) for r, c in enumerate(sorted((c for c in x if c != q), key=lambda c, q=q: (-dot(q, c), c))[:5])]
    assert got == want


@pytest.mark.parametrize("size", [1e10, 1e20])
def test_topk_overflow_is_an_error(spark, size):
    """Scores, or components, that do not fit a long."""
    from convexus.llm.topk import top_k

    v = spark.createDataFrame([(i, [size, size]) for i in range(3)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="not fit a long"):
        top_k(v, v, k=2).collect()
