import numpy as np
import pytest

from convexus.llm import near_embeddings, topk

SCHEMA = "vec_id long, embedding array<double>, label int, n_links string"


def rows_of(seed=0, dims=16):
    r = np.random.default_rng(seed)
    base = r.normal(size=(30, dims))
    out, i = [], 0
    for k, b in enumerate(base):
        for _ in range(1 + k % 4):
            out.append((i, (b + 0.08 * r.normal(size=dims)).tolist(), k % 2, "x"))
            i += 1
    out += [(i, out[0][1], out[0][2], "x"), (i + 1, None, 1, "x"), (i + 2, [0.0] * dims, 1, "x"), (i + 3, [float("nan")] * dims, 0, "x"), (i + 4, [None] * dims, 0, "x"), (i + 5, out[0][1], None, "x"), (i + 6, [], 0, "x"), (i + 7, [2.0, 1.0], 0, "x"), (i + 8, [4.0, 2.0], 0, "x"), (None, out[0][1], 0, "x")]
    return out


def brute(rows, least=0.93):
    rows = [r for r in rows if r[0] is not None]
    fit = [(k, np.array(v, float) / np.abs(np.array(v, float)).max(), l) for k, (_, v, l, _) in enumerate(rows) if v and l is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, root = [0] * len(rows), list(range(len(rows)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i, a, l in fit:
        for j, b, m in fit:
            if i != j and l == m and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= least:
                links[i] += 1
                root[find(i)] = find(j)
    least_id = {}
    for k, r in enumerate(rows):
        least_id[find(k)] = min(r[0], least_id.get(find(k), r[0]))
    return sorted((r[0], links[k], least_id[find(k)]) for k, r in enumerate(rows))


def test_near_duplicates_match_brute_force(spark):
    rows = rows_of()
    got = near_embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == brute(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_keys_of_several_vectors_and_tiny_or_huge_ones(spark):
    rows = [(1, [1.0, 0.0], 0, "x"), (1, [0.0, 1.0], 0, "x"), (2, [1.0, 0.01], 0, "x"), (2, [1.0, 0.01], 0, "x"), (5, [1e-170, 0.0], 1, "x"), (4, [1e-170, 1e-172], 1, "x"), (9, [1e300, -1e300], 1, "x"), (8, [3e299, -3e299], 1, "x"), (3, [0.0, 1.0], 0, "x")]
    got = near_embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == brute(rows)


def test_a_hot_bucket_is_split_and_counts_stay_whole(spark):
    r = np.random.default_rng(1)
    base = r.normal(size=16)
    rows = [(i, (base + 0.01 * r.normal(size=16)).tolist(), 0, "x") for i in range(90)]
    got = near_embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA), chunk=20).collect()
    assert {(x["n_links"], x["component_id"]) for x in got} == {(89, 0)}


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_embeddings.near_duplicates(empty).count() == 0
    assert topk.top_k(empty, empty).count() == 0


def test_recall_at_the_threshold():
    r = np.random.default_rng(2)
    a = r.normal(size=(3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    z = r.normal(size=a.shape)
    z -= a * (a * z).sum(1, keepdims=True)
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * z
    h = near_embeddings.CrossPolytope(64)
    x, y = h.codes(a), h.codes(b)
    met = (x == y[:, :, :1]).any(2) | (y == x[:, :, :1]).any(2)
    assert met.any(1).mean() > 0.999


@pytest.mark.parametrize("block", [7, 1000])
def test_top_k_matches_brute_force(spark, block):
    rows = rows_of(3)
    df = spark.createDataFrame(rows, SCHEMA)
    got = topk.top_k(df, df.where("vec_id % 3 = 0"), k=4, query_block=block, block=block).collect()
    fit = {i: np.floor(256 * np.array(v, float)).astype(int) for i, v, _, _ in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q, x in fit.items():
        if q % 3 == 0:
            best = sorted((-int(x @ y), c) for c, y in fit.items() if c != q and len(y) == len(x))[:4]
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(want)


def test_top_k_with_repeated_ids_and_very_large_components(spark):
    rows = [(0, [1.0, 2.0], 0, "x"), (0, [1.0, 2.0], 0, "x"), (1, [3.0, 1.0], 0, "x"), (1, [0.5, 9.0], 0, "x"), (2, [1e5, 0.0], 0, "x"), (3, [1e5, 1.0], 0, "x"), (3, [1e5, 1.0], 0, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = topk.top_k(df, df.where("vec_id IN (0, 2)"), k=4).collect()
    want, asked = [], {(i, tuple(v)) for i, v, _, _ in rows if i in (0, 2)}
    for q, v in asked:
        whole = lambda x: [int(np.floor(256 * c)) for c in x]
        best = sorted((-sum(a * b for a, b in zip(whole(v), whole(w), strict=True)), c) for c, w, _, _ in rows if c != q)[:4]
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(want)
    assert any(r["score"] == 655360000000000 for r in got)
