import pytest
from pyspark.sql import functions as F

from convexus.functions import hashing, text
from convexus.operators import checks, ecosystem, gram, solvers
from convexus.catalog import QUERIES
from convexus.sources import staging, tables


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, v long")


def test_merges_refuse_repeats(spark):
    left, right = frame(spark, [(1, 1), (2, 2), (None, 3)]), frame(spark, [(1, 10), (2, 20), (2, 21)]).withColumnRenamed("v", "w")
    assert checks.merge(left, right, ["k"], "1:m").count() == 3
    with pytest.raises(Exception, match="right: a key is repeated"):
        checks.merge(left, right, ["k"], "1:1").collect()
    with pytest.raises(Exception, match="left: a key is repeated"):
        checks.merge(right, left, ["k"], "1:m").collect()
    assert checks.merge(left, right.where("w <> 21"), ["k"], "1:1", "left").count() == 3
    with pytest.raises(ValueError):
        checks.merge(left, right, ["k"], "m:m")


def test_require_raises(spark):
    assert checks.require(frame(spark, [(1, 1)]), F.col("v") > 0, "bad").count() == 1
    for bad in (0, None):
        with pytest.raises(Exception, match="v must be positive"):
            checks.require(frame(spark, [(1, bad)]), F.col("v") > 0, "v must be positive").collect()


def test_grid_gaps(spark):
    seen, grid = frame(spark, [(1, 1), (1, 1), (2, 1), (9, 9)]), frame(spark, [(1, 1), (2, 1), (3, 1)])
    assert {(r["k"], r["n"]) for r in checks.grid_gaps(seen, grid, ["k", "v"]).collect()} == {(1, 2), (3, 0), (9, -1)}


def test_answer_ladder_and_buckets(spark):
    rows = [
        ("Answer: A. Final answer (b)", "B", "explicit_final_answer"),
        ("the answer is\nC", "C", "explicit_final_answer"),
        ("I think (d), no: a!", "A", "final_standalone_label"),
        ("<think>B</think> E", "B", "final_standalone_label"),
        ("nothing here", None, "unresolved"),
        ("answer " + "x" * 5000, None, "unresolved"),
        ("", None, "unresolved"),
        (None, None, "unresolved"),
    ]
    df = spark.createDataFrame(rows, "t string, label string, method string")
    label, method = text.final_label(F.col("t"), 4)
    for r in df.select("label", "method", label.alias("l"), method.alias("m")).collect():
        assert (r["l"], r["m"]) == (r["label"], r["method"])
    assert [r["b"] for r in spark.range(5, 18).select(text.bucket_length(F.col("id")).alias("b")).collect()] == ["short"] * 3 + ["medium"] * 8 + ["long"] * 2
    sentiment = spark.createDataFrame([(p,) for p in (0.0, 0.2, 0.21, 0.79, 0.8)], "p double").select(text.bucket_sentiment(F.col("p")).alias("b")).collect()
    assert [r["b"] for r in sentiment] == ["negative", "negative", "ambiguous", "ambiguous", "positive"]
    negated = spark.createDataFrame([(t,) for t in ("not so", "it is Not so", "why not", "nothing", "isn't", "notable", "no.", "a\nnot b")], "t string").select(text.has_negation(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in negated] == [True, True, True, False, True, False, False, False]


def test_readers_and_keys(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("a\tb\n1\tx\n2\ty\n")
    assert [tuple(r) for r in tables.read_tsv(spark, str(tmp_path / "m.tsv"), "a int, b string").collect()] == [(1, "x"), (2, "y")]
    import hashlib

    key = spark.range(1).select(hashing.stable_u64("5", "a").alias("u")).first()["u"]
    assert int(key) == int(hashlib.sha256(b"5\x1fa").hexdigest()[:16], 16)


def test_row_weights_and_weighted_grams(spark):
    df = spark.createDataFrame([("q", d, t, [1.0 * t, 2.0]) for d in range(2) for t in ((0,) if d == 0 else (0, 1, 2))], "q string, dose int, t int, x array<double>")
    g = gram.gram(df.withColumn("w", ecosystem.row_weights(F.col("dose"))), ["q"], 2, weight="w").first()
    assert g["mass"] == pytest.approx(2.0) and g["g"] == pytest.approx([(0 + 1 + 4) / 3, (0 + 2 + 4) / 3, 8.0])
    w, _ = solvers.simplex_qp(solvers.full(g["g"], 2) + 1e-9 * __import__("numpy").eye(2), __import__("numpy").array([0.0, 1.0]))
    assert w.sum() == pytest.approx(1.0)


def test_a_query_scans_line_items_once(spark, sf_dir):
    for name in ("residual_p2", "mae_p2", "estimand_decomposition", "frozen_fit_intervals", "claim_gates", "refit_intervals"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "l_partkey" not in plan and "p_brand" not in plan


def test_staging_is_for_one_query(spark):
    made = []
    make = lambda: made.append(1) or spark.range(3).toDF("x")
    with staging.scope():
        assert staging.staged(spark, ("a",), make).count() == staging.staged(spark, ("a",), make).count() == 3
    assert len(made) == 1
    with staging.scope():
        staging.staged(spark, ("a",), make)
    assert staging.staged(spark, ("a",), make).count() == 3 and len(made) == 3
