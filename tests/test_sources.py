import pytest
from pyspark.sql import functions as F

from convexus.operators import ecosystem, resample, splits
from convexus.sources import tables
from convexus.streaming import windows


def test_lines_round_trip_and_digest(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", None), (1, "a", 0.1)], "k int, s string, v double")
    tables.write_lines(df, str(tmp_path / "l"), "k")
    back = tables.read_lines(spark, str(tmp_path / "l"), df.schema)
    assert sorted(back.collect()) == sorted(df.collect(), key=lambda r: r["k"])
    assert tables.table_digest(back).collect() == tables.table_digest(df.repartition(3)).collect()
    assert tables.table_digest(df.limit(0)).first()["n_rows"] == 0


def test_csv_and_parquet_are_exact(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.1 + 0.2), (2, 1e-300)], "k int, v double")
    tables.write_csv(df, str(tmp_path / "c"))
    assert spark.read.schema(df.schema).option("header", True).csv(str(tmp_path / "c")).exceptAll(df).isEmpty()
    tables.write_parquet(df, str(tmp_path / "p"), "k")
    assert spark.read.parquet(str(tmp_path / "p")).select("k", "v").exceptAll(df).isEmpty()


def test_shards_are_checked(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "s"))
    name = next(p.name for p in (tmp_path / "s").iterdir() if p.suffix == ".parquet")
    good = spark.createDataFrame([(name, 10)], "file string, rows long")
    assert tables.verified_shards(spark, str(tmp_path / "s"), "id long", good).count() == 10
    bad = spark.createDataFrame([(name, 11)], "file string, rows long")
    with pytest.raises(Exception, match="manifest"):
        tables.verified_shards(spark, str(tmp_path / "s"), "id long", bad).collect()


def test_inventory(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.txt").write_text("a")
    before = tables.file_inventory(spark, str(tmp_path / "f"))
    first = before.collect()
    (tmp_path / "f" / "b.txt").write_text("b")
    after = tables.file_inventory(spark, str(tmp_path / "f"))
    old = spark.createDataFrame(first, before.schema)
    assert [r["status"] for r in tables.inventory_diff(old, after, "path", "sha256").collect()] == ["added"]
    assert len(tables.tree_digest(after, str(tmp_path / "f")).first()["digest"]) == 64


def test_alignment_leaves_out_incomplete_and_repeated(spark):
    rows = [("a", 1, 0.1), ("b", 1, 0.2), ("a", 2, 0.3), ("a", 3, 0.1), ("b", 3, 0.2), ("b", 3, 0.4), ("a", 4, None), ("b", 4, 1.0)]
    out = ecosystem.align(spark.createDataFrame(rows, "model string, k int, response double"), ["a", "b"], ["k"])
    assert [(r["k"], list(r["x"])) for r in out.collect()] == [(1, [0.1, 0.2])]


def test_strict_split_raises_on_odd(spark):
    df = spark.createDataFrame([("c", "1"), ("c", "2"), ("c", "3")], "category string, question string")
    sides = [r["side"] for r in splits.half_split(df, [1]).collect()]
    assert sides.count("fit") == 1
    with pytest.raises(Exception, match="odd"):
        splits.half_split(df, [1], strict=True).collect()


def test_bootstrap_keeps_zeros_and_raises_without_mass(spark):
    df = spark.createDataFrame([("c", str(i)) for i in range(6)], "category string, question string")
    m = resample.multiplicities(df, 20, 5)
    assert m.count() == 120 and m.where("m = 0").count() > 0
    assert {r["s"] for r in m.groupBy("replicate").agg(F.sum("m").alias("s")).collect()} == {6}
    nothing = m.withColumn("m", F.lit(0))
    with pytest.raises(Exception, match="no mass"):
        resample.weighted_means(df.withColumn("v", F.lit(1.0)), nothing, [], "v").collect()


def test_stream_resumes(spark, tmp_path):
    schema = "k string, ts timestamp, v double"
    add = lambda n, day, v: spark.createDataFrame([("a", f"2024-01-{day:02d} 01:00:00", v)], "k string, ts string, v double").select("k", F.col("ts").cast("timestamp"), "v").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    folder = str(tmp_path / "state")
    run = lambda: {(str(r["window_start"])[:10], r["n"], r["s1"]) for r in windows.run_to_end(windows.window_moments(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), ["k"], "ts", "v"), ["k", "window_start"], folder).collect()}
    add(1, 2, 1.0)
    assert run() == {("2024-01-02", 1, 1.0)}
    add(2, 2, 2.0)
    add(3, 3, 5.0)
    assert run() == {("2024-01-02", 2, 3.0), ("2024-01-03", 1, 5.0)}


def test_shards_are_checked_before_use(spark, tmp_path):
    from convexus.sources import shards

    df = spark.range(100).selectExpr("id", "CAST(id AS string) AS s", "id / 7.0 AS x")
    paths = [str(tmp_path / f"s{k}") for k in range(2)]
    for p in paths:
        shards.write_shard(df, p, "1")
    assert shards.read_shards(spark, paths, df.schema, "1").count() == 200
    assert shards.shard_state(spark, paths[0], df.schema, "2") == "version"
    assert shards.shard_state(spark, str(tmp_path / "none"), df.schema, "1") == "absent"
    df.limit(99).write.mode("overwrite").parquet(f"{paths[0]}/rows")
    assert shards.shard_state(spark, paths[0], df.schema, "1") == "rows"
    df.withColumn("s", F.lit("other")).write.mode("overwrite").parquet(f"{paths[0]}/rows")
    assert shards.shard_state(spark, paths[0], df.schema, "1") == "digest"
    with pytest.raises(ValueError, match="digest"):
        shards.read_shards(spark, paths, df.schema, "1")
    import shutil

    shutil.rmtree(f"{paths[1]}/mark")
    assert shards.shard_state(spark, paths[1], df.schema, "1") == "unmarked"
    assert shards.row_digests(df.limit(3)).select("row_sha256").distinct().count() == 3


def test_batches_halve_when_memory_runs_out():
    import pandas as pd

    from convexus.operators.batches import halving

    def fits(part):
        if len(part) > 6:
            raise MemoryError
        return part["v"].sum()

    frame = pd.DataFrame({"v": range(20)})
    found = list(halving(fits, frame, 16))
    assert [a for a, _ in found] == [0, 4, 8, 12, 16] and sum(x for _, x in found) == 190
    with pytest.raises(MemoryError):
        list(halving(lambda part: (_ for _ in ()).throw(MemoryError()), frame, 4))
