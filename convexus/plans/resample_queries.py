"""Bootstrap queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ecosystem, resample
from ..operators.pairs import pair_residuals
from ..registry import query
from ..sources.tables import table
from . import oracle

DRAW = """ids AS (SELECT category, question, row_number() OVER (PARTITION BY category ORDER BY question) - 1 AS i, count(*) OVER (PARTITION BY category) AS n FROM qs),
slots AS (SELECT *, ('0x' || sha256(concat_ws(chr(31), '77', replicate::VARCHAR, category, i::VARCHAR))[1:7])::BIGINT % n AS pick FROM ids, range({n}) q(replicate)),
mult AS (SELECT s.replicate::INTEGER AS replicate, s.category, s.question, (SELECT count(*) FROM slots d WHERE d.replicate = s.replicate AND d.category = s.category AND d.pick = s.i) AS m FROM slots s)"""  # fmt: skip


@query("bootstrap_multiplicities", "WITH qs AS (SELECT DISTINCT p_type AS category, p_brand AS question FROM part), " + DRAW.format(n=10) + " SELECT replicate, category, question, m FROM mult")
def bootstrap_multiplicities(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_type").alias("category"), F.col("p_brand").alias("question"))
    return resample.multiplicities(rows, 10, 77)


#: Replicates of the bootstrap queries.
REPLICATES = 1000
BOOT = oracle.residuals() + """, qs AS (SELECT DISTINCT category, question FROM e), """ + DRAW.format(n=REPLICATES) + """,
l AS (SELECT split_seed, t, a, b, question, avg(abs(x[t + 1] - x[a + 1])) - avg(abs(res)) AS gain FROM r WHERE side = 'eval' GROUP BY ALL),
v AS (SELECT replicate, t, a, b, split_seed, sum(m * gain) / sum(m) AS gain FROM l JOIN mult USING (question) GROUP BY ALL), k AS (SELECT replicate, t, a, b, avg(gain) AS gain FROM v GROUP BY ALL)"""  # fmt: skip


def replicate_gains(spark, sf_dir, replicates: int = REPLICATES):
    rows = pair_residuals(spark, sf_dir).where("side = 'eval'")
    gain = F.avg(F.abs(F.get("x", F.col("t")) - F.get("x", F.col("a")))) - F.avg(F.abs("res"))
    losses = rows.groupBy("split_seed", "t", "a", "b", "question").agg(gain.alias("gain"))
    counts = resample.multiplicities(ecosystem.responses(spark, sf_dir).select("category", "question"), replicates, 77)
    return resample.weighted_means(losses, counts, ["split_seed", "t", "a", "b"], "gain").groupBy("replicate", "t", "a", "b").agg(F.avg("gain").alias("gain"))


@query("frozen_fit_intervals", "WITH " + BOOT + """
SELECT t, a, b, round(avg(gain), 9) AS mean, round(quantile_cont(gain, 0.5), 9) AS median, round(quantile_cont(gain, 0.025), 9) AS low, round(quantile_cont(gain, 0.975), 9) AS high,
  round(avg((gain > 1e-12)::INTEGER), 6) AS p_positive, round(avg((gain < -1e-12)::INTEGER), 6) AS p_negative, count(*) AS n_replicates FROM k GROUP BY ALL""")  # fmt: skip
def frozen_fit_intervals(spark, sf_dir):
    """Percentile intervals of the gain over peer a, with the fits held fixed."""
    values = replicate_gains(spark, sf_dir).withColumn("gain", F.when(F.abs("gain") > 1e-12, F.col("gain")).otherwise(0.0))
    s = resample.summary(values, ["t", "a", "b"], "gain")
    return s.select("t", "a", "b", *[F.round(c, 9).alias(c) for c in ("mean", "median", "low", "high")], *[F.round(c, 6).alias(c) for c in ("p_positive", "p_negative")], "n_replicates")


@query("claim_gates", "WITH " + BOOT + """, s AS (SELECT t, a, b, avg(gain) AS mean, quantile_cont(gain, 0.025) AS low, quantile_cont(gain, 0.975) AS high FROM k GROUP BY ALL), p AS (SELECT t, a, b, count(*) FILTER (gain > 1e-12) AS n_up FROM (SELECT split_seed, t, a, b, avg(gain) AS gain FROM l GROUP BY ALL) GROUP BY ALL)
SELECT t, a, b, n_up, CASE WHEN mean > 0 AND low > 1e-12 AND n_up = 3 THEN 'LOCKED' WHEN mean > 1e-12 AND n_up >= 2 THEN 'QUALIFIED' WHEN mean > 1e-12 THEN 'RAW_ONLY' ELSE 'NOT_SUPPORTED' END AS claim FROM s JOIN p USING (t, a, b)""".replace(", s AS (SELECT t, a, b, avg", ", z AS (SELECT t, a, b, avg").replace("FROM s JOIN p", "FROM z JOIN p"))  # fmt: skip
def claim_gates(spark, sf_dir):
    """Point sign, interval and agreement of the splits together decide what is claimed."""
    z = resample.summary(replicate_gains(spark, sf_dir), ["t", "a", "b"], "gain")
    rows = pair_residuals(spark, sf_dir).where("side = 'eval'").groupBy("split_seed", "t", "a", "b", "question").agg((F.avg(F.abs(F.get("x", F.col("t")) - F.get("x", F.col("a")))) - F.avg(F.abs("res"))).alias("gain"))
    p = rows.groupBy("split_seed", "t", "a", "b").agg(F.avg("gain").alias("gain")).groupBy("t", "a", "b").agg(F.sum((F.col("gain") > 1e-12).cast("long")).alias("n_up"))
    claim = F.when((F.col("mean") > 0) & (F.col("low") > 1e-12) & (F.col("n_up") == 3), "LOCKED").when((F.col("mean") > 1e-12) & (F.col("n_up") >= 2), "QUALIFIED").when(F.col("mean") > 1e-12, "RAW_ONLY").otherwise("NOT_SUPPORTED")
    return z.join(p, ["t", "a", "b"]).select("t", "a", "b", "n_up", claim.alias("claim"))
