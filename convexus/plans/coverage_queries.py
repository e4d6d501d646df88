"""Queries over the coverage of one model by its peers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ecosystem, medians, splits
from ..operators.pairs import N_FITS, SEEDS, aligned_splits, pair_fits, pair_residuals
from ..registry import query
from ..sources.tables import table
from . import oracle

R9 = lambda c: F.round(c, 9)
PAIR = ["split_seed", "t", "a", "b"]


@query("eco_alignment", "WITH " + oracle.wide() + """
SELECT question, category, dose, round(x[1], 9) AS africa, round(x[2], 9) AS america, round(x[3], 9) AS asia, round(x[4], 9) AS europe, round(x[5], 9) AS middle_east FROM w""")  # fmt: skip
def eco_alignment(spark, sf_dir):
    wide = ecosystem.align(ecosystem.responses(spark, sf_dir), ecosystem.MODELS, ["question", "category", "dose"])
    return wide.select("question", "category", "dose", *[R9(F.get("x", F.lit(i))).alias(n) for i, n in enumerate(("africa", "america", "asia", "europe", "middle_east"))])


@query("eco_completeness", "WITH " + oracle.e() + """
SELECT dose, count(DISTINCT question) AS questions, count(*) AS cells, (count(DISTINCT question) * 5 - count(*))::BIGINT AS missing FROM e GROUP BY dose""")  # fmt: skip
def eco_completeness(spark, sf_dir):
    e = ecosystem.responses(spark, sf_dir)
    return e.groupBy("dose").agg(F.countDistinct("question").alias("questions"), F.count("*").alias("cells"), (F.countDistinct("question") * 5 - F.count("*")).alias("missing"))


@query("expected_inventory", "WITH " + oracle.e() + """
SELECT m.model, q.question, d.dose, CASE WHEN e.response IS NULL THEN 'missing' ELSE 'present' END AS status
FROM (SELECT DISTINCT model FROM e) m, (SELECT DISTINCT question FROM e) q, (SELECT DISTINCT dose FROM e) d LEFT JOIN e ON e.model = m.model AND e.question = q.question AND e.dose = d.dose""")  # fmt: skip
def expected_inventory(spark, sf_dir):
    """The product of models, questions and doses (5 x 25 x 7) against what is there."""
    e = ecosystem.responses(spark, sf_dir)
    sides = [e.select(c).distinct() for c in ("model", "question", "dose")]
    grid = sides[0].crossJoin(F.broadcast(sides[1])).crossJoin(F.broadcast(sides[2]))
    return grid.join(e.select("model", "question", "dose", "response"), ["model", "question", "dose"], "left").select("model", "question", "dose", F.when(F.col("response").isNull(), "missing").otherwise("present").alias("status"))


@query("hash_half_split", """
SELECT split_seed, p_brand AS category, p_partkey, CASE WHEN row_number() OVER (PARTITION BY split_seed, p_brand
  ORDER BY sha256(concat_ws(chr(31), split_seed::VARCHAR, p_brand, p_partkey::VARCHAR))[1:16], p_partkey) <= count(*) OVER (PARTITION BY split_seed, p_brand) // 2 THEN 'fit' ELSE 'eval' END AS side
FROM part, (VALUES (20260828::BIGINT), (20260829)) s(split_seed)""")  # fmt: skip
def hash_half_split(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("category"), "p_partkey")
    return splits.half_split(rows, SEEDS[:2], key="p_partkey")


@query("split_manifest", "WITH " + oracle.e() + ", " + oracle.SPLITS + """
SELECT split_seed, category, count(*) FILTER (side = 'fit') AS n_fit, count(*) FILTER (side = 'eval') AS n_eval,
  coalesce(string_agg(question, ',' ORDER BY question) FILTER (side = 'fit'), '') AS fit_questions FROM sp GROUP BY ALL""")  # fmt: skip
def split_manifest(spark, sf_dir):
    """Questions per side; a category has a bounded number of questions here (brands of a maker)."""
    sp = splits.half_split(ecosystem.responses(spark, sf_dir).select("category", "question"), SEEDS)
    fit = F.when(F.col("side") == "fit", F.col("question"))
    return sp.groupBy("split_seed", "category").agg(F.count(fit).alias("n_fit"), F.sum((F.col("side") == "eval").cast("long")).alias("n_eval"), F.array_join(F.array_sort(F.collect_list(fit)), ",").alias("fit_questions"))


@query("split_overlap", "WITH " + oracle.e() + ", " + oracle.SPLITS + """
SELECT l.split_seed AS seed_a, r.split_seed AS seed_b, count(*) AS common FROM sp l JOIN sp r USING (category, question) WHERE l.side = 'fit' AND r.side = 'fit' AND l.split_seed < r.split_seed GROUP BY ALL""")  # fmt: skip
def split_overlap(spark, sf_dir):
    sp = splits.half_split(ecosystem.responses(spark, sf_dir).select("category", "question"), SEEDS).where("side = 'fit'")
    l, r = sp.select(F.col("split_seed").alias("seed_a"), "question", "category"), sp.select(F.col("split_seed").alias("seed_b"), "question", "category")
    return l.join(r, ["question", "category"]).where("seed_a < seed_b").groupBy("seed_a", "seed_b").agg(F.count("*").alias("common"))


@query("stratified_sample", """
SELECT o_orderkey, o_orderpriority, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256(concat_ws(chr(31), '7', o_orderpriority, o_orderkey::VARCHAR))[1:16], o_orderkey) AS place FROM orders) WHERE place <= 40""")  # fmt: skip
def stratified_sample(spark, sf_dir):
    """The 40 first orders of each priority in hash order (a sampling operator; the window keeps the first 40 of each task only)."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return splits.stratified_sample(rows, 40, 7, "o_orderpriority", "o_orderkey")


SINGLE = oracle.wide() + ", " + oracle.SPLITS + """,
p AS (SELECT split_seed, t::INTEGER AS t, p::INTEGER AS p, round(avg(abs(x[t + 1] - x[p + 1])) FILTER (side = 'fit'), 12) AS fit_error, avg(abs(x[t + 1] - x[p + 1])) FILTER (side = 'eval') AS eval_error
  FROM w JOIN sp USING (category, question), range(5) q(t), range(5) u(p) WHERE t <> p GROUP BY ALL)"""  # fmt: skip


def peer_errors(spark, sf_dir):
    """Mean |target - peer| on either side, for all pairs, in one aggregation."""
    rows = aligned_splits(spark, sf_dir)
    cells = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("p"), F.abs(F.get("x", F.lit(t)) - F.get("x", F.lit(p))).alias("d")) for t in range(5) for p in range(5) if t != p])
    rows = rows.select("split_seed", "side", F.explode(cells).alias("c")).select("split_seed", "side", "c.*")
    on = lambda s: F.avg(F.when(F.col("side") == s, F.col("d")))
    return rows.groupBy("split_seed", "t", "p").agg(F.round(on("fit"), 12).alias("fit_error"), on("eval").alias("eval_error"))


@query("single_peer_select", "WITH " + SINGLE + """
SELECT split_seed, t, arg_min(p, (fit_error, p)) AS peer, round(min(fit_error), 9) AS fit_error, round(arg_min(eval_error, (fit_error, p)), 9) AS eval_error FROM p GROUP BY ALL""")  # fmt: skip
def single_peer_select(spark, sf_dir):
    """The peer with the least error on the fitting side (ties to the first), and its error on the other."""
    order = F.struct("fit_error", "p")
    return peer_errors(spark, sf_dir).groupBy("split_seed", "t").agg(F.min_by("p", order).alias("peer"), R9(F.min("fit_error")).alias("fit_error"), R9(F.min_by("eval_error", order)).alias("eval_error"))


@query("pairwise_baseline", "WITH " + SINGLE + " SELECT split_seed, t, p, round(eval_error, 9) AS eval_error, rank() OVER (PARTITION BY split_seed, t ORDER BY round(eval_error, 12))::INTEGER AS place FROM p")
def pairwise_baseline(spark, sf_dir):
    w = Window.partitionBy("split_seed", "t").orderBy(F.round("eval_error", 12))
    return peer_errors(spark, sf_dir).select("split_seed", "t", "p", R9("eval_error").alias("eval_error"), F.rank().over(w).alias("place"))


@query("directional_pairs", "WITH " + SINGLE + """
SELECT l.split_seed, l.t, l.p, round(l.eval_error - r.eval_error, 9) + 0.0 AS difference, sign(round(l.fit_error - r.fit_error, 9))::INTEGER AS fit_sign FROM p l JOIN p r ON l.split_seed = r.split_seed AND l.t = r.p AND l.p = r.t""")  # fmt: skip
def directional_pairs(spark, sf_dir):
    """(target, partner) against (partner, target)."""
    e = peer_errors(spark, sf_dir)
    back = e.select("split_seed", F.col("t").alias("p"), F.col("p").alias("t"), F.col("fit_error").alias("f2"), F.col("eval_error").alias("e2"))
    return e.join(back, ["split_seed", "t", "p"]).select("split_seed", "t", "p", (R9(F.col("eval_error") - F.col("e2")) + 0.0).alias("difference"), F.signum(R9(F.col("fit_error") - F.col("f2"))).cast("int").alias("fit_sign"))


@query("uniform_oracle_baselines", "WITH " + oracle.wide() + ", " + oracle.SPLITS + """
SELECT split_seed, t::INTEGER AS t, round(avg(abs(x[t + 1] - (list_sum(x) - x[t + 1]) / 4)), 9) AS uniform_error,
  round(avg(list_min(list_transform(list_concat(x[1:t], x[t + 2:5]), lambda v: abs(v - x[t + 1])))), 9) AS oracle_error, count(*) AS n
FROM w JOIN sp USING (category, question), range(5) q(t) WHERE side = 'eval' GROUP BY ALL""")  # fmt: skip
def uniform_oracle_baselines(spark, sf_dir):
    """The mean of the peers, and the best peer of each row."""
    rows = aligned_splits(spark, sf_dir).where("side = 'eval'").select("split_seed", "x", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("t"))
    y = F.get("x", F.col("t"))
    others = F.filter("x", lambda v, i: i != F.col("t"))
    mean = F.aggregate("x", F.lit(0.0), lambda s, v: s + v) - y
    return rows.groupBy("split_seed", "t").agg(R9(F.avg(F.abs(y - mean / 4))).alias("uniform_error"), R9(F.avg(F.array_min(F.transform(others, lambda v: F.abs(v - y))))).alias("oracle_error"), F.count("*").alias("n"))


@query("residual_p2", "WITH " + oracle.residuals() + """,
d AS (SELECT split_seed, t, a, b, any_value(wa) AS wa, avg(abs(res)) FILTER (side = 'eval') AS mix_error, avg(abs(res)) FILTER (side = 'fit') AS fit_error,
  avg(abs(x[t + 1] - x[a + 1])) FILTER (side = 'eval') AS ea, avg(abs(x[t + 1] - x[b + 1])) FILTER (side = 'eval') AS eb,
  round(avg(abs(x[t + 1] - x[a + 1])) FILTER (side = 'fit'), 12) AS fa, round(avg(abs(x[t + 1] - x[b + 1])) FILTER (side = 'fit'), 12) AS fb, count(*) FILTER (side = 'eval') AS n FROM r GROUP BY ALL)
SELECT split_seed, t, a, b, round(wa, 9) AS wa, round(mix_error, 9) AS mix_error, round(fit_error, 9) AS fit_error, CASE WHEN fa <= fb THEN a ELSE b END AS single,
  round(CASE WHEN fa <= fb THEN ea ELSE eb END, 9) AS single_error, round(CASE WHEN fa <= fb THEN ea ELSE eb END - mix_error, 9) AS gain, n FROM d""")  # fmt: skip
def residual_p2(spark, sf_dir):
    """Held-out error of the best mixture of two peers, against the peer that fits best alone."""
    r = pair_residuals(spark, sf_dir)
    off = lambda p: F.abs(F.get("x", F.col("t")) - F.get("x", F.col(p)))
    on = lambda s, v: F.avg(F.when(F.col("side") == s, v))
    d = r.groupBy(*PAIR).agg(F.first("wa").alias("wa"), on("eval", F.abs("res")).alias("mix_error"), on("fit", F.abs("res")).alias("fit_error"), on("eval", off("a")).alias("ea"), on("eval", off("b")).alias("eb"), F.round(on("fit", off("a")), 12).alias("fa"), F.round(on("fit", off("b")), 12).alias("fb"), F.sum((F.col("side") == "eval").cast("long")).alias("n"))
    first = F.col("fa") <= F.col("fb")
    single = F.when(first, F.col("ea")).otherwise(F.col("eb"))
    return d.select(*PAIR, R9("wa").alias("wa"), R9("mix_error").alias("mix_error"), R9("fit_error").alias("fit_error"), F.when(first, F.col("a")).otherwise(F.col("b")).alias("single"), R9(single).alias("single_error"), R9(single - F.col("mix_error")).alias("gain"), "n")


@query("dose_trajectory", "WITH " + oracle.residuals() + """, d AS (SELECT split_seed, t, a, b, dose, avg(abs(res)) AS mix_error, count(DISTINCT question) AS n FROM r WHERE side = 'eval' GROUP BY ALL)
SELECT t, a, b, dose, round(avg(mix_error), 9) AS mix_error, sum(n)::BIGINT AS n FROM d GROUP BY ALL""")  # fmt: skip
def dose_trajectory(spark, sf_dir):
    """Held-out error at each dose, averaged over splits."""
    d = pair_residuals(spark, sf_dir).where("side = 'eval'").groupBy(*PAIR, "dose").agg(F.avg(F.abs("res")).alias("mix_error"), F.countDistinct("question").alias("n"))
    return d.groupBy("t", "a", "b", "dose").agg(R9(F.avg("mix_error")).alias("mix_error"), F.sum("n").alias("n"))


@query("equal_dose_overall", "WITH " + oracle.residuals() + """, d AS (SELECT split_seed, t, a, b, dose, avg(abs(res)) AS mix_error, count(*) AS n FROM r WHERE side = 'eval' GROUP BY ALL)
SELECT split_seed, t, a, b, round(avg(mix_error), 9) AS equal_dose, round(sum(mix_error * n) / sum(n), 9) AS pooled FROM d GROUP BY ALL""")  # fmt: skip
def equal_dose_overall(spark, sf_dir):
    """The mean of the doses' means, beside the pooled mean; the two are different estimands."""
    d = pair_residuals(spark, sf_dir).where("side = 'eval'").groupBy(*PAIR, "dose").agg(F.avg(F.abs("res")).alias("mix_error"), F.count("*").alias("n"))
    return d.groupBy(*PAIR).agg(R9(F.avg("mix_error")).alias("equal_dose"), R9(F.sum(F.col("mix_error") * F.col("n")) / F.sum("n")).alias("pooled"))


ENDPOINT = oracle.residuals() + """, q AS (SELECT split_seed, t, a, b, avg(abs(res)) FILTER (dose = 0) AS clean, avg(abs(res)) FILTER (dose = 6) AS high FROM r WHERE side = 'eval' GROUP BY ALL)"""


def endpoints(spark, sf_dir):
    rows = pair_residuals(spark, sf_dir).where("side = 'eval'")
    at = lambda d: F.avg(F.when(F.col("dose") == d, F.abs("res")))
    return rows.groupBy(*PAIR).agg(at(0).alias("clean"), at(6).alias("high"))


@query("endpoint_delta", "WITH " + ENDPOINT + " SELECT split_seed, t, a, b, round(clean, 9) AS clean, round(high, 9) AS high, round(high - clean, 9) AS delta, round((high - clean) / (clean + 1e-10), 6) AS relative FROM q")
def endpoint_delta(spark, sf_dir):
    """High dose minus clean, by conditional aggregation in one pass."""
    q, d = endpoints(spark, sf_dir), F.col("high") - F.col("clean")
    return q.select(*PAIR, R9("clean").alias("clean"), R9("high").alias("high"), R9(d).alias("delta"), F.round(d / (F.col("clean") + 1e-10), 6).alias("relative"))


@query("split_effect_summary", "WITH " + ENDPOINT + """
SELECT t, a, b, round(avg(high - clean), 9) AS mean, round(median(high - clean), 9) AS median, round(stddev_samp(high - clean), 9) AS sd, round(min(high - clean), 9) AS low, round(max(high - clean), 9) AS high,
  count(*) FILTER (high - clean > 1e-12) AS n_positive, count(*) FILTER (high - clean < -1e-12) AS n_negative FROM q GROUP BY ALL""")  # fmt: skip
def split_effect_summary(spark, sf_dir):
    q = endpoints(spark, sf_dir).withColumn("d", F.col("high") - F.col("clean"))
    return q.groupBy("t", "a", "b").agg(R9(F.avg("d")).alias("mean"), R9(F.median("d")).alias("median"), R9(F.stddev_samp("d")).alias("sd"), R9(F.min("d")).alias("low"), R9(F.max("d")).alias("high"), F.sum((F.col("d") > 1e-12).cast("long")).alias("n_positive"), F.sum((F.col("d") < -1e-12).cast("long")).alias("n_negative"))


@query("stability_labels", "WITH " + ENDPOINT + """, u AS (SELECT t, a, b, quantile_cont(high - clean, 0.025) AS lo, quantile_cont(high - clean, 0.975) AS hi, count(*) FILTER (high > clean) AS pos, count(*) FILTER (high < clean) AS neg FROM q GROUP BY ALL)
SELECT t, a, b, round(lo, 9) AS lo, round(hi, 9) AS hi, CASE WHEN greatest(pos, neg) >= 3 AND (lo > 0 OR hi < 0) THEN 'stable' ELSE 'unstable' END AS label,
  CASE WHEN lo > 0 AND pos >= 3 THEN 'LOCKED' WHEN pos >= 2 AND hi > 0 THEN 'QUALIFIED' WHEN pos >= 1 THEN 'RAW_ONLY' ELSE 'NOT_SUPPORTED' END AS claim FROM u""")  # fmt: skip
def stability_labels(spark, sf_dir):
    """Stable where all splits agree and the interval excludes zero; claims by sign, interval and splits."""
    d = F.col("high") - F.col("clean")
    s = endpoints(spark, sf_dir).groupBy("t", "a", "b").agg(F.percentile(d, F.lit(0.025)).alias("lo"), F.percentile(d, F.lit(0.975)).alias("hi"), F.sum((d > 0).cast("long")).alias("pos"), F.sum((d < 0).cast("long")).alias("neg"))
    label = F.when((F.greatest("pos", "neg") >= 3) & ((F.col("lo") > 0) | (F.col("hi") < 0)), "stable").otherwise("unstable")
    claim = F.when((F.col("lo") > 0) & (F.col("pos") >= 3), "LOCKED").when((F.col("pos") >= 2) & (F.col("hi") > 0), "QUALIFIED").when(F.col("pos") >= 1, "RAW_ONLY").otherwise("NOT_SUPPORTED")
    return s.select("t", "a", "b", R9("lo").alias("lo"), R9("hi").alias("hi"), label.alias("label"), claim.alias("claim"))


@query("trackwise_cancellation", "WITH " + oracle.residuals("track") + """,
m AS (SELECT split_seed, t, a, b, question, dose, avg(abs(res)) AS each, abs(avg(res)) AS whole FROM r WHERE side = 'eval' GROUP BY ALL)
SELECT split_seed, t, a, b, round(avg(each), 9) AS trackwise, round(avg(whole), 9) AS of_mean, round(avg(each) - avg(whole), 9) AS cancellation FROM m GROUP BY ALL""")  # fmt: skip
def trackwise_cancellation(spark, sf_dir):
    """Mean |residual| over tracks against |mean residual|: the difference can't be negative."""
    m = pair_residuals(spark, sf_dir, "track").where("side = 'eval'").groupBy(*PAIR, "question", "dose").agg(F.avg(F.abs("res")).alias("each"), F.abs(F.avg("res")).alias("whole"))
    return m.groupBy(*PAIR).agg(R9(F.avg("each")).alias("trackwise"), R9(F.avg("whole")).alias("of_mean"), R9(F.avg("each") - F.avg("whole")).alias("cancellation"))


@query("peer_removal_influence", "WITH " + oracle.residuals() + """,
i AS (SELECT split_seed, t, a, b, avg(abs(res)) AS mix_error, avg(abs(x[t + 1] - x[a + 1])) AS without_b, avg(abs(x[t + 1] - x[b + 1])) AS without_a FROM r WHERE side = 'eval' GROUP BY ALL),
l AS (SELECT split_seed, t, a AS removed, b AS other, round(without_a - mix_error, 9) AS inflation FROM i UNION ALL SELECT split_seed, t, b, a, round(without_b - mix_error, 9) FROM i)
SELECT split_seed, t, removed, other, inflation, rank() OVER (PARTITION BY split_seed, t ORDER BY inflation DESC)::INTEGER AS influence_rank, count(*) OVER (PARTITION BY split_seed, t, inflation) AS ties FROM l""")  # fmt: skip
def peer_removal_influence(spark, sf_dir):
    """What removing either peer of a pair adds to the error, ranked within the target."""
    r = pair_residuals(spark, sf_dir).where("side = 'eval'")
    off = lambda p: F.avg(F.abs(F.get("x", F.col("t")) - F.get("x", F.col(p))))
    i = r.groupBy(*PAIR).agg(F.avg(F.abs("res")).alias("mix_error"), off("a").alias("wb"), off("b").alias("wa"))
    l = i.select("split_seed", "t", F.explode(F.array(F.struct(F.col("a").alias("removed"), F.col("b").alias("other"), R9(F.col("wa") - F.col("mix_error")).alias("inflation")), F.struct(F.col("b").alias("removed"), F.col("a").alias("other"), R9(F.col("wb") - F.col("mix_error")).alias("inflation")))).alias("c")).select("split_seed", "t", "c.*")
    w = Window.partitionBy("split_seed", "t")
    return l.select("*", F.rank().over(w.orderBy(F.desc("inflation"))).alias("influence_rank"), F.count("*").over(Window.partitionBy("split_seed", "t", "inflation")).alias("ties"))


@query("null_rank", "WITH " + SINGLE + """, o AS (SELECT split_seed, t, p, round(eval_error, 9) AS v FROM p)
SELECT l.split_seed, l.t, l.p, 1 + count(*) FILTER (r.v > l.v) AS place, round(avg(CASE WHEN r.v <= l.v THEN 1.0 ELSE 0.0 END), 9) AS percentile FROM o l JOIN o r ON l.split_seed = r.split_seed AND l.t = r.t GROUP BY ALL""")  # fmt: skip
def null_rank(spark, sf_dir):
    """A value's place and percentile within its group, by counts over the sorted group."""
    o = peer_errors(spark, sf_dir).select("split_seed", "t", "p", R9("eval_error").alias("v"))
    w = Window.partitionBy("split_seed", "t")
    upto = F.count("*").over(w.orderBy("v").rangeBetween(Window.unboundedPreceding, 0))
    return o.select("split_seed", "t", "p", F.rank().over(w.orderBy(F.desc("v"))).cast("long").alias("place"), R9(upto / F.count("*").over(w)).alias("percentile"))


@query("estimand_decomposition", "WITH " + oracle.residuals("track") + """,
g AS (SELECT question, category, dose, [avg(x[1]), avg(x[2]), avg(x[3]), avg(x[4]), avg(x[5])] AS x FROM w GROUP BY ALL),
fa AS (SELECT split_seed, t, a, b, least(greatest(sum((x[t + 1] - x[b + 1]) * (x[a + 1] - x[b + 1])) / sum((x[a + 1] - x[b + 1]) ** 2), 0), 1) AS wg FROM g JOIN sp USING (category, question), tri WHERE side = 'fit' GROUP BY ALL),
k AS (SELECT split_seed, question, dose, t, a, b, avg(abs(res)) AS tt, abs(avg(res)) AS ta, avg(abs(x[t + 1] - wg * x[a + 1] - (1 - wg) * x[b + 1])) AS at_, abs(avg(x[t + 1] - wg * x[a + 1] - (1 - wg) * x[b + 1])) AS aa FROM r JOIN fa USING (split_seed, t, a, b) WHERE side = 'eval' GROUP BY ALL)
SELECT split_seed, t, a, b, round(avg(aa), 9) AS aggregate_aggregate, round(avg(at_), 9) AS aggregate_trackwise, round(avg(ta), 9) AS trackwise_aggregate, round(avg(tt), 9) AS trackwise_trackwise,
  round(avg(at_) - avg(aa), 9) AS evaluation_term, round(avg(ta) - avg(aa), 9) + 0.0 AS fitting_term, round(avg(tt) - avg(ta) - avg(at_) + avg(aa), 9) + 0.0 AS interaction_term FROM k GROUP BY ALL""")  # fmt: skip
def estimand_decomposition(spark, sf_dir):
    """Fit on (aggregate, trackwise) responses by evaluation on (aggregate, trackwise), and the terms between."""
    rows = aligned_splits(spark, sf_dir, "track")
    fit = rows.where("side = 'fit'")
    mean = F.array(*[F.avg(F.get("x", F.lit(i))) for i in range(5)])
    each = pair_fits(fit, ["split_seed"]).withColumnRenamed("wa", "wt")
    whole = pair_fits(fit.groupBy("split_seed", "question", "category", "dose").agg(mean.alias("x")), ["split_seed"]).withColumnRenamed("wa", "wg")
    joined = rows.where("side = 'eval'").join(medians.small(each.join(whole, PAIR), N_FITS), "split_seed")
    res = lambda w: F.get("x", F.col("t")) - F.col(w) * F.get("x", F.col("a")) - (1 - F.col(w)) * F.get("x", F.col("b"))
    k = joined.groupBy(*PAIR, "question", "dose").agg(F.avg(F.abs(res("wt"))).alias("tt"), F.abs(F.avg(res("wt"))).alias("ta"), F.avg(F.abs(res("wg"))).alias("at"), F.abs(F.avg(res("wg"))).alias("aa"))
    m = k.groupBy(*PAIR).agg(*[F.avg(c).alias(c) for c in ("aa", "at", "ta", "tt")])
    c = F.col
    return m.select(*PAIR, R9("aa").alias("aggregate_aggregate"), R9("at").alias("aggregate_trackwise"), R9("ta").alias("trackwise_aggregate"), R9("tt").alias("trackwise_trackwise"), R9(c("at") - c("aa")).alias("evaluation_term"), (R9(c("ta") - c("aa")) + 0.0).alias("fitting_term"), (R9(c("tt") - c("ta") - c("at") + c("aa")) + 0.0).alias("interaction_term"))


@query("design_transfer", "WITH " + oracle.residuals("", "dose <= 2") + """,
h AS (SELECT split_seed, t, a, b, least(greatest(sum((x[t + 1] - x[b + 1]) * (x[a + 1] - x[b + 1])) / sum((x[a + 1] - x[b + 1]) ** 2), 0), 1) AS wh FROM w JOIN sp USING (category, question), tri WHERE side = 'fit' AND dose >= 4 GROUP BY ALL)
SELECT split_seed, t, a, b, round(avg(abs(res)), 9) AS transferred, round(avg(abs(x[t + 1] - wh * x[a + 1] - (1 - wh) * x[b + 1])), 9) AS native,
  round(avg(abs(res)) - avg(abs(x[t + 1] - wh * x[a + 1] - (1 - wh) * x[b + 1])), 9) + 0.0 AS penalty, round(2 * abs(any_value(wa) - any_value(wh)), 9) AS weight_change FROM r JOIN h USING (split_seed, t, a, b) WHERE side = 'eval' AND dose >= 4 GROUP BY ALL""")  # fmt: skip
def design_transfer(spark, sf_dir):
    """Weights of low doses judged at high doses, against weights fitted there."""
    rows = pair_residuals(spark, sf_dir, fit_when=F.col("dose") <= 2)
    own = pair_fits(aligned_splits(spark, sf_dir).where("side = 'fit' AND dose >= 4"), ["split_seed"]).withColumnRenamed("wa", "wh")
    j = rows.where("side = 'eval' AND dose >= 4").join(medians.small(own, N_FITS), PAIR)
    there = F.avg(F.abs(F.get("x", F.col("t")) - F.col("wh") * F.get("x", F.col("a")) - (1 - F.col("wh")) * F.get("x", F.col("b"))))
    here = F.avg(F.abs("res"))
    return j.groupBy(*PAIR).agg(R9(here).alias("transferred"), R9(there).alias("native"), (R9(here - there) + 0.0).alias("penalty"), R9(2 * F.abs(F.first("wa") - F.first("wh"))).alias("weight_change"))


@query("subset_policies", "WITH " + oracle.residuals() + """, k AS (SELECT split_seed, t, a, b, round(avg(res * res) FILTER (side = 'fit'), 12) AS fit_loss, avg(abs(res)) FILTER (side = 'eval') AS mix_error FROM r GROUP BY ALL)
SELECT split_seed, t, arg_min(a * 10 + b, (fit_loss, a, b))::INTEGER AS collective, round(arg_min(mix_error, (fit_loss, a, b)), 9) AS collective_error, round(avg(mix_error), 9) AS random_expected, round(min(mix_error), 9) AS best_possible, count(*) AS n_subsets FROM k GROUP BY ALL""")  # fmt: skip
def subset_policies(spark, sf_dir):
    """Pairs chosen on the fitting side (ties to the first subset), against the mean over all pairs."""
    k = pair_residuals(spark, sf_dir).groupBy(*PAIR).agg(F.round(F.avg(F.when(F.col("side") == "fit", F.col("res") * F.col("res"))), 12).alias("fit_loss"), F.avg(F.when(F.col("side") == "eval", F.abs("res"))).alias("mix_error"))
    order = F.struct("fit_loss", "a", "b")
    return k.groupBy("split_seed", "t").agg(F.min_by(F.col("a") * 10 + F.col("b"), order).alias("collective"), R9(F.min_by("mix_error", order)).alias("collective_error"), R9(F.avg("mix_error")).alias("random_expected"), R9(F.min("mix_error")).alias("best_possible"), F.count("*").alias("n_subsets"))


@query("strategy_summary", "WITH " + oracle.residuals() + """, k AS (SELECT split_seed, t, a, b, round(avg(res * res) FILTER (side = 'fit'), 12) AS fit_loss, avg(abs(res)) FILTER (side = 'eval') AS mix_error FROM r GROUP BY ALL),
c AS (SELECT split_seed, t, arg_min(mix_error, (fit_loss, a, b)) AS collective, avg(mix_error) AS random FROM k GROUP BY ALL)
SELECT t, round(avg(collective), 9) AS collective, round(avg(random), 9) AS random, round(avg(random) - avg(collective), 9) AS gain, round(100 * (avg(random) - avg(collective)) / nullif(avg(random), 0), 6) AS gain_percent FROM c GROUP BY t""")  # fmt: skip
def strategy_summary(spark, sf_dir):
    k = pair_residuals(spark, sf_dir).groupBy(*PAIR).agg(F.round(F.avg(F.when(F.col("side") == "fit", F.col("res") * F.col("res"))), 12).alias("fit_loss"), F.avg(F.when(F.col("side") == "eval", F.abs("res"))).alias("mix_error"))
    c = k.groupBy("split_seed", "t").agg(F.min_by("mix_error", F.struct("fit_loss", "a", "b")).alias("c"), F.avg("mix_error").alias("r"))
    gain = F.avg("r") - F.avg("c")
    return c.groupBy("t").agg(R9(F.avg("c")).alias("collective"), R9(F.avg("r")).alias("random"), R9(gain).alias("gain"), F.round(100 * F.try_divide(gain, F.avg("r")), 6).alias("gain_percent"))


@query("roster_expansion", "WITH " + oracle.residuals() + """, k AS (SELECT split_seed, t, a, b, avg(abs(res)) AS mix_error, avg(abs(x[t + 1] - x[a + 1])) AS old FROM r WHERE side = 'eval' GROUP BY ALL)
SELECT t, a, b, round(avg(old), 9) AS old_panel, round(avg(mix_error), 9) AS expanded_panel, round(avg(mix_error) - avg(old), 9) AS change, count(*) FILTER (mix_error < old - 1e-12) AS n_better FROM k GROUP BY ALL""")  # fmt: skip
def roster_expansion(spark, sf_dir):
    """One peer, then the panel with a second one."""
    k = pair_residuals(spark, sf_dir).where("side = 'eval'").groupBy(*PAIR).agg(F.avg(F.abs("res")).alias("mix_error"), F.avg(F.abs(F.get("x", F.col("t")) - F.get("x", F.col("a")))).alias("old"))
    return k.groupBy("t", "a", "b").agg(R9(F.avg("old")).alias("old_panel"), R9(F.avg("mix_error")).alias("expanded_panel"), R9(F.avg("mix_error") - F.avg("old")).alias("change"), F.sum((F.col("mix_error") < F.col("old") - 1e-12).cast("long")).alias("n_better"))


@query("mae_p2", "WITH " + oracle.residuals() + """,
q AS (SELECT split_seed, t, a, b, (x[t + 1] - x[b + 1]) / (x[a + 1] - x[b + 1]) AS v, abs(x[a + 1] - x[b + 1]) AS m, question, dose FROM r WHERE side = 'fit' AND x[a + 1] <> x[b + 1]),
c AS (SELECT *, sum(m) OVER (PARTITION BY split_seed, t, a, b ORDER BY v, question, dose) AS upto, sum(m) OVER (PARTITION BY split_seed, t, a, b) AS whole FROM q),
z AS (SELECT split_seed, t, a, b, least(greatest(min(v) FILTER (upto >= whole / 2), 0), 1) AS wl FROM c GROUP BY ALL)
SELECT split_seed, t, a, b, round(any_value(wl), 9) AS wa, round(avg(abs(x[t + 1] - wl * x[a + 1] - (1 - wl) * x[b + 1])) FILTER (side = 'fit'), 9) AS fit_mae,
  round(avg(abs(x[t + 1] - wl * x[a + 1] - (1 - wl) * x[b + 1])) FILTER (side = 'eval'), 9) AS eval_mae FROM r JOIN z USING (split_seed, t, a, b) GROUP BY ALL""")  # fmt: skip
def mae_p2(spark, sf_dir):
    """The absolute-loss fit of two peers: a weighted median of ratios."""
    r = pair_residuals(spark, sf_dir)
    y, a, b = (F.get("x", F.col(c)) for c in ("t", "a", "b"))
    q = r.where("side = 'fit'").select(*PAIR, "question", "dose", ((y - b) / F.nullif(a - b, F.lit(0.0))).alias("v"), F.abs(a - b).alias("m")).where("v IS NOT NULL")
    z = medians.weighted_medians(q, PAIR, "v", "m", "wl")
    off = F.abs(y - F.col("wl") * a - (1 - F.col("wl")) * b)
    on = lambda s: R9(F.avg(F.when(F.col("side") == s, off)))
    return r.join(medians.small(z, N_FITS), PAIR).groupBy(*PAIR).agg(R9(F.first("wl")).alias("wa"), on("fit").alias("fit_mae"), on("eval").alias("eval_mae"))


@query("residual_mass_curve", "WITH " + oracle.residuals() + """, o AS (SELECT split_seed, t, a, b, question, dose, round(abs(res), 12) AS v FROM r WHERE side = 'eval'),
k AS (SELECT *, row_number() OVER (PARTITION BY split_seed, t, a, b ORDER BY v DESC, question, dose) AS place, sum(v) OVER (PARTITION BY split_seed, t, a, b ORDER BY v DESC, question, dose) AS upto,
  sum(v) OVER (PARTITION BY split_seed, t, a, b) AS whole, count(*) OVER (PARTITION BY split_seed, t, a, b) AS n FROM o)
SELECT split_seed, t, a, b, question, dose, place::INTEGER AS place, round(v, 9) AS v, round(upto / nullif(whole, 0), 9) AS share, round(place / n, 9) AS fraction FROM k""")  # fmt: skip
def residual_mass_curve(spark, sf_dir):
    """What share of all residual mass the largest residuals hold, for every split, target and pair; the share is null where all residuals are zero."""
    o = pair_residuals(spark, sf_dir).where("side = 'eval'").select(*PAIR, "question", "dose", F.round(F.abs("res"), 12).alias("v"))
    w = Window.partitionBy(*PAIR)
    down = w.orderBy(F.desc("v"), "question", "dose")
    k = o.select(*PAIR, "question", "dose", F.row_number().over(down).alias("place"), "v", F.sum("v").over(down.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("v").over(w).alias("whole"), F.count("*").over(w).alias("n"))
    return k.select(*PAIR, "question", "dose", "place", R9("v").alias("v"), R9(F.try_divide("upto", "whole")).alias("share"), R9(F.col("place") / F.col("n")).alias("fraction"))


@query("topk_overlap", "WITH " + oracle.residuals() + """, v AS (SELECT split_seed, t, question, dose, round(avg(abs(res)), 12) AS v FROM r WHERE side = 'eval' GROUP BY ALL),
o AS (SELECT split_seed, t, question, dose, row_number() OVER (PARTITION BY split_seed, t ORDER BY v DESC, question, dose) AS place FROM v),
j AS (SELECT split_seed, l.t AS t1, r.t AS t2, greatest(l.place, r.place) AS depth FROM o l JOIN o r USING (split_seed, question, dose) WHERE l.t < r.t)
SELECT split_seed, t1, t2, n::INTEGER AS k, (count(*) FILTER (depth <= n))::INTEGER AS common FROM j, range(1, 41) q(n) GROUP BY split_seed, t1, t2, n""")  # fmt: skip
def topk_overlap(spark, sf_dir):
    """For k = 1..40, how many of the k largest residuals of two targets are the same rows, in every split."""
    o = pair_residuals(spark, sf_dir).where("side = 'eval'").groupBy("split_seed", "t", "question", "dose").agg(F.round(F.avg(F.abs("res")), 12).alias("v"))
    o = o.withColumn("place", F.row_number().over(Window.partitionBy("split_seed", "t").orderBy(F.desc("v"), "question", "dose")))
    keys = ["split_seed", "question", "dose"]
    l, r = o.select(*keys, F.col("t").alias("t1"), F.col("place").alias("p1")), o.select(*keys, F.col("t").alias("t2"), F.col("place").alias("p2"))
    j = l.join(r, keys).where("t1 < t2").withColumn("k0", F.greatest("p1", "p2"))
    common = j.groupBy("split_seed", "t1", "t2").agg(F.array(*[F.sum((F.col("k0") <= k).cast("int")).cast("int") for k in range(1, 41)]).alias("c"))
    return common.select("split_seed", "t1", "t2", F.posexplode("c").alias("i", "common")).select("split_seed", "t1", "t2", (F.col("i") + 1).alias("k"), "common")


@query("avg_rank_spearman", "WITH " + SINGLE + """, k AS (SELECT split_seed, t, p, rank() OVER w + (count(*) OVER (PARTITION BY split_seed, round(eval_error, 9)) - 1) / 2 AS r FROM p WINDOW w AS (PARTITION BY split_seed ORDER BY round(eval_error, 9)))
SELECT l.split_seed AS seed_a, r.split_seed AS seed_b, round(corr(l.r, r.r), 9) AS spearman FROM k l JOIN k r USING (t, p) WHERE l.split_seed < r.split_seed GROUP BY ALL""")  # fmt: skip
def avg_rank_spearman(spark, sf_dir):
    """Rank correlation of the peers' errors between splits, with average ranks for ties."""
    p = peer_errors(spark, sf_dir).withColumn("v", R9("eval_error"))
    k = p.select("split_seed", "t", "p", (F.rank().over(Window.partitionBy("split_seed").orderBy("v")) + (F.count("*").over(Window.partitionBy("split_seed", "v")) - 1) / 2).alias("r"))
    l, r = k.select(F.col("split_seed").alias("seed_a"), "t", "p", F.col("r").alias("ra")), k.select(F.col("split_seed").alias("seed_b"), "t", "p", F.col("r").alias("rb"))
    return l.join(r, ["t", "p"]).where("seed_a < seed_b").groupBy("seed_a", "seed_b").agg(R9(F.corr("ra", "rb")).alias("spearman"))


@query("router_mae", "WITH " + oracle.residuals() + """, m AS (SELECT split_seed, t, a, b, avg(abs(res)) AS mae, avg(x[t + 1]) AS level FROM r WHERE side = 'eval' GROUP BY ALL)
SELECT t, round(avg(mae), 9) AS mae, round(avg(level), 9) AS level, round(avg(mae) / nullif(avg(level), 0), 9) AS ratio, round(corr(mae, level), 6) AS correlation FROM m GROUP BY t""")  # fmt: skip
def router_mae(spark, sf_dir):
    """Error of the convex router against the level of the target."""
    m = pair_residuals(spark, sf_dir).where("side = 'eval'").groupBy(*PAIR).agg(F.avg(F.abs("res")).alias("mae"), F.avg(F.get("x", F.col("t"))).alias("level"))
    return m.groupBy("t").agg(R9(F.avg("mae")).alias("mae"), R9(F.avg("level")).alias("level"), R9(F.try_divide(F.avg("mae"), F.avg("level"))).alias("ratio"), F.round(F.corr("mae", "level"), 6).alias("correlation"))


@query("context_residual_summary", "WITH " + oracle.residuals() + """
SELECT category, t, dose, round(avg(abs(res)), 9) AS mean_error, round(stddev_pop(abs(res)), 9) AS sd_error, count(*) FILTER (side = 'eval') AS n_eval, count(*) FILTER (side = 'fit') AS n_fit FROM r GROUP BY ALL""")  # fmt: skip
def context_residual_summary(spark, sf_dir):
    r = pair_residuals(spark, sf_dir)
    return r.groupBy("category", "t", "dose").agg(R9(F.avg(F.abs("res"))).alias("mean_error"), R9(F.stddev_pop(F.abs("res"))).alias("sd_error"), F.sum((F.col("side") == "eval").cast("long")).alias("n_eval"), F.sum((F.col("side") == "fit").cast("long")).alias("n_fit"))
