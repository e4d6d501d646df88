"""Composite tables: refits, selections, sensitivities and audits."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text, vectors
from ..functions.hashing import stable_key
from ..operators import ecosystem, medians, resample, solvers
from ..operators.pairs import TRIPLES, aligned_splits, pair_fits, pair_residuals, place
from ..registry import query
from ..sources.tables import table
from . import oracle
from .coverage_queries import PAIR, R9, SINGLE, peer_errors
from .fit_queries import subset_fits
from .resample_queries import DRAW, REPLICATES
from .text_queries import eligible_sources
from .vector_queries import LOGITS, SOFT, logits


@query("refit_bootstrap", "WITH " + oracle.residuals() + ", qs AS (SELECT DISTINCT category, question FROM e), " + DRAW.format(n=REPLICATES) + """,
k AS (SELECT replicate, split_seed, t, a, b, sum(m * (x[t + 1] - x[b + 1]) * (x[a + 1] - x[b + 1])) AS up, sum(m * (x[a + 1] - x[b + 1]) ** 2) AS down FROM w JOIN sp USING (category, question) JOIN mult USING (category, question), tri WHERE side = 'fit' GROUP BY ALL),
z AS (SELECT replicate, t, a, b, avg(least(greatest(up / down, 0), 1)) AS wa FROM k WHERE down > 1e-12 GROUP BY ALL)
SELECT t, a, b, round(avg(wa), 8) AS mean, round(quantile_cont(wa, 0.025), 8) AS low, round(quantile_cont(wa, 0.975), 8) AS high, count(*) AS n_replicates FROM z GROUP BY ALL""")  # fmt: skip
def refit_bootstrap(spark, sf_dir, replicates: int = REPLICATES):
    """Every replicate refits: the questions' Gram matrices are summed with multiplicities, so no replicate reads a row."""
    rows = aligned_splits(spark, sf_dir).where("side = 'fit'")
    sums = [F.sum(F.get("x", F.lit(i)) * F.get("x", F.lit(j))) for i in range(5) for j in range(i, 5)]
    per_question = rows.groupBy("split_seed", "question").agg(F.array(*sums).alias("g"))
    counts = resample.multiplicities(ecosystem.responses(spark, sf_dir).select("category", "question"), replicates, 77)
    total = per_question.join(counts.where("m > 0").select("replicate", "question", "m"), "question").groupBy("replicate", "split_seed").agg(*[F.sum(F.col("m") * F.get("g", F.lit(k))).alias(f"g{k}") for k in range(15)])
    at = lambda i, j: F.col(f"g{place(i, j, 5)}")

    def cell(t, a, b):
        down = at(a, a) - 2 * at(a, b) + at(b, b)
        w = F.when(down > 1e-12, F.least(F.greatest((at(t, a) - at(t, b) - at(a, b) + at(b, b)) / down, F.lit(0.0)), F.lit(1.0)))
        return F.struct(F.lit(t).alias("t"), F.lit(a).alias("a"), F.lit(b).alias("b"), w.alias("wa"))

    z = total.select("replicate", F.explode(F.array(*[cell(*c) for c in TRIPLES])).alias("c")).select("replicate", "c.*").where("wa IS NOT NULL").groupBy("replicate", "t", "a", "b").agg(F.avg("wa").alias("wa"))
    return z.groupBy("t", "a", "b").agg(F.round(F.avg("wa"), 8).alias("mean"), F.round(F.percentile("wa", F.lit(0.025)), 8).alias("low"), F.round(F.percentile("wa", F.lit(0.975)), 8).alias("high"), F.count("*").alias("n_replicates"))


@query("dose_specific_fit", "WITH " + oracle.residuals() + """,
k AS (SELECT split_seed, dose, t, a, b, least(greatest(sum((x[t + 1] - x[b + 1]) * (x[a + 1] - x[b + 1])) / sum((x[a + 1] - x[b + 1]) ** 2), 0), 1) AS wd FROM w JOIN sp USING (category, question), tri WHERE side = 'fit' GROUP BY ALL)
SELECT r.split_seed, r.dose, r.t, r.a, r.b, round(any_value(wd), 8) AS wa, round(avg(abs(x[t + 1] - wd * x[a + 1] - (1 - wd) * x[b + 1])), 9) AS mix_error FROM r JOIN k USING (split_seed, dose, t, a, b) WHERE side = 'eval' GROUP BY ALL""")  # fmt: skip
def dose_specific_fit(spark, sf_dir):
    """Weights refitted at each dose."""
    rows = aligned_splits(spark, sf_dir)
    fits = pair_fits(rows.where("side = 'fit'"), ["split_seed", "dose"])
    off = F.abs(F.get("x", F.col("t")) - F.col("wa") * F.get("x", F.col("a")) - (1 - F.col("wa")) * F.get("x", F.col("b")))
    return rows.where("side = 'eval'").join(fits, ["split_seed", "dose"]).groupBy("split_seed", "dose", "t", "a", "b").agg(F.round(F.first("wa"), 8).alias("wa"), R9(F.avg(off)).alias("mix_error"))


@query("modal_peer", "WITH " + SINGLE + """, s AS (SELECT split_seed, t, arg_min(p, (fit_error, p)) AS peer FROM p GROUP BY ALL), c AS (SELECT t, peer, count(*) AS n FROM s GROUP BY ALL)
SELECT t, arg_min(peer, (-n, peer)) AS modal_peer, max(n) AS n_splits, count(*) AS n_distinct, round(max(n) / sum(n), 9) AS share FROM c GROUP BY t""".replace(", s AS (SELECT split_seed, t, arg_min", ", z AS (SELECT split_seed, t, arg_min").replace("FROM s GROUP BY ALL)\nSELECT t, arg_min(peer", "FROM z GROUP BY ALL)\nSELECT t, arg_min(peer"))  # fmt: skip
def modal_peer(spark, sf_dir):
    """The peer chosen most often over splits, ties to the first, and how often."""
    s = peer_errors(spark, sf_dir).groupBy("split_seed", "t").agg(F.min_by("p", F.struct("fit_error", "p")).alias("peer"))
    c = s.groupBy("t", "peer").agg(F.count("*").alias("n"))
    return c.groupBy("t").agg(F.min_by("peer", F.struct(-F.col("n"), "peer")).alias("modal_peer"), F.max("n").alias("n_splits"), F.count("*").alias("n_distinct"), R9(F.max("n") / F.sum("n")).alias("share"))


@query("selection_frequency", "WITH " + oracle.residuals() + """, k AS (SELECT split_seed, t, a, b, round(avg(res * res) FILTER (side = 'fit'), 12) AS l FROM r GROUP BY ALL), c AS (SELECT split_seed, t, arg_min([a, b], (l, a, b)) AS chosen FROM k GROUP BY ALL)
SELECT t, unnest(chosen) AS peer, count(*) AS n, round(count(*) / 3, 9) AS frequency FROM c GROUP BY ALL""".replace("SELECT t, unnest(chosen) AS peer, count(*) AS n, round(count(*) / 3, 9) AS frequency FROM c GROUP BY ALL", "SELECT t, peer, count(*) AS n, round(count(*) / 3, 9) AS frequency FROM (SELECT t, unnest(chosen) AS peer FROM c) GROUP BY ALL"))  # fmt: skip
def selection_frequency(spark, sf_dir):
    """How often each peer is in the chosen pair."""
    k = pair_residuals(spark, sf_dir).groupBy(*PAIR).agg(F.round(F.avg(F.when(F.col("side") == "fit", F.col("res") * F.col("res"))), 12).alias("l"))
    c = k.groupBy("split_seed", "t").agg(F.min_by(F.array("a", "b"), F.struct("l", "a", "b")).alias("chosen"))
    return c.select("t", F.explode("chosen").alias("peer")).groupBy("t", "peer").agg(F.count("*").alias("n"), R9(F.count("*") / 3).alias("frequency"))


@query("best_of_others", "WITH " + SINGLE + """ SELECT split_seed, t, p, round(min(eval_error) OVER (PARTITION BY split_seed, t), 9) AS best, (round(eval_error, 9) > round(avg(eval_error) OVER (PARTITION BY split_seed, t), 9))::INTEGER AS above_mean,
  sum((p = (t + 1) % 5)::INTEGER) OVER (PARTITION BY t) AS n_sibling FROM p""")  # fmt: skip
def best_of_others(spark, sf_dir):
    """Group figures broadcast back to the rows by windows over the few peers of a target."""
    w = Window.partitionBy("split_seed", "t")
    sibling = (F.col("p") == (F.col("t") + 1) % 5).cast("long")
    return peer_errors(spark, sf_dir).select("split_seed", "t", "p", R9(F.min("eval_error").over(w)).alias("best"), (R9("eval_error") > R9(F.avg("eval_error").over(w))).cast("int").alias("above_mean"), F.sum(sibling).over(Window.partitionBy("t")).alias("n_sibling"))


@query("context_disagreement", "WITH " + SINGLE.split(",\np AS")[0] + """, d AS (SELECT category, dose, abs(x[t.i + 1] - x[p.i + 1]) AS d FROM w, range(5) t(i), range(5) p(i) WHERE t.i < p.i)
SELECT category, dose, round(avg(d), 9) AS mean, round(stddev_pop(d), 9) AS sd, round(max(d), 9) AS highest, count(*) AS n FROM d GROUP BY ALL""")  # fmt: skip
def context_disagreement(spark, sf_dir):
    """How far models differ, by context and dose; all pairs are elements of a row's array."""
    wide = ecosystem.align(ecosystem.responses(spark, sf_dir), ecosystem.MODELS, ["question", "category", "dose"])
    pairs = F.array(*[F.abs(F.get("x", F.lit(i)) - F.get("x", F.lit(j))) for i, j in itertools.combinations(range(5), 2)])
    return wide.select("category", "dose", F.explode(pairs).alias("d")).groupBy("category", "dose").agg(R9(F.avg("d")).alias("mean"), R9(F.stddev_pop("d")).alias("sd"), R9(F.max("d")).alias("highest"), F.count("*").alias("n"))


@query("job_inventory", """SELECT target.i::INTEGER AS target, family, seed, loss, sha256(concat_ws(chr(31), target.i::VARCHAR, family, seed::VARCHAR, loss)) AS job_id
FROM range(5) target(i), (VALUES ('deletion'), ('irrelevant')) f(family), (VALUES (20260828::BIGINT), (20260829)) s(seed), (VALUES ('mse'), ('mae'), ('tv')) l(loss)""")  # fmt: skip
def job_inventory(spark, sf_dir):
    """The grid of fits with stable ids."""
    rows = list(itertools.product(range(5), ("deletion", "irrelevant"), (20260828, 20260829), ("mse", "mae", "tv")))
    jobs = spark.createDataFrame(rows, "target int, family string, seed long, loss string")
    return jobs.withColumn("job_id", F.sha2(F.concat_ws("\x1f", F.col("target").cast("string"), "family", F.col("seed").cast("string"), "loss"), 256))


@query("condition_decode", """WITH c AS (SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN 'C0' WHEN 1 THEN 'I' || turn % 3 ELSE 'D' || turn % 3 END AS code FROM conversations)
SELECT conv_id, turn, code, CASE code[1:1] WHEN 'I' THEN 'irrelevant' WHEN 'D' THEN 'deletion' ELSE 'clean' END AS family, CASE WHEN code[1:1] <> 'C' THEN code[2:]::INTEGER END AS track FROM c""")  # fmt: skip
def condition_decode(spark, sf_dir):
    """Family and track of a condition's code; a clean one has no track."""
    code = F.when(F.col("conv_id") % 3 == 0, "C0").when(F.col("conv_id") % 3 == 1, F.concat(F.lit("I"), F.col("turn") % 3)).otherwise(F.concat(F.lit("D"), F.col("turn") % 3))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", code.alias("code"))
    first = F.substring("code", 1, 1)
    return c.select("*", F.when(first == "I", "irrelevant").when(first == "D", "deletion").otherwise("clean").alias("family"), F.when(first != "C", F.substring("code", 2, 9).try_cast("int")).alias("track"))


@query("generated_frequencies", "WITH " + SOFT + """, a AS (SELECT label, (list_position(p, list_max(p)) - 1)::INTEGER AS a, vec_id % 7 = 0 AS malformed FROM p)
SELECT label, i::INTEGER AS option, round(count(*) FILTER (a = i AND NOT malformed) / count(*), 9) AS frequency, round(avg(malformed::INTEGER), 9) AS malformed FROM a, range(64) r(i) GROUP BY ALL""")  # fmt: skip
def generated_frequencies(spark, sf_dir):
    """Share of each answer, with the malformed ones as mass of their own: conditional sums, then one array."""
    a = logits(spark, sf_dir).select("label", vectors.argmax(F.col("z")).alias("a"), (F.col("vec_id") % 7 == 0).alias("bad"))
    share = lambda i: F.sum(((F.col("a") == i) & ~F.col("bad")).cast("int")) / F.count("*")
    f = a.groupBy("label").agg(F.array(*[share(i) for i in range(64)]).alias("f"), R9(F.avg(F.col("bad").cast("int"))).alias("malformed"))
    return f.select("label", F.posexplode("f").alias("option", "frequency"), "malformed").select("label", "option", R9("frequency").alias("frequency"), "malformed")


@query("option_permutation_audit", "WITH " + SOFT + """, u AS (SELECT vec_id, label, i, p[i] AS a, p[((i + 2) % 64 + 1)::INTEGER] AS b FROM p, range(1, 65) q(i)), t AS (SELECT vec_id, any_value(label) AS label, 0.5 * sum(abs(a - b)) AS tv, max(a) FILTER (i = label % 64 + 1) - max(b) FILTER (i = label % 64 + 1) AS gold FROM u GROUP BY vec_id)
SELECT label, round(avg(tv), 9) AS mean_tv, round(quantile_cont(tv, 0.95), 9) AS p95_tv, round(avg(gold), 9) + 0.0 AS gold_change FROM t GROUP BY label""")  # fmt: skip
def option_permutation_audit(spark, sf_dir):
    """Distance between a row's vector and one with its options turned: mean and 95th percentile."""
    rows = logits(spark, sf_dir).select("label", vectors.softmax(F.col("z")).alias("p"))
    turned = F.transform("p", lambda x, i: F.get("p", (i + 3) % 64))
    t = rows.withColumn("q", turned).select("label", vectors.total_variation(F.col("p"), F.col("q")).alias("tv"), (F.get("p", F.col("label") % 64) - F.get("q", F.col("label") % 64)).alias("gold"))
    return t.groupBy("label").agg(R9(F.avg("tv")).alias("mean_tv"), R9(F.percentile("tv", F.lit(0.95))).alias("p95_tv"), (R9(F.avg("gold")) + 0.0).alias("gold_change"))


@query("bias_corrected_distance", "WITH " + LOGITS + """, u AS (SELECT vec_id, label, i, z[i] AS v FROM z, range(1, 65) q(i)), m AS (SELECT label, i, avg(v) AS m FROM u WHERE vec_id % 2 = 0 GROUP BY ALL),
c AS (SELECT label, i, m - avg(m) OVER (PARTITION BY label) AS bias FROM m), e AS (SELECT vec_id, label, i, exp(v) AS raw, exp(v - bias) AS fixed FROM u JOIN c USING (label, i) WHERE vec_id % 2 = 1),
n AS (SELECT *, raw / sum(raw) OVER (PARTITION BY vec_id) AS p, fixed / sum(fixed) OVER (PARTITION BY vec_id) AS q FROM e)
SELECT label, round(sum(abs(p - 0.015625)) / 2 / count(DISTINCT vec_id), 9) AS before, round(sum(abs(q - 0.015625)) / 2 / count(DISTINCT vec_id), 9) AS after FROM n GROUP BY label""")  # fmt: skip
def bias_corrected_distance(spark, sf_dir):
    """Distance to even answers before and after taking off position effects that other rows gave."""
    rows = logits(spark, sf_dir)
    cells = rows.where("vec_id % 2 = 0").groupBy("label").agg(F.array(*[F.avg(F.get("z", F.lit(i))) for i in range(64)]).alias("m"))
    bias = cells.select("label", F.transform("m", lambda x: x - vectors.total(F.col("m")) / 64).alias("bias"))
    held = rows.where("vec_id % 2 = 1").join(bias, "label")
    fixed = F.zip_with("z", "bias", lambda z, b: z - b)
    far = lambda p: vectors.total(p, lambda x: F.abs(x - 0.015625)) / 2
    held = held.select("label", vectors.softmax(F.col("z")).alias("p"), fixed.alias("f")).select("label", far(F.col("p")).alias("b"), far(vectors.softmax(F.col("f"))).alias("a"))
    return held.groupBy("label").agg(R9(F.avg("b")).alias("before"), R9(F.avg("a")).alias("after"))


@query("eligible_distractors", r"""WITH b AS (SELECT item_id, item_id % 4 AS category, trim(regexp_replace(lower(text), '[ \t\n\r\f\x0B]+', ' ', 'g')) AS f FROM benchmark)
SELECT x.item_id, y.item_id AS source FROM b x JOIN b y ON x.category <> y.category AND NOT coalesce(length(x.f) > 0 AND contains(y.f, x.f), false)""")  # fmt: skip
def eligible_distractors(spark, sf_dir):
    """Every source of another category that doesn't hold the item's text."""
    return eligible_sources(spark, sf_dir).select("item_id", "source")


@query("nan_to_null", "SELECT event_type, count(*) FILTER (event_id % 10 <> 0) AS n, round(avg(value) FILTER (event_id % 10 <> 0), 6) AS mean FROM events GROUP BY event_type")
def nan_to_null(spark, sf_dir):
    """NaN becomes null at the door, so averages skip it."""
    v = F.when(F.col("event_id") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    e = table(spark, sf_dir, "events").select("event_type", F.nanvl(v, F.lit(None).cast("double")).alias("v"))
    return e.groupBy("event_type").agg(F.count("v").alias("n"), F.round(F.avg("v"), 6).alias("mean"))


@query("tv_p2", "WITH " + SOFT + """, g AS (SELECT vec_id // 5 AS q, vec_id % 5 AS k, p FROM p), u AS (SELECT q, i, max(p[i]) FILTER (k = 0) AS y, max(p[i]) FILTER (k = 1) AS a, max(p[i]) FILTER (k = 2) AS b FROM g, range(1, 65) r(i) GROUP BY q, i HAVING count(DISTINCT k) = 5),
v AS (SELECT q, i, (y - b) / (a - b) AS v, abs(a - b) AS m FROM u WHERE a <> b), c AS (SELECT *, sum(m) OVER (ORDER BY v, q, i) AS upto, sum(m) OVER () AS whole FROM v), w AS (SELECT least(greatest(min(v) FILTER (upto >= whole / 2), 0), 1) AS w FROM c)
SELECT round(w, 9) AS weight, round(sum(0.5 * abs(y - w * a - (1 - w) * b)) / count(DISTINCT q), 9) AS mean_tv, count(DISTINCT q) AS n FROM u, w GROUP BY w""")  # fmt: skip
def tv_p2(spark, sf_dir):
    """The mixture of two peers' vectors nearest in total variation: a weighted median over all options of all questions, found bin by bin."""
    rows = logits(spark, sf_dir).select(F.floor(F.col("vec_id") / 5).alias("q"), (F.col("vec_id") % 5).alias("k"), vectors.softmax(F.col("z")).alias("p"))
    one = lambda k: F.max(F.when(F.col("k") == k, F.col("p")))
    wide = rows.groupBy("q").agg(one(0).alias("y"), one(1).alias("a"), one(2).alias("b"), F.countDistinct("k").alias("n")).where("n = 5")
    u = wide.select("q", F.posexplode(F.arrays_zip("y", "a", "b")).alias("i", "e")).select("q", "i", "e.*")
    v = u.where("a <> b").select("q", "i", ((F.col("y") - F.col("b")) / (F.col("a") - F.col("b"))).alias("v"), F.abs(F.col("a") - F.col("b")).alias("m"))
    w = medians.weighted_medians(v.withColumn("one", F.lit(1)), ["one"], "v", "m", "w").select("w")
    off = 0.5 * F.abs(F.col("y") - F.col("w") * F.col("a") - (1 - F.col("w")) * F.col("b"))
    return u.crossJoin(F.broadcast(w)).groupBy("w").agg(R9(F.first("w")).alias("weight"), R9(F.sum(off) / F.countDistinct("q")).alias("mean_tv"), F.countDistinct("q").alias("n")).drop("w")  # one row


@query("shapley_coverage")
def shapley_coverage(spark, sf_dir):
    """Exact Shapley shares of the peers in the coverage of a target, over all sets of four peers: sums over subset pairs, from the fits of every subset."""
    f = subset_fits(spark, sf_dir)
    empty = aligned_splits(spark, sf_dir).where("side = 'eval'").select("split_seed", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("target"), "x").groupBy("split_seed", "target").agg(F.avg(F.abs(F.get("x", F.col("target")))).alias("mix_error"))

    def share(pdf: pd.DataFrame) -> pd.DataFrame:
        value = {frozenset(p): -v for p, v in zip(pdf["peers"], pdf["mix_error"], strict=True)}
        peers = sorted(set().union(*value))
        n, out = len(peers), []
        for i in peers:
            rest = [j for j in peers if j != i]
            total = sum(math.factorial(k) * math.factorial(n - k - 1) / math.factorial(n) * (value[frozenset((*s, i))] - value[frozenset(s)]) for k in range(n) for s in itertools.combinations(rest, k))
            out.append((pdf["split_seed"].iloc[0], pdf["target"].iloc[0], i, float(total)))
        return pd.DataFrame(out, columns=["split_seed", "target", "peer", "share"])

    every = f.select("split_seed", "target", "peers", "mix_error").unionByName(empty.withColumn("peers", F.array().cast("array<int>")))
    return every.groupBy("split_seed", "target").applyInPandas(share, "split_seed long, target int, peer int, share double")  # 16 rows


@query("ridge_affine")
def ridge_affine(spark, sf_dir):
    """Affine ridge fits without the simplex, from Gram sums with a column of ones."""
    rows = aligned_splits(spark, sf_dir).where("side = 'fit'").withColumn("x", F.concat("x", F.array(F.lit(1.0))))
    from ..operators.gram import gram

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in pdf.iterrows():
            g = solvers.full(row["g"], 6)
            for t in range(5):
                p = [i for i in range(6) if i != t]
                w = np.linalg.solve(g[np.ix_(p, p)] + 1e-6 * np.diag([1.0] * 4 + [0.0]), g[p, t])
                out.append((row["split_seed"], t, w[:4].tolist(), float(w[4]), float(max(0.0, g[t, t] - 2 * w @ g[p, t] + w @ g[np.ix_(p, p)] @ w) / row["n"])))
        return pd.DataFrame(out, columns=["split_seed", "target", "coefficients", "intercept", "mse"])

    return gram(rows, ["split_seed"], 6).groupBy("split_seed").applyInPandas(solve, "split_seed long, target int, coefficients array<double>, intercept double, mse double")
