"""Gates, audits and report tables over the coverage of models by their peers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.hashing import stable_key
from ..operators import checks, ecosystem, resample
from ..operators.pairs import aligned_splits, pair_fits, pair_residuals
from ..registry import query
from ..sources.tables import table
from . import oracle
from .coverage_queries import ENDPOINT, PAIR, R9, SINGLE, endpoints, peer_errors
from .resample_queries import DRAW

ERR = "round(avg(abs(res)), 9)"
EVAL = "WITH " + oracle.residuals()


def held_out(spark, sf_dir, *extra):
    return pair_residuals(spark, sf_dir, *extra).where("side = 'eval'")


@query("endpoint_merge", "WITH " + ENDPOINT + " SELECT split_seed, t, a, b, round(high - clean, 9) AS delta FROM q WHERE clean IS NOT NULL AND high IS NOT NULL")
def endpoint_merge(spark, sf_dir):
    """High against clean rows, joined one to one on the fit."""
    rows = held_out(spark, sf_dir)
    at = lambda d, name: rows.where(F.col("dose") == d).groupBy(*PAIR).agg(F.avg(F.abs("res")).alias(name))
    return checks.merge(at(0, "clean"), at(6, "high"), PAIR, "1:1").select(*PAIR, R9(F.col("high") - F.col("clean")).alias("delta"))


@query("summary_merge", EVAL + """, sm AS (SELECT t, avg(abs(res)) AS mean FROM r WHERE side = 'eval' GROUP BY t), d AS (SELECT t, a, b, dose, avg(abs(res)) AS err FROM r WHERE side = 'eval' GROUP BY ALL)
SELECT t, a, b, dose, round(err - mean, 9) AS above FROM d JOIN sm USING (t)""")  # fmt: skip
def summary_merge(spark, sf_dir):
    """A target's mean back on its rows, joined many to one."""
    rows = held_out(spark, sf_dir)
    d = rows.groupBy("t", "a", "b", "dose").agg(F.avg(F.abs("res")).alias("err"))
    return checks.merge(d, rows.groupBy("t").agg(F.avg(F.abs("res")).alias("mean")), ["t"], "m:1").select("t", "a", "b", "dose", R9(F.col("err") - F.col("mean")).alias("above"))


@query("contrast_groups", EVAL + """, d AS (SELECT split_seed, t, a, b, avg(abs(x[t + 1] - x[a + 1])) - avg(abs(res)) AS c FROM r WHERE side = 'eval' GROUP BY ALL)
SELECT t, a, b, count(*) AS n_splits, count(*) = 3 AS complete, round(avg(c), 9) AS contrast, round(max(c) - min(c), 9) AS reach FROM d GROUP BY ALL""")  # fmt: skip
def contrast_groups(spark, sf_dir):
    """Baseline less mixture by fit, and whether all splits are there."""
    rows = held_out(spark, sf_dir)
    d = rows.groupBy(*PAIR).agg((F.avg(F.abs(F.get("x", F.col("t")) - F.get("x", F.col("a")))) - F.avg(F.abs("res"))).alias("c"))
    return d.groupBy("t", "a", "b").agg(F.count("*").alias("n_splits"), (F.count("*") == 3).alias("complete"), R9(F.avg("c")).alias("contrast"), R9(F.max("c") - F.min("c")).alias("reach"))


@query("relative_omissions", "WITH " + ENDPOINT + """, v AS (SELECT split_seed, t, a, b, dose, avg(abs(res)) AS e FROM r WHERE side = 'eval' GROUP BY ALL),
m AS (SELECT t, a, b, split_seed, avg(e) FILTER (dose = 6) / nullif(avg(e) FILTER (dose = split_seed % 3 * 4), 0) AS ratio FROM v GROUP BY ALL)
SELECT t, a, b, count(ratio) AS n_defined, CASE WHEN count(ratio) = count(*) THEN 'kept' ELSE 'a replicate is not finite' END AS reason, round(CASE WHEN count(ratio) = count(*) THEN avg(ratio) END, 6) AS ratio FROM m GROUP BY ALL""")  # fmt: skip
def relative_omissions(spark, sf_dir):
    """Ratios to a reference dose (one that some splits lack): a contrast with any undefined replicate is left out, with the reason."""
    v = held_out(spark, sf_dir).groupBy(*PAIR, "dose").agg(F.avg(F.abs("res")).alias("e"))
    at = lambda d: F.avg(F.when(F.col("dose") == d, F.col("e")))
    m = v.groupBy(*PAIR).agg(at(6).alias("high"), at(F.col("split_seed") % 3 * 4).alias("low")).withColumn("ratio", F.try_divide("high", F.when(F.col("low") != 0, F.col("low"))))
    whole = F.count("ratio") == F.count("*")
    return m.groupBy("t", "a", "b").agg(F.count("ratio").alias("n_defined"), F.when(whole, "kept").otherwise("a replicate is not finite").alias("reason"), F.round(F.when(whole, F.avg("ratio")), 6).alias("ratio"))


@query("extension_summary", EVAL + """, d AS (SELECT split_seed, t, a, b, avg(abs(x[t + 1] - x[a + 1])) AS base, avg(abs(res)) AS mix FROM r WHERE side = 'eval' GROUP BY ALL)
SELECT t, a, b, round(avg(base), 9) AS base, round(avg(mix), 9) AS mix, round(100 * (avg(base) - avg(mix)) / avg(base), 6) AS percent, count(*) FILTER (base - mix > 1e-12) AS n_positive, count(*) FILTER (base - mix < -1e-12) AS n_negative,
  count(*) FILTER (abs(base - mix) <= 1e-12) AS n_zero FROM d GROUP BY ALL""")  # fmt: skip
def extension_summary(spark, sf_dir):
    """Means over splits, their ratio in percent, and signs with a band about zero."""
    d = held_out(spark, sf_dir).groupBy(*PAIR).agg(F.avg(F.abs(F.get("x", F.col("t")) - F.get("x", F.col("a")))).alias("base"), F.avg(F.abs("res")).alias("mix")).withColumn("d", F.col("base") - F.col("mix"))
    n = lambda c: F.sum(c.cast("long"))
    return d.groupBy("t", "a", "b").agg(R9(F.avg("base")).alias("base"), R9(F.avg("mix")).alias("mix"), F.round(100 * (F.avg("base") - F.avg("mix")) / F.avg("base"), 6).alias("percent"), n(F.col("d") > 1e-12).alias("n_positive"), n(F.col("d") < -1e-12).alias("n_negative"), n(F.abs("d") <= 1e-12).alias("n_zero"))


@query("interval_selector", "WITH " + ENDPOINT + """, u AS (SELECT t, a, b, quantile_cont(high - clean, 0.025) AS low, quantile_cont(high - clean, 0.975) AS high FROM q GROUP BY ALL)
SELECT t, round(low, 9) AS low, round(high, 9) AS high FROM u WHERE a = CASE WHEN t = 0 THEN 1 ELSE 0 END AND b = 4 AND t <> 4 OR t = 4 AND a = 0 AND b = 1""")  # fmt: skip
def interval_selector(spark, sf_dir):
    """Of each target's intervals the one of a named pair, which must be unique."""
    d = F.col("high") - F.col("clean")
    u = endpoints(spark, sf_dir).groupBy("t", "a", "b").agg(R9(F.percentile(d, F.lit(0.025))).alias("low"), R9(F.percentile(d, F.lit(0.975))).alias("high"))
    named = spark.createDataFrame([(0, 1, 4), (1, 0, 4), (2, 0, 4), (3, 0, 4), (4, 0, 1)], "t int, a int, b int")
    return checks.merge(named, u, ["t", "a", "b"], "1:1").select("t", "low", "high")


@query("target_summary", "WITH " + ENDPOINT + """, m AS (SELECT t, a, b, avg(high - clean) AS delta, avg(clean) AS clean FROM q GROUP BY ALL)
SELECT t, round(avg(delta), 9) AS mean_delta, arg_max(a * 10 + b, (round(delta, 9), -(a * 10 + b))) AS pair_of_most, round(max(delta), 9) AS most, round(min(clean), 9) AS least_clean FROM m GROUP BY t""")  # fmt: skip
def target_summary(spark, sf_dir):
    """Each target's mean effect, the pair under which it is largest (ties to the first) and its least clean error."""
    m = endpoints(spark, sf_dir).groupBy("t", "a", "b").agg(F.avg(F.col("high") - F.col("clean")).alias("delta"), F.avg("clean").alias("clean")).withColumn("pair", F.col("a") * 10 + F.col("b"))
    return m.groupBy("t").agg(R9(F.avg("delta")).alias("mean_delta"), F.max_by("pair", F.struct(R9("delta"), -F.col("pair"))).alias("pair_of_most"), R9(F.max("delta")).alias("most"), R9(F.min("clean")).alias("least_clean"))


@query("weight_rank", EVAL + """, l AS (SELECT split_seed, t, a, b, p, round(CASE WHEN p = a THEN wa ELSE 1 - wa END, 9) AS w FROM f, range(5) k(p) WHERE p = a OR p = b),
m AS (SELECT split_seed, t, p::INTEGER AS p, round(avg(w), 9) AS weight FROM l GROUP BY ALL) SELECT split_seed, t, p, weight, rank() OVER (PARTITION BY split_seed, t ORDER BY weight DESC)::INTEGER AS place FROM m""")  # fmt: skip
def weight_rank(spark, sf_dir):
    """Every peer's mean weight over the pairs it is in, in long form, and its rank."""
    fits = pair_fits(aligned_splits(spark, sf_dir).where("side = 'fit'"), ["split_seed"])
    sides = F.array(F.struct(F.col("a").alias("p"), R9("wa").alias("w")), F.struct(F.col("b").alias("p"), R9(1 - F.col("wa")).alias("w")))
    m = fits.select("split_seed", "t", F.explode(sides).alias("s")).groupBy("split_seed", "t", "s.p").agg(R9(F.avg("s.w")).alias("weight"))
    return m.select("*", F.rank().over(Window.partitionBy("split_seed", "t").orderBy(F.desc("weight"))).alias("place"))


@query("stored_weights_audit", EVAL + """ SELECT split_seed, count(*) AS n_fits, round(min(least(wa, 1 - wa)), 9) AS min_weight, round(max(abs(wa + (1 - wa) - 1)), 12) AS sum_error, count(*) FILTER (isfinite(wa)) AS n_finite FROM f GROUP BY split_seed""")
def stored_weights_audit(spark, sf_dir):
    fits = pair_fits(aligned_splits(spark, sf_dir).where("side = 'fit'"), ["split_seed"]).withColumn("wb", 1 - F.col("wa"))
    finite = ~F.isnan("wa") & (F.abs("wa") < float("inf"))
    return fits.groupBy("split_seed").agg(F.count("*").alias("n_fits"), R9(F.min(F.least("wa", "wb"))).alias("min_weight"), F.round(F.max(F.abs(F.col("wa") + F.col("wb") - 1)), 12).alias("sum_error"), F.sum(finite.cast("long")).alias("n_finite"))


@query("weight_ambiguity", EVAL + """, g AS (SELECT split_seed, t, a, b, any_value(wa) AS wa, avg(res * res) AS loss, avg((x[a + 1] - x[b + 1]) ** 2) AS scale, avg(res * (x[b + 1] - x[a + 1])) AS slope, avg(abs(x[a + 1] - x[b + 1])) AS reach FROM r WHERE side = 'fit' GROUP BY ALL),
i AS (SELECT *, greatest(0, wa + (-slope - sqrt(slope * slope + 0.01 * loss * scale)) / scale) AS low, least(1, wa + (-slope + sqrt(slope * slope + 0.01 * loss * scale)) / scale) AS high FROM g)
SELECT split_seed, t, a, b, round(wa, 8) AS weight, round(low, 8) AS low, round(high, 8) AS high, round((high - low) * reach, 8) AS variation FROM i""")  # fmt: skip
def weight_ambiguity(spark, sf_dir):
    """How far a weight can move while its loss stays within 1% (a quadratic's roots), and how far predictions then move on average."""
    rows = pair_residuals(spark, sf_dir).where("side = 'fit'").withColumn("d", F.get("x", F.col("a")) - F.get("x", F.col("b")))
    g = rows.groupBy(*PAIR).agg(F.first("wa").alias("wa"), F.avg(F.col("res") * F.col("res")).alias("loss"), F.avg(F.col("d") * F.col("d")).alias("scale"), F.avg(-F.col("res") * F.col("d")).alias("slope"), F.avg(F.abs("d")).alias("reach"))
    root = F.sqrt(F.col("slope") * F.col("slope") + 0.01 * F.col("loss") * F.col("scale"))
    low, high = F.greatest(F.lit(0.0), F.col("wa") + (-F.col("slope") - root) / F.col("scale")), F.least(F.lit(1.0), F.col("wa") + (-F.col("slope") + root) / F.col("scale"))
    r8 = lambda c: F.round(c, 8)
    return g.select(*PAIR, r8("wa").alias("weight"), r8(low).alias("low"), r8(high).alias("high"), r8((high - low) * F.col("reach")).alias("variation"))


@query("coefficient_audit", EVAL + """, g AS (SELECT split_seed, t, a, b, any_value(wa) AS wa, sum(res * (x[b + 1] - x[a + 1])) AS slope, sum((x[a + 1] - x[b + 1]) ** 2) AS scale, count(*) AS n FROM r WHERE side = 'fit' GROUP BY ALL)
SELECT split_seed, t, a, b, wa BETWEEN 0 AND 1 AS on_simplex, CASE WHEN wa <= 0 THEN slope >= -1e-9 * scale WHEN wa >= 1 THEN slope <= 1e-9 * scale ELSE abs(slope) <= 1e-9 * scale END AS optimal, n FROM g""")  # fmt: skip
def coefficient_audit(spark, sf_dir):
    """Saved weights against the conditions of an optimum, recomputed from the rows: the slope is zero inside, and points outwards at an end."""
    rows = pair_residuals(spark, sf_dir).where("side = 'fit'").withColumn("d", F.get("x", F.col("a")) - F.get("x", F.col("b")))
    g = rows.groupBy(*PAIR).agg(F.first("wa").alias("wa"), F.sum(-F.col("res") * F.col("d")).alias("slope"), F.sum(F.col("d") * F.col("d")).alias("scale"), F.count("*").alias("n"))
    low, high = F.col("slope") >= -1e-9 * F.col("scale"), F.col("slope") <= 1e-9 * F.col("scale")
    return g.select(*PAIR, F.col("wa").between(0, 1).alias("on_simplex"), F.when(F.col("wa") <= 0, low).when(F.col("wa") >= 1, high).otherwise(low & high).alias("optimal"), "n")


@query("loss_audit", EVAL + """, q AS (SELECT split_seed, t, a, b, question, avg(abs(res)) AS loss, count(*) AS n FROM r WHERE side = 'eval' GROUP BY ALL), sm AS (SELECT split_seed, t, a, b, avg(abs(res)) AS whole FROM r WHERE side = 'eval' GROUP BY ALL)
SELECT split_seed, t, a, b, count(*) AS n_questions, round(sum(loss * n) / sum(n), 9) AS from_questions, abs(sum(loss * n) / sum(n) - any_value(whole)) <= 1e-12 AS agrees FROM q JOIN sm USING (split_seed, t, a, b) GROUP BY ALL""")  # fmt: skip
def loss_audit(spark, sf_dir):
    """Losses of questions against the table made from all rows."""
    rows = held_out(spark, sf_dir)
    q = rows.groupBy(*PAIR, "question").agg(F.avg(F.abs("res")).alias("loss"), F.count("*").alias("n"))
    j = checks.merge(q, rows.groupBy(*PAIR).agg(F.avg(F.abs("res")).alias("whole")), PAIR, "m:1")
    again = F.sum(F.col("loss") * F.col("n")) / F.sum("n")
    return j.groupBy(*PAIR).agg(F.count("*").alias("n_questions"), R9(again).alias("from_questions"), (F.abs(again - F.first("whole")) <= 1e-12).alias("agrees"))


@query("clone_audit", EVAL + """, z AS (SELECT split_seed, dose, avg(abs(x[1] - x[1])) AS clone, min(abs(x[2] - x[1])) AS nearest, avg(abs(x[2] - x[1])) AS other FROM w JOIN sp USING (category, question) WHERE side = 'eval' GROUP BY ALL)
SELECT split_seed, dose, clone <= 1e-9 AS clone_alarm, other <= 1e-9 AS other_alarm, round(other, 9) AS other FROM z""")  # fmt: skip
def clone_audit(spark, sf_dir):
    """An alarm where a peer answers as the target does at a dose: of a copy always, of another model never."""
    rows = aligned_splits(spark, sf_dir).where("side = 'eval'")
    off = lambda i, j: F.avg(F.abs(F.get("x", F.lit(i)) - F.get("x", F.lit(j))))
    z = rows.groupBy("split_seed", "dose").agg(off(0, 0).alias("clone"), off(1, 0).alias("other"))
    return z.select("split_seed", "dose", (F.col("clone") <= 1e-9).alias("clone_alarm"), (F.col("other") <= 1e-9).alias("other_alarm"), R9("other").alias("other"))


@query("dose_audit", EVAL + f" SELECT t, dose, {ERR} AS error, round(avg(res), 9) + 0.0 AS bias, count(*) AS n FROM r WHERE side = 'eval' GROUP BY ALL")
def dose_audit(spark, sf_dir):
    return held_out(spark, sf_dir).groupBy("t", "dose").agg(R9(F.avg(F.abs("res"))).alias("error"), (R9(F.avg("res")) + 0.0).alias("bias"), F.count("*").alias("n"))


@query("separate_ecosystems", "WITH " + oracle.wide("track") + ", " + oracle.SPLITS + """,
tri AS (SELECT t::INTEGER AS t, a::INTEGER AS a, b::INTEGER AS b FROM range(5) q(t), range(5) r(a), range(5) u(b) WHERE a < b AND t <> a AND t <> b),
f AS (SELECT split_seed, track, t, a, b, least(greatest(sum((x[t + 1] - x[b + 1]) * (x[a + 1] - x[b + 1])) / sum((x[a + 1] - x[b + 1]) ** 2), 0), 1) AS wa FROM w JOIN sp USING (category, question), tri WHERE side = 'fit' GROUP BY ALL)
SELECT split_seed, track, t, a, b, round(avg(abs(x[t + 1] - wa * x[a + 1] - (1 - wa) * x[b + 1])), 9) AS error, count(*) AS n FROM w JOIN sp USING (category, question) JOIN f USING (split_seed, track) WHERE side = 'eval' GROUP BY ALL""")  # fmt: skip
def separate_ecosystems(spark, sf_dir):
    """An ecosystem of its own for each track, under the same splits."""
    rows = aligned_splits(spark, sf_dir, "track")
    fits = pair_fits(rows.where("side = 'fit'"), ["split_seed", "track"])
    j = rows.where("side = 'eval'").join(fits, ["split_seed", "track"])
    guess = F.col("wa") * F.get("x", F.col("a")) + (1 - F.col("wa")) * F.get("x", F.col("b"))
    return j.groupBy("split_seed", "track", "t", "a", "b").agg(R9(F.avg(F.abs(F.get("x", F.col("t")) - guess))).alias("error"), F.count("*").alias("n"))


@query("convexity_table", "WITH " + SINGLE + """, sm AS (SELECT split_seed, t, arg_min(p, (fit_error, p)) AS peer, arg_min(eval_error, (fit_error, p)) AS err FROM p GROUP BY ALL), c AS (SELECT t, peer, count(*) AS n FROM sm GROUP BY ALL)
SELECT t, arg_max(peer, (c.n, -peer)) AS modal_peer, max(c.n) || '/' || any_value(k.n) AS support, round(any_value(mean), 9) AS mean_error FROM c JOIN (SELECT t, count(*) AS n, avg(err) AS mean FROM sm GROUP BY t) k USING (t) GROUP BY t""")  # fmt: skip
def convexity_table(spark, sf_dir):
    """Each target's modal single peer (ties to the first), in how many of the splits, and its mean error."""
    order = F.struct("fit_error", "p")
    s = peer_errors(spark, sf_dir).groupBy("split_seed", "t").agg(F.min_by("p", order).alias("peer"), F.min_by("eval_error", order).alias("err"))
    c = s.groupBy("t", "peer").agg(F.count("*").alias("n"), F.sum("err").alias("e"))
    return c.groupBy("t").agg(F.max_by("peer", F.struct("n", -F.col("peer"))).alias("modal_peer"), F.concat_ws("/", F.max("n").cast("string"), F.sum("n").cast("string")).alias("support"), R9(F.sum("e") / F.sum("n")).alias("mean_error"))


@query("endpoint_table", "WITH " + ENDPOINT + """, sm AS (SELECT t, a, b, avg(clean) AS clean, avg(high) AS high FROM q GROUP BY ALL), o AS (SELECT t, a, b, avg(abs(res)) AS overall FROM r WHERE side = 'eval' GROUP BY ALL)
SELECT t, a, b, round(clean, 9) AS clean, round(high, 9) AS high, round(high - clean, 9) AS delta, round(overall, 9) AS overall, sign(round(high - clean, 9)) <> sign(round(overall - clean, 9)) AS sign_changes FROM sm JOIN o USING (t, a, b)""")  # fmt: skip
def endpoint_table(spark, sf_dir):
    """Effects beside the error over all doses, and whether the two tell another sign."""
    rows = held_out(spark, sf_dir)
    s = endpoints(spark, sf_dir).groupBy("t", "a", "b").agg(F.avg("clean").alias("clean"), F.avg("high").alias("high"))
    o = rows.groupBy("t", "a", "b").agg(F.avg(F.abs("res")).alias("overall"))
    d, e = R9(F.col("high") - F.col("clean")), R9(F.col("overall") - F.col("clean"))
    return checks.merge(s, o, ["t", "a", "b"], "1:1").select("t", "a", "b", R9("clean").alias("clean"), R9("high").alias("high"), d.alias("delta"), R9("overall").alias("overall"), (F.signum(d) != F.signum(e)).alias("sign_changes"))


@query("markdown_table", "WITH " + SINGLE + """, sm AS (SELECT t, p, avg(eval_error) AS e FROM p GROUP BY ALL)
SELECT t, '| ' || t || ' | ' || string_agg(printf('%.4f', e), ' | ' ORDER BY p) || ' |' AS line FROM sm GROUP BY t""")  # fmt: skip
def markdown_table(spark, sf_dir):
    """A line of a table for each target, its peers' errors in order; a roster is small."""
    s = peer_errors(spark, sf_dir).groupBy("t", "p").agg(F.avg("eval_error").alias("e"))
    cells = F.transform(F.array_sort(F.collect_list(F.struct("p", F.format_string("%.4f", "e").alias("s")))), lambda x: x["s"])
    return s.groupBy("t").agg(F.concat(F.lit("| "), F.col("t").cast("string"), F.lit(" | "), F.array_join(cells, " | "), F.lit(" |")).alias("line"))


@query("context_inventory", "WITH " + oracle.wide() + ", " + oracle.SPLITS + """
SELECT split_seed, category, side, count(DISTINCT question) AS n_questions, count(*) AS n_rows, sha256(string_agg(question || ':' || dose, ',' ORDER BY question, dose)) AS rows_digest FROM w JOIN sp USING (category, question) GROUP BY ALL""")  # fmt: skip
def context_inventory(spark, sf_dir):
    """What a bootstrap's context holds of each category and side, and a digest of its row order; a category is a maker's brands."""
    rows = aligned_splits(spark, sf_dir)
    order = F.transform(F.array_sort(F.collect_list(F.struct("question", "dose"))), lambda s: F.concat_ws(":", s["question"], s["dose"].cast("string")))
    return rows.groupBy("split_seed", "category", "side").agg(F.countDistinct("question").alias("n_questions"), F.count("*").alias("n_rows"), F.sha2(F.array_join(order, ","), 256).alias("rows_digest"))


@query("convexity_projection", EVAL + """, o AS (SELECT t, a, b, split_seed, avg(abs(res)) AS e, count(*) AS n FROM r WHERE side = 'eval' GROUP BY ALL) SELECT t, a, b, round(avg(e), 9) AS overall, sum(n)::BIGINT AS n_rows FROM o GROUP BY ALL HAVING count(*) = 3""")
def convexity_projection(spark, sf_dir):
    """Overall rows of the fits that all splits have; one that lacks a split raises."""
    o = held_out(spark, sf_dir).groupBy(*PAIR).agg(F.avg(F.abs("res")).alias("e"), F.count("*").alias("n"))
    g = o.groupBy("t", "a", "b").agg(R9(F.avg("e")).alias("overall"), F.sum("n").alias("n_rows"), F.count("*").alias("k"))
    return checks.require(g, F.col("k") == 3, "a fit lacks a split").drop("k")


@query("declared_trackwise", EVAL.replace(oracle.residuals(), oracle.residuals("track")) + """, d AS (SELECT DISTINCT split_seed, t, a, b, question, dose, track, round(res, 12) AS res FROM (SELECT * FROM r UNION ALL SELECT * FROM r) WHERE side = 'eval')
SELECT split_seed, t, a, b, round(avg(abs(res)), 9) AS trackwise, count(*) AS n FROM d GROUP BY ALL""")  # fmt: skip
def declared_trackwise(spark, sf_dir):
    """Mean |residual| over declared tracks: a track given twice counts once, and one given with two values raises."""
    r = held_out(spark, sf_dir, "track").select(*PAIR, "question", "dose", "track", F.round("res", 12).alias("res"))
    d = r.unionByName(r).groupBy(*PAIR, "question", "dose", "track").agg(F.min("res").alias("res"), F.max("res").alias("other"))
    d = checks.require(d, F.col("res") == F.col("other"), "a track has two values")
    return d.groupBy(*PAIR).agg(R9(F.avg(F.abs("res"))).alias("trackwise"), F.count("*").alias("n"))


@query("synthetic_controls", """WITH k AS (SELECT q, ('0x' || sha256(concat_ws(chr(31), '3', q::VARCHAR, 'a'))[1:7])::BIGINT / 268435456.0 AS a, ('0x' || sha256(concat_ws(chr(31), '3', q::VARCHAR, 'b'))[1:7])::BIGINT / 268435456.0 AS b FROM range(200) r(q)),
y AS (SELECT q, a, b, c.control, CASE c.control WHEN 'clone' THEN a WHEN 'mixture' THEN 0.3 * a + 0.7 * b WHEN 'boundary' THEN b ELSE 2 * a - b END AS y FROM k, (VALUES ('clone'), ('mixture'), ('boundary'), ('outside')) c(control)),
f AS (SELECT control, least(greatest(sum((y - b) * (a - b)) / sum((a - b) ** 2), 0), 1) AS w FROM y WHERE q % 2 = 0 GROUP BY control)
SELECT control, round(any_value(w), 9) AS weight, round(avg(abs(y - w * a - (1 - w) * b)), 9) AS error, avg(abs(y - w * a - (1 - w) * b)) <= 1e-9 AS recovered FROM y JOIN f USING (control) WHERE q % 2 = 1 GROUP BY control""")  # fmt: skip
def synthetic_controls(spark, sf_dir):
    """Targets of known make (a copy, a mixture, an end and one outside) fitted on even rows and judged on odd ones: all but the last are recovered."""
    unit = lambda name: F.conv(F.substring(stable_key("3", F.col("q").cast("string"), F.lit(name)), 1, 7), 16, 10).cast("double") / 268435456.0
    k = spark.range(200).withColumnRenamed("id", "q").withColumn("a", unit("a")).withColumn("b", unit("b"))
    a, b = F.col("a"), F.col("b")
    made = F.array(*[F.struct(F.lit(n).alias("control"), y.alias("y")) for n, y in (("clone", a), ("mixture", 0.3 * a + 0.7 * b), ("boundary", b), ("outside", 2 * a - b))])
    y = k.select("q", "a", "b", F.explode(made).alias("m")).select("q", "a", "b", "m.*")
    f = y.where("q % 2 = 0").groupBy("control").agg(F.least(F.greatest(F.sum((F.col("y") - b) * (a - b)) / F.sum((a - b) * (a - b)), F.lit(0.0)), F.lit(1.0)).alias("w"))
    off = F.avg(F.abs(F.col("y") - F.col("w") * a - (1 - F.col("w")) * b))
    return y.where("q % 2 = 1").join(f, "control").groupBy("control").agg(R9(F.first("w")).alias("weight"), R9(off).alias("error"), (off <= 1e-9).alias("recovered"))


def draw_sql(seed: str, n: int) -> str:
    """Multiplicities within (split, side, category), from draws that hash ``seed``."""
    return f"""ids AS (SELECT split_seed, side, category, question, row_number() OVER (PARTITION BY split_seed, side, category ORDER BY question) - 1 AS i, count(*) OVER (PARTITION BY split_seed, side, category) AS n FROM sp),
slots AS (SELECT *, ('0x' || sha256(concat_ws(chr(31), {seed}, replicate::VARCHAR, category, i::VARCHAR))[1:7])::BIGINT % n AS pick FROM ids, range({n}) q(replicate)),
cnt AS (SELECT split_seed, side, category, replicate, pick AS i, count(*) AS m FROM slots GROUP BY ALL),
mult AS (SELECT s.split_seed, s.side, s.replicate::INTEGER AS replicate, s.category, s.question, coalesce(c.m, 0) AS m FROM slots s LEFT JOIN cnt c ON c.split_seed = s.split_seed AND c.side = s.side AND c.category = s.category AND c.replicate = s.replicate AND c.i = s.i)"""  # fmt: skip


def side_draws(spark, sf_dir, n: int, *parts):
    """split_seed, side, replicate, category, question, m: each side of a split is drawn from itself, by a seed of its own (``parts``)."""
    from ..functions.hashing import draw
    from ..operators import splits
    from ..operators.pairs import SEEDS

    sp = splits.half_split(ecosystem.responses(spark, sf_dir).select("category", "question"), SEEDS)
    w = Window.partitionBy("split_seed", "side", "category")
    ids = sp.withColumn("i", F.row_number().over(w.orderBy("question")) - 1).withColumn("n", F.count("*").over(w).cast("int"))
    slots = ids.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    pick = draw(F.col("n"), *parts, F.col("replicate").cast("string"), F.col("category"), F.col("i").cast("string"))
    counts = slots.select("split_seed", "side", "category", "replicate", pick.alias("i")).groupBy("split_seed", "side", "category", "replicate", "i").agg(F.count("*").alias("m"))
    on = ["split_seed", "side", "category", "replicate", "i"]
    return slots.join(counts, on, "left").select("split_seed", "side", "replicate", "category", "question", F.coalesce("m", F.lit(0)).alias("m"))


@query("independent_draws", "WITH " + oracle.e() + ", " + oracle.SPLITS + ", " + draw_sql("'91', split_seed::VARCHAR, side", 20) + """
SELECT split_seed, replicate, sum(m) FILTER (side = 'fit')::BIGINT AS n_fit, sum(m) FILTER (side = 'eval')::BIGINT AS n_eval, count(*) - count(DISTINCT question) AS n_leaks, max(m) AS most FROM mult GROUP BY ALL""")  # fmt: skip
def independent_draws(spark, sf_dir):
    """Draws of either side by seeds of their own: totals stay those of the sides, and no question is on both."""
    m = side_draws(spark, sf_dir, 20, "91", F.col("split_seed").cast("string"), F.col("side"))
    on = lambda s: F.sum(F.when(F.col("side") == s, F.col("m"))).cast("long")
    return m.groupBy("split_seed", "replicate").agg(on("fit").alias("n_fit"), on("eval").alias("n_eval"), (F.count("*") - F.countDistinct("question")).alias("n_leaks"), F.max("m").alias("most"))


REFIT = """, w2 AS (SELECT split_seed, side, t, a, b, m.replicate, dose, question, m.m, x, res FROM r JOIN mult m USING (split_seed, side, category, question)),
k AS (SELECT split_seed, t, a, b, replicate, least(greatest(sum(m * (x[t + 1] - x[b + 1]) * (x[a + 1] - x[b + 1])) / nullif(sum(m * (x[a + 1] - x[b + 1]) ** 2), 0), 0), 1) AS wr FROM w2 WHERE side = 'fit' GROUP BY ALL),
z AS (SELECT split_seed, t, a, b, replicate, sum(m * abs(x[t + 1] - wr * x[a + 1] - (1 - wr) * x[b + 1])) / sum(m) AS err,
  sum(m * abs(x[t + 1] - wr * x[a + 1] - (1 - wr) * x[b + 1])) FILTER (dose = 6) / sum(m) FILTER (dose = 6) - sum(m * abs(x[t + 1] - wr * x[a + 1] - (1 - wr) * x[b + 1])) FILTER (dose = 0) / sum(m) FILTER (dose = 0) AS delta
  FROM w2 JOIN k USING (split_seed, t, a, b, replicate) WHERE side = 'eval' GROUP BY ALL)"""  # fmt: skip


def refits(spark, sf_dir, n: int, *parts):
    """split_seed, t, a, b, replicate, err, delta: every replicate refits on its fitting draw and is judged on its evaluation draw.

    Fits come from Gram sums weighted by multiplicities; rows are weighted and not repeated."""
    rows, m = aligned_splits(spark, sf_dir), side_draws(spark, sf_dir, n, *parts).select("split_seed", "replicate", "question", "m")
    rows = rows.join(m, ["split_seed", "question"])
    fits = pair_fits(rows.where("side = 'fit'"), ["split_seed", "replicate"], weight="m")
    j = rows.where("side = 'eval'").join(fits, ["split_seed", "replicate"])
    off = F.abs(F.get("x", F.col("t")) - F.col("wa") * F.get("x", F.col("a")) - (1 - F.col("wa")) * F.get("x", F.col("b")))
    on = lambda c: F.try_divide(F.sum(F.when(c, F.col("m") * off)), F.sum(F.when(c, F.col("m"))))
    return j.groupBy(*PAIR, "replicate").agg(on(F.lit(True)).alias("err"), (on(F.col("dose") == 6) - on(F.col("dose") == 0)).alias("delta"))


@query("draw_errors", "WITH " + oracle.residuals() + ", " + draw_sql("'91', split_seed::VARCHAR, side", 8) + REFIT + " SELECT split_seed, t, a, b, replicate, round(err, 8) AS error, round(delta, 8) AS delta FROM z")
def draw_errors(spark, sf_dir):
    """Overall error and endpoint effect of every refit under independent draws of either side."""
    z = refits(spark, sf_dir, 8, "91", F.col("split_seed").cast("string"), F.col("side"))
    return z.select(*PAIR, "replicate", F.round("err", 8).alias("error"), F.round("delta", 8).alias("delta"))


@query("refit_intervals", "WITH " + oracle.residuals() + ", " + draw_sql("'91', split_seed::VARCHAR, side", 20) + REFIT + """, sm AS (SELECT t, a, b, replicate, avg(err) AS err FROM z GROUP BY ALL)
SELECT t, a, b, round(avg(err), 8) AS mean, round(quantile_cont(err, 0.025), 8) AS low, round(quantile_cont(err, 0.975), 8) AS high, count(*) AS n_replicates FROM sm GROUP BY ALL""")  # fmt: skip
def refit_intervals(spark, sf_dir):
    """Percentile intervals of the error with every replicate refitted."""
    s = refits(spark, sf_dir, 20, "91", F.col("split_seed").cast("string"), F.col("side")).groupBy("t", "a", "b", "replicate").agg(F.avg("err").alias("err"))
    return s.groupBy("t", "a", "b").agg(F.round(F.avg("err"), 8).alias("mean"), F.round(F.percentile("err", F.lit(0.025)), 8).alias("low"), F.round(F.percentile("err", F.lit(0.975)), 8).alias("high"), F.count("*").alias("n_replicates"))


@query("synchronized_draws", "WITH " + oracle.residuals() + ", " + draw_sql("'92', split_seed::VARCHAR", 8) + REFIT + """
SELECT l.split_seed, l.t, l.replicate, round(l.delta - r.delta, 8) AS contrast FROM z l JOIN z r ON l.split_seed = r.split_seed AND l.t = r.t AND l.replicate = r.replicate AND l.a = CASE WHEN l.t = 0 THEN 1 ELSE 0 END AND l.b = CASE WHEN l.t <= 1 THEN 2 ELSE 1 END AND r.a = CASE WHEN l.t >= 3 THEN 2 ELSE 3 END AND r.b = CASE WHEN l.t = 4 THEN 3 ELSE 4 END""")  # fmt: skip
def synchronized_draws(spark, sf_dir):
    """Two families' effects under one draw for both, so their contrast has no noise of separate draws: a target's first pair of peers against its last."""
    z = refits(spark, sf_dir, 8, "92", F.col("split_seed").cast("string"))
    t = F.col("t")
    first = z.where((F.col("a") == F.when(t == 0, 1).otherwise(0)) & (F.col("b") == F.when(t <= 1, 2).otherwise(1))).select("split_seed", "t", "replicate", F.col("delta").alias("d1"))
    last = z.where((F.col("a") == F.when(t >= 3, 2).otherwise(3)) & (F.col("b") == F.when(t == 4, 3).otherwise(4))).select("split_seed", "t", "replicate", F.col("delta").alias("d2"))
    return checks.merge(first, last, ["split_seed", "t", "replicate"], "1:1").select("split_seed", "t", "replicate", F.round(F.col("d1") - F.col("d2"), 8).alias("contrast"))


@query("uncertainty_audit", "WITH qs AS (SELECT DISTINCT p_brand[1:7] AS category, p_brand AS question FROM part), " + DRAW.format(n=50) + """
SELECT replicate, sha256(string_agg(question || '=' || m, ',' ORDER BY question)) AS digest, sum(m)::BIGINT AS total, count(*) FILTER (m = 0) AS n_absent FROM mult GROUP BY replicate""")  # fmt: skip
def uncertainty_audit(spark, sf_dir):
    """Redrawn multiplicities of every replicate and their digest, which a stored run must have; a brand is a question."""
    rows = table(spark, sf_dir, "part").select(F.substring("p_brand", 1, 7).alias("category"), F.col("p_brand").alias("question"))
    m = resample.multiplicities(rows, 50, 77)
    line = F.transform(F.array_sort(F.collect_list(F.struct("question", "m"))), lambda s: F.concat_ws("=", s["question"], s["m"].cast("string")))
    return m.groupBy("replicate").agg(F.sha2(F.array_join(line, ","), 256).alias("digest"), F.sum("m").alias("total"), F.sum((F.col("m") == 0).cast("long")).alias("n_absent"))


@query("repair_free_sensitivity", "WITH " + oracle.residuals() + ", " + draw_sql("'91', split_seed::VARCHAR, side", 20) + REFIT + """, sm AS (SELECT t, a, b, replicate, avg(delta) AS d, bool_or(wr <= 0 OR wr >= 1) AS touched FROM z JOIN k USING (split_seed, t, a, b, replicate) GROUP BY ALL),
i AS (SELECT t, a, b, quantile_cont(d, 0.025) AS low, quantile_cont(d, 0.975) AS high, quantile_cont(d, 0.025) FILTER (NOT touched) AS low2, quantile_cont(d, 0.975) FILTER (NOT touched) AS high2, count(*) FILTER (touched) AS n_touched FROM sm GROUP BY ALL)
SELECT t, a, b, n_touched, round(low, 8) AS low, round(high, 8) AS high, round(low2, 8) AS low_free, round(high2, 8) AS high_free, CASE WHEN low > 0 THEN 1 WHEN high < 0 THEN -1 ELSE 0 END <> CASE WHEN low2 > 0 THEN 1 WHEN high2 < 0 THEN -1 ELSE 0 END AS changed FROM i""")  # fmt: skip
def repair_free_sensitivity(spark, sf_dir):
    """Intervals of the effect with and without the replicates whose weights had to be put back on the simplex, and whether the conclusion changes."""
    parts = ("91", F.col("split_seed").cast("string"), F.col("side"))
    rows, m = aligned_splits(spark, sf_dir), side_draws(spark, sf_dir, 20, *parts).select("split_seed", "replicate", "question", "m")
    fits = pair_fits(rows.where("side = 'fit'").join(m, ["split_seed", "question"]), ["split_seed", "replicate"], weight="m")
    touched = fits.select(*PAIR, "replicate", ((F.col("wa") <= 0) | (F.col("wa") >= 1)).alias("touched"))
    s = refits(spark, sf_dir, 20, *parts).join(touched, [*PAIR, "replicate"]).groupBy("t", "a", "b", "replicate").agg(F.avg("delta").alias("d"), F.bool_or("touched").alias("touched"))
    free = F.when(~F.col("touched"), F.col("d"))
    at = lambda c, q: F.percentile(c, F.lit(q))
    i = s.groupBy("t", "a", "b").agg(F.sum(F.col("touched").cast("long")).alias("n_touched"), at("d", 0.025).alias("low"), at("d", 0.975).alias("high"), at(free, 0.025).alias("low_free"), at(free, 0.975).alias("high_free"))
    side = lambda low, high: F.when(F.col(low) > 0, 1).when(F.col(high) < 0, -1).otherwise(0)
    return i.select("t", "a", "b", "n_touched", *[F.round(c, 8).alias(c) for c in ("low", "high", "low_free", "high_free")], (side("low", "high") != side("low_free", "high_free")).alias("changed"))


P3 = """tri3 AS (SELECT t::INTEGER AS t, a::INTEGER AS a, b::INTEGER AS b, c::INTEGER AS c FROM range(5) q(t), range(5) r(a), range(5) u(b), range(5) v(c) WHERE a < b AND b < c AND t NOT IN (a, b, c)),
g3 AS (SELECT split_seed, t, a, b, c, sum((x[a + 1] - x[c + 1]) ** 2) AS uu, sum((x[b + 1] - x[c + 1]) ** 2) AS vv, sum((x[a + 1] - x[c + 1]) * (x[b + 1] - x[c + 1])) AS uv, sum((x[a + 1] - x[c + 1]) * (x[t + 1] - x[c + 1])) AS uy, sum((x[b + 1] - x[c + 1]) * (x[t + 1] - x[c + 1])) AS vy
  FROM w JOIN sp USING (category, question), tri3 WHERE side = 'fit' GROUP BY ALL),
h3 AS (SELECT *, unnest([{'k': 0, 'wa': (uy * vv - vy * uv) / (uu * vv - uv * uv), 'wb': (vy * uu - uy * uv) / (uu * vv - uv * uv)}, {'k': 1, 'wa': least(greatest(uy / uu, 0), 1), 'wb': 0.0}, {'k': 2, 'wa': 0.0, 'wb': least(greatest(vy / vv, 0), 1)},
  {'k': 3, 'wa': least(greatest((uy - vy - uv + vv) / (uu - 2 * uv + vv), 0), 1), 'wb': 1 - least(greatest((uy - vy - uv + vv) / (uu - 2 * uv + vv), 0), 1)}]) AS s FROM g3),
f3 AS (SELECT split_seed, t, a, b, c, arg_min(s, (round(s.wa * s.wa * uu + s.wb * s.wb * vv + 2 * s.wa * s.wb * uv - 2 * s.wa * uy - 2 * s.wb * vy, 12), s.k)) AS s FROM h3 WHERE s.wa >= 0 AND s.wb >= 0 AND s.wa + s.wb <= 1 GROUP BY ALL)"""  # fmt: skip


@query("residual_p3", "WITH " + oracle.wide() + ", " + oracle.SPLITS + ", " + P3 + """
SELECT split_seed, t, a, b, c, round(any_value(s.wa), 8) AS wa, round(any_value(s.wb), 8) AS wb, round(avg(abs(x[t + 1] - s.wa * x[a + 1] - s.wb * x[b + 1] - (1 - s.wa - s.wb) * x[c + 1])), 8) AS error, count(*) AS n
FROM w JOIN sp USING (category, question) JOIN f3 USING (split_seed) WHERE side = 'eval' GROUP BY ALL""")  # fmt: skip
def residual_p3(spark, sf_dir):
    """Held-out error of the best mixture of three peers: of the inner optimum, where it is a mixture, and the three edges' the one of least loss, all from one Gram matrix."""
    from ..operators.pairs import triple_fits

    rows = aligned_splits(spark, sf_dir)
    fits = triple_fits(rows.where("side = 'fit'"), ["split_seed"])
    guess = F.col("wa") * F.get("x", F.col("a")) + F.col("wb") * F.get("x", F.col("b")) + (1 - F.col("wa") - F.col("wb")) * F.get("x", F.col("c"))
    j = rows.where("side = 'eval'").join(fits, "split_seed")
    return j.groupBy("split_seed", "t", "a", "b", "c").agg(F.round(F.first("wa"), 8).alias("wa"), F.round(F.first("wb"), 8).alias("wb"), F.round(F.avg(F.abs(F.get("x", F.col("t")) - guess)), 8).alias("error"), F.count("*").alias("n"))
