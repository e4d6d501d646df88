"""Queries over vector responses of an ensemble: fits of vectors, rotations, temperatures, gates and interventions."""

from __future__ import annotations

import itertools

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text, vectors
from ..functions.hashing import draw, stable_key
from ..operators import checks
from ..operators.pairs import TRIPLES, pair_fits
from ..registry import query
from ..sources.staging import staged
from ..sources.tables import table
from .coverage_queries import R9
from .vector_queries import LOGITS, SOFT, logits

#: Models are ids modulo 5, questions the quotient modulo 40: every vector of the table is in the mean of its cell.
CELLS = SOFT + """, ve AS (SELECT (vec_id % 5)::INTEGER AS m, vec_id // 5 % 40 AS q, i::INTEGER AS i, avg(p[i]) AS v, avg(z[i]) AS zv FROM p, range(1, 65) r(i) GROUP BY ALL),
vw AS (SELECT q, i, CASE WHEN q % 2 = 0 THEN 'fit' ELSE 'eval' END AS side, [max(v) FILTER (m = 0), max(v) FILTER (m = 1), max(v) FILTER (m = 2), max(v) FILTER (m = 3), max(v) FILTER (m = 4)] AS x FROM ve GROUP BY q, i HAVING count(*) = 5),
tri AS (SELECT t::INTEGER AS t, a::INTEGER AS a, b::INTEGER AS b FROM range(5) q(t), range(5) r(a), range(5) u(b) WHERE a < b AND t <> a AND t <> b)"""  # fmt: skip


def vector_fit_sql(name: str, where: str = "true") -> str:
    return f"{name} AS (SELECT t, a, b, least(greatest(sum((x[t + 1] - x[b + 1]) * (x[a + 1] - x[b + 1])) / sum((x[a + 1] - x[b + 1]) ** 2), 0), 1) AS w FROM vw, tri WHERE side = 'fit' AND {where} GROUP BY ALL)"


def mean_vectors(spark, sf_dir):
    """m, q, p, z: the mean probability vector and mean logits of each model and question."""
    rows = logits(spark, sf_dir).select((F.col("vec_id") % 5).cast("int").alias("m"), (F.floor(F.col("vec_id") / 5) % 40).alias("q"), "z", vectors.softmax(F.col("z")).alias("p"))
    mean = lambda c: F.array(*[F.avg(F.get(c, F.lit(i))) for i in range(64)])
    return staged(spark, ("mean_vectors", sf_dir), lambda: rows.groupBy("m", "q").agg(mean("p").alias("p"), mean("z").alias("z")))


def vector_wide(spark, sf_dir, source=None):
    """q, i (from 1), side, x: one row per question and option with the five models' values in order."""
    cells = mean_vectors(spark, sf_dir) if source is None else source
    wide = cells.groupBy("q").agg(*[F.max(F.when(F.col("m") == k, F.col("p"))).alias(f"p{k}") for k in range(5)], F.count("*").alias("n")).where("n = 5")
    rows = wide.select("q", F.posexplode(F.arrays_zip(*[f"p{k}" for k in range(5)])).alias("i", "e"))
    return rows.select("q", (F.col("i") + 1).alias("i"), F.when(F.col("q") % 2 == 0, "fit").otherwise("eval").alias("side"), F.array(*[F.col(f"e.p{k}") for k in range(5)]).alias("x"))


def fit_vectors(rows, name: str = "w"):
    """t, a, b and the weight that fits all options of all fitting questions best in squares."""
    return pair_fits(rows.where("side = 'fit'").withColumn("k", F.lit(0)), ["k"]).select("t", "a", "b", F.col("wa").alias(name))


def off(w):
    return F.get("x", F.col("t")) - w * F.get("x", F.col("a")) - (1 - w) * F.get("x", F.col("b"))


def judged(rows, fits, w: str = "w"):
    """t, a, b, q: total variation of the mixture to the target on evaluation questions."""
    j = rows.where("side = 'eval'").crossJoin(F.broadcast(fits))  # 30 fits
    return j.groupBy("t", "a", "b", w, "q").agg((0.5 * F.sum(F.abs(off(F.col(w))))).alias("tv"))


def tv_sql(fits: str, w: str = "w") -> str:
    return f"(SELECT t, a, b, any_value({w}) AS w, q, 0.5 * sum(abs(x[t + 1] - {w} * x[a + 1] - (1 - {w}) * x[b + 1])) AS tv FROM vw, {fits} WHERE side = 'eval' GROUP BY t, a, b, q)"


@query("vector_l2_fit", "WITH " + CELLS + ", " + vector_fit_sql("f") + f" SELECT t, a, b, round(any_value(w), 9) AS weight, round(avg(tv), 9) AS mean_tv, round(max(tv), 9) AS max_tv, count(*) AS n FROM {tv_sql('f')} GROUP BY t, a, b")
def vector_l2_fit(spark, sf_dir):
    """Squared-loss fits of vectors with their options as rows, and their total variation on the other questions."""
    rows = vector_wide(spark, sf_dir)
    return judged(rows, fit_vectors(rows)).groupBy("t", "a", "b").agg(R9(F.first("w")).alias("weight"), R9(F.avg("tv")).alias("mean_tv"), R9(F.max("tv")).alias("max_tv"), F.count("*").alias("n"))


@query("vector_selected_peer", "WITH " + CELLS + """, d AS (SELECT t::INTEGER AS t, p::INTEGER AS p, side, q, 0.5 * sum(abs(x[t + 1] - x[p + 1])) AS tv FROM vw, range(5) r(t), range(5) s(p) WHERE t <> p GROUP BY ALL),
em AS (SELECT t, p, round(avg(tv) FILTER (side = 'fit'), 12) AS fit_tv, avg(tv) FILTER (side = 'eval') AS eval_tv FROM d GROUP BY ALL)
SELECT t, arg_min(p, (fit_tv, p)) AS peer, round(min(fit_tv), 9) AS fit_tv, round(arg_min(eval_tv, (fit_tv, p)), 9) AS eval_tv FROM em GROUP BY t""")  # fmt: skip
def vector_selected_peer(spark, sf_dir):
    """The peer of least mean total variation on fitting questions (ties to the first), judged on the others."""
    cells = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("p"), F.abs(F.get("x", F.lit(t)) - F.get("x", F.lit(p))).alias("d")) for t, p in itertools.permutations(range(5), 2)])
    d = vector_wide(spark, sf_dir).select("q", "side", F.explode(cells).alias("c")).groupBy("c.t", "c.p", "side", "q").agg((0.5 * F.sum("c.d")).alias("tv"))
    on = lambda s: F.avg(F.when(F.col("side") == s, F.col("tv")))
    e = d.groupBy("t", "p").agg(F.round(on("fit"), 12).alias("fit_tv"), on("eval").alias("eval_tv"))
    order = F.struct("fit_tv", "p")
    return e.groupBy("t").agg(F.min_by("p", order).alias("peer"), R9(F.min("fit_tv")).alias("fit_tv"), R9(F.min_by("eval_tv", order)).alias("eval_tv"))


@query("fixed_vector_weights", "WITH " + CELLS + ", " + vector_fit_sql("f", "i = q % 64 + 1") + """,
g AS (SELECT t, a, b, q, 0.5 * sum(abs(x[t + 1] - w * x[a + 1] - (1 - w) * x[b + 1])) AS tv, arg_max(i, (round(x[t + 1], 9), -i)) = arg_max(i, (round(w * x[a + 1] + (1 - w) * x[b + 1], 9), -i)) AS same FROM vw, f WHERE side = 'eval' GROUP BY ALL)
SELECT t, a, b, round(avg(tv), 9) AS mean_tv, round(avg(same::INTEGER), 9) AS top_agreement FROM g GROUP BY ALL""")  # fmt: skip
def fixed_vector_weights(spark, sf_dir):
    """Weights fitted to the gold option alone, held fixed on whole vectors: total variation and agreement of the top option (ties to the first)."""
    rows = vector_wide(spark, sf_dir)
    fits = fit_vectors(rows.where("i = q % 64 + 1"))
    j = rows.where("side = 'eval'").crossJoin(F.broadcast(fits))  # 30 fits
    y, guess = F.get("x", F.col("t")), F.get("x", F.col("t")) - off(F.col("w"))
    top = lambda v: F.max_by("i", F.struct(R9(v), -F.col("i")))
    g = j.groupBy("t", "a", "b", "q").agg((0.5 * F.sum(F.abs(off(F.col("w"))))).alias("tv"), (top(y) == top(F.col("w") * F.get("x", F.col("a")) + (1 - F.col("w")) * F.get("x", F.col("b")))).alias("same"), F.first(guess).alias("_"))
    return g.groupBy("t", "a", "b").agg(R9(F.avg("tv")).alias("mean_tv"), R9(F.avg(F.col("same").cast("int"))).alias("top_agreement"))


@query("vector_sensitivity", "WITH " + CELLS + ", " + vector_fit_sql("f") + ", " + vector_fit_sql("s", "i = q % 64 + 1") + f""",
v AS (SELECT t, a, b, any_value(w) AS w, avg(tv) AS tv FROM {tv_sql('f')} GROUP BY t, a, b), u AS (SELECT t, a, b, any_value(w) AS w, avg(tv) AS tv FROM {tv_sql('s')} GROUP BY t, a, b)
SELECT t, a, b, round(v.w, 9) AS vector_weight, round(u.w, 9) AS scalar_weight, round(u.tv - v.tv, 9) AS tv_difference, sign(round(v.w - 0.5, 9)) = sign(round(u.w - 0.5, 9)) AS same_direction FROM v JOIN u USING (t, a, b)""")  # fmt: skip
def vector_sensitivity(spark, sf_dir):
    """Weights fitted to vectors against weights fitted to the gold option: both judged on vectors, and whether they favour the same peer."""
    rows = vector_wide(spark, sf_dir)
    mean = lambda fits, w, tv: judged(rows, fits).groupBy("t", "a", "b").agg(F.first("w").alias(w), F.avg("tv").alias(tv))
    j = checks.merge(mean(fit_vectors(rows), "v", "tv_v"), mean(fit_vectors(rows.where("i = q % 64 + 1")), "s", "tv_s"), ["t", "a", "b"], "1:1")
    side = lambda c: F.signum(R9(F.col(c) - 0.5))
    return j.select("t", "a", "b", R9("v").alias("vector_weight"), R9("s").alias("scalar_weight"), R9(F.col("tv_s") - F.col("tv_v")).alias("tv_difference"), (side("v") == side("s")).alias("same_direction"))


@query("custom_aggregates", "WITH " + CELLS + """, w AS (SELECT q, i, list_max(x) - list_min(x) AS reach, list_sum(x) / 5 AS mean FROM vw) SELECT i, round(max(reach), 9) AS max_reach, round(avg(reach), 9) AS mean_reach, round(avg(mean), 9) AS mean FROM w GROUP BY i""")
def custom_aggregates(spark, sf_dir):
    """Peak to peak over models, and the mean vector, without a Python aggregate."""
    w = vector_wide(spark, sf_dir).select("i", (F.array_max("x") - F.array_min("x")).alias("reach"), (vectors.total(F.col("x")) / 5).alias("mean"))
    return w.groupBy("i").agg(R9(F.max("reach")).alias("max_reach"), R9(F.avg("reach")).alias("mean_reach"), R9(F.avg("mean")).alias("mean"))


ROTATIONS = SOFT + """, v AS (SELECT vec_id, r::INTEGER AS rotation, s::INTEGER AS visible, p[((s + r) % 64 + 1)::INTEGER] AS p, ((s + r) % 64)::INTEGER AS semantic FROM p, range(0, 4) q(r), range(0, 64) t(s))"""


def rotations(spark, sf_dir):
    """vec_id, rotation, visible: the vector as shown under each of four rotations."""
    p = logits(spark, sf_dir).select("vec_id", "label", vectors.softmax(F.col("z")).alias("p"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("rotation"))
    shown = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda s: F.get("p", (s + F.col("rotation")) % 64))
    return p.select("vec_id", "label", "rotation", shown.alias("visible"))


@query("rotation_manifest_join", "WITH " + ROTATIONS + """ SELECT vec_id, rotation, sha256(concat_ws(chr(31), vec_id::VARCHAR, rotation::VARCHAR))[1:16] AS prompt_id, round(max(p), 9) AS top, arg_max(semantic, (round(p, 9), -visible)) AS answer FROM v GROUP BY vec_id, rotation""")
def rotation_manifest_join(spark, sf_dir):
    """Shown vectors joined one to one with the manifest of prompts, and the answer in the options' own order."""
    rows = rotations(spark, sf_dir)
    manifest = logits(spark, sf_dir).select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("rotation")).withColumn("prompt_id", stable_key(F.col("vec_id").cast("string"), F.col("rotation").cast("string")))
    top = vectors.argmax(F.transform("visible", lambda x: F.round(x, 9)))
    return checks.merge(rows, manifest, ["vec_id", "rotation"], "m:1").select("vec_id", "rotation", "prompt_id", R9(F.array_max("visible")).alias("top"), ((top + F.col("rotation")) % 64).cast("int").alias("answer"))


@query("rotation_reconstruction", "WITH " + ROTATIONS + ", " + "b AS (SELECT v.vec_id, v.rotation, max(abs(v.p - p.p[v.semantic + 1])) AS gap FROM v JOIN p ON p.vec_id = v.vec_id GROUP BY ALL) SELECT rotation, count(*) AS n_rows, count(*) FILTER (gap > 1e-12) AS n_bad FROM b GROUP BY rotation")
def rotation_reconstruction(spark, sf_dir):
    """Shown vectors mapped back by the cyclic rule, stored and new rotations together, against the vectors themselves."""
    rows = rotations(spark, sf_dir)
    both = rows.where("rotation = 0").unionByName(rows.where("rotation > 0"))
    back = vectors.scatter(F.col("visible"), vectors.cyclic(F.lit(64), F.col("rotation")))
    known = logits(spark, sf_dir).select("vec_id", vectors.softmax(F.col("z")).alias("p"))
    gap = F.array_max(F.zip_with("back", "p", lambda x, y: F.abs(x - y)))
    j = both.select("vec_id", "rotation", back.alias("back")).join(known, "vec_id").select("rotation", gap.alias("gap"))
    return j.groupBy("rotation").agg(F.count("*").alias("n_rows"), F.sum((F.col("gap") > 1e-12).cast("long")).alias("n_bad"))


@query("rotation_zero_reuse", "WITH " + SOFT + " SELECT vec_id, 0 AS rotation, round(p[label % 64 + 1], 9) AS gold FROM p WHERE vec_id IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def rotation_zero_reuse(spark, sf_dir):
    """Stored vectors that a manifest names, in the columns of new rotations: a semi-join."""
    manifest = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("vec_id")).distinct()
    p = logits(spark, sf_dir).join(manifest, "vec_id", "left_semi")
    return p.select("vec_id", F.lit(0).alias("rotation"), R9(F.get(vectors.softmax(F.col("z")), F.col("label") % 64)).alias("gold"))


@query("rotation_sensitivity_table", "WITH " + ROTATIONS + """, u AS (SELECT v.vec_id % 5 AS m, v.rotation, 0.5 * sum(abs(v.p - p.p[v.visible + 1])) AS tv FROM v JOIN p ON p.vec_id = v.vec_id GROUP BY v.vec_id, v.rotation)
SELECT m, rotation, round(avg(tv), 9) AS mean_tv, round(quantile_cont(tv, 0.95), 9) AS p95_tv FROM u GROUP BY ALL""")  # fmt: skip
def rotation_sensitivity_table(spark, sf_dir):
    """How far a rotation moves what is shown: mean and 95th percentile of total variation by model."""
    known = logits(spark, sf_dir).select("vec_id", vectors.softmax(F.col("z")).alias("p"))
    j = rotations(spark, sf_dir).join(known, "vec_id").select((F.col("vec_id") % 5).alias("m"), "rotation", vectors.total_variation(F.col("visible"), F.col("p")).alias("tv"))
    return j.groupBy("m", "rotation").agg(R9(F.avg("tv")).alias("mean_tv"), R9(F.percentile("tv", F.lit(0.95))).alias("p95_tv"))


@query("seed_audit", "WITH " + ROTATIONS + """, a AS (SELECT vec_id, semantic, avg(p) AS mean, min(p) AS low, max(p) AS high FROM v GROUP BY ALL) SELECT vec_id % 5 AS m, count(*) AS n_cells, count(*) FILTER (high - low > 1e-12) AS n_changed FROM a GROUP BY ALL""")
def seed_audit(spark, sf_dir):
    """Cells that differ between a vector's rotations once these are mapped back: none, as a rotation only moves options."""
    rows = rotations(spark, sf_dir).select("vec_id", "rotation", F.posexplode("visible").alias("place", "p"))
    a = rows.groupBy("vec_id", ((F.col("place") + F.col("rotation")) % 64).alias("semantic")).agg((F.max("p") - F.min("p")).alias("reach"))
    return a.groupBy((F.col("vec_id") % 5).alias("m")).agg(F.count("*").alias("n_cells"), F.sum((F.col("reach") > 1e-12).cast("long")).alias("n_changed"))


@query("dense_cache_gate", "WITH " + CELLS + """, x AS (SELECT m, q, i FROM ve UNION ALL SELECT m, q, i FROM ve WHERE q = 7 AND m = 2), g AS (SELECT m, q, i FROM (SELECT DISTINCT m FROM ve), range(41) r(q), range(1, 65) s(i)),
n AS (SELECT m, q, i, count(*) AS n FROM x GROUP BY ALL) SELECT g.m, count(*) FILTER (n.n IS NULL) AS n_missing, count(*) FILTER (n.n > 1) AS n_repeated FROM g LEFT JOIN n USING (m, q, i) GROUP BY g.m""")  # fmt: skip
def dense_cache_gate(spark, sf_dir):
    """Cells of an expected grid that a long cache lacks or has twice: one question too many is expected, and one model's question 7 is given twice."""
    seen = mean_vectors(spark, sf_dir).select("m", "q", F.explode(F.sequence(F.lit(1), F.lit(64))).alias("i"))
    seen = seen.unionByName(seen.where("q = 7 AND m = 2"))
    grid = seen.select("m").distinct().crossJoin(F.broadcast(spark.range(41).withColumnRenamed("id", "q"))).withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(64))))  # 41 rows
    gaps = checks.grid_gaps(seen, grid, ["m", "q", "i"]).unionByName(grid.select("m", F.lit(None).cast("long").alias("q"), F.lit(None).cast("int").alias("i"), F.lit(1).alias("n")).distinct())
    return gaps.groupBy("m").agg(F.sum((F.col("n") == 0).cast("long")).alias("n_missing"), F.sum((F.col("n") > 1).cast("long")).alias("n_repeated"))


@query("score_assembly", "WITH " + SOFT + """, s AS (SELECT vec_id % 5 AS m, count(*) AS n, count(DISTINCT vec_id) AS d, count(*) FILTER (abs(list_sum(p) - 1) > 1e-9) AS bad FROM p GROUP BY ALL) SELECT m, n, n - d AS n_repeated, bad AS n_invalid, n = (SELECT max(n) FROM s) AS complete FROM s""")
def score_assembly(spark, sf_dir):
    """Rows, repeats and invalid vectors of each model's scores, and whether it has as many as the fullest."""
    p = logits(spark, sf_dir).select("vec_id", (F.col("vec_id") % 5).alias("m"), vectors.softmax(F.col("z")).alias("p"))
    s = p.groupBy("m").agg(F.count("*").alias("n"), F.countDistinct("vec_id").alias("d"), F.sum((~vectors.is_probability(F.col("p"), 64)).cast("long")).alias("n_invalid"))
    most = s.agg(F.max("n").alias("most"))
    return s.crossJoin(F.broadcast(most)).select("m", "n", (F.col("n") - F.col("d")).alias("n_repeated"), "n_invalid", (F.col("n") == F.col("most")).alias("complete"))  # one row


@query("clean_accuracy", "WITH " + LOGITS + " SELECT vec_id % 5 AS m, round(avg((list_position(z, list_max(z)) - 1 = label % 64)::INTEGER), 9) AS accuracy, count(*) AS n FROM z WHERE label IS NOT NULL GROUP BY ALL")
def clean_accuracy(spark, sf_dir):
    rows = logits(spark, sf_dir).where("label IS NOT NULL").select((F.col("vec_id") % 5).alias("m"), (vectors.argmax(F.col("z")) == F.col("label") % 64).cast("int").alias("right"))
    return rows.groupBy("m").agg(R9(F.avg("right")).alias("accuracy"), F.count("*").alias("n"))


@query("option_validity_mask", "WITH z AS (SELECT vec_id, (3 + vec_id % 6)::INTEGER AS n, list_transform(embedding, lambda x: x::DOUBLE)[1:(3 + vec_id % 6)] AS z FROM embeddings WHERE embedding IS NOT NULL), e AS (SELECT vec_id, n, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM z) SELECT vec_id, n, round(list_max(e) / list_sum(e), 9) AS top, len(e)::INTEGER AS n_valid FROM e")
def option_validity_mask(spark, sf_dir):
    """Ragged questions padded to eight options: a mask leaves the padding out of the softmax."""
    n = (3 + F.col("vec_id") % 6).cast("int")
    rows = logits(spark, sf_dir).select("vec_id", n.alias("n"), "z", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: i < n).alias("mask"))
    kept = F.transform(F.filter(F.arrays_zip("z", "mask"), lambda s: s["mask"]), lambda s: s["z"])
    p = rows.select("vec_id", "n", "mask", vectors.softmax(kept).alias("p"))
    return p.select("vec_id", "n", R9(F.array_max("p")).alias("top"), F.size(F.filter("mask", lambda m: m)).alias("n_valid"))


GRID = "grid AS (SELECT k::INTEGER AS k, exp(-2.5 + 0.25 * k) AS temp FROM range(21) g(k))"
TEMPERED = LOGITS.replace("z AS (", "z0 AS (") + """, c0 AS (SELECT vec_id % 5 AS m, i, avg(z[i]) AS c FROM z0, range(1, 65) r(i) GROUP BY ALL), c1 AS (SELECT m, list(c ORDER BY i) AS c, avg(c) AS mean FROM c0 GROUP BY m),
z AS (SELECT vec_id, vec_id % 5 AS m, label % 64 AS gold, vec_id // 5 % 2 AS side, z, list_transform(range(1, 65), lambda i: z[i] - c[i] + mean) AS zb FROM z0 JOIN c1 ON m = vec_id % 5 WHERE label IS NOT NULL), """ + GRID + """,
l AS (SELECT m, k, temp, avg(ln(list_sum(list_transform(z, lambda x: exp((x - list_max(z)) / temp)))) - (z[gold + 1] - list_max(z)) / temp) FILTER (side = 0) AS raw,
  avg(ln(list_sum(list_transform(zb, lambda x: exp((x - list_max(zb)) / temp)))) - (zb[gold + 1] - list_max(zb)) / temp) FILTER (side = 0) AS freed, avg(ln(list_sum(list_transform(z, lambda x: exp((x - list_max(z)) / temp)))) - (z[gold + 1] - list_max(z)) / temp) FILTER (side = 1) AS held FROM z, grid GROUP BY ALL)"""  # fmt: skip
SCALE = [-2.5 + 0.25 * k for k in range(21)]


def tempered(spark, sf_dir):
    """m, k, temp, raw, freed, held: the mean negative log-likelihood of the gold option at each temperature of a grid, of raw logits, of logits without each model's mean by place, and of raw ones on the other half."""
    rows = logits(spark, sf_dir).where("label IS NOT NULL").select((F.col("vec_id") % 5).alias("m"), (F.col("label") % 64).alias("gold"), (F.floor(F.col("vec_id") / 5) % 2).alias("side"), "z")
    means = logits(spark, sf_dir).groupBy((F.col("vec_id") % 5).alias("m")).agg(F.array(*[F.avg(F.get("z", F.lit(i))) for i in range(64)]).alias("c"))
    rows = rows.join(F.broadcast(means), "m").withColumn("zb", F.zip_with("z", "c", lambda z, c: z - c + vectors.total(F.col("c")) / 64))  # 5 rows
    temps = F.array(*[F.struct(F.lit(k).alias("k"), F.exp(F.lit(s)).alias("temp")) for k, s in enumerate(SCALE)])
    rows = rows.select("*", F.explode(temps).alias("t"))

    def nll(c: str):
        top = F.array_max(c)
        return F.log(vectors.total(F.transform(c, lambda x: F.exp((x - top) / F.col("t.temp"))))) - (F.get(c, F.col("gold")) - top) / F.col("t.temp")

    on = lambda s, v: F.avg(F.when(F.col("side") == s, v))
    return rows.groupBy("m", F.col("t.k").alias("k"), F.col("t.temp").alias("temp")).agg(on(0, nll("z")).alias("raw"), on(0, nll("zb")).alias("freed"), on(1, nll("z")).alias("held"))


@query("temperature_after_bias", "WITH " + TEMPERED + " SELECT m, arg_min(k, (round(raw, 10), k)) AS k_raw, arg_min(k, (round(freed, 10), k)) AS k_freed, round(min(raw), 8) AS nll_raw, round(min(freed), 8) AS nll_freed FROM l GROUP BY m")
def temperature_after_bias(spark, sf_dir):
    """Temperatures of a grid that fit best, of raw logits and of logits freed of each model's label bias."""
    best = lambda c: F.min_by("k", F.struct(F.round(c, 10), "k"))
    return tempered(spark, sf_dir).groupBy("m").agg(best("raw").alias("k_raw"), best("freed").alias("k_freed"), F.round(F.min("raw"), 8).alias("nll_raw"), F.round(F.min("freed"), 8).alias("nll_freed"))


@query("calibration_sensitivity", "WITH " + TEMPERED + """, b AS (SELECT m, arg_min(held, (round(raw, 10), k)) AS held_fit, avg(held) FILTER (k = 10) AS held_one FROM l GROUP BY m)
SELECT m, round(held_fit, 8) AS held_fit, round(held_one, 8) AS held_one, held_fit <= held_one AS survives, rank() OVER (ORDER BY round(held_fit, 8))::INTEGER AS place_fit, rank() OVER (ORDER BY round(held_one, 8))::INTEGER AS place_one FROM b""")  # fmt: skip
def calibration_sensitivity(spark, sf_dir):
    """Held-out loss at the fitted temperature and at one, the models' ranks under either, and whether calibration still helps."""
    b = tempered(spark, sf_dir).groupBy("m").agg(F.min_by("held", F.struct(F.round("raw", 10), "k")).alias("held_fit"), F.avg(F.when(F.col("k") == 10, F.col("held"))).alias("held_one"))
    r8 = lambda c: F.round(c, 8)
    place = lambda c: F.rank().over(Window.partitionBy(F.lit(0)).orderBy(r8(c)))  # noqa: E731  one row for each model
    return b.select("m", r8("held_fit").alias("held_fit"), r8("held_one").alias("held_one"), (F.col("held_fit") <= F.col("held_one")).alias("survives"), place("held_fit").alias("place_fit"), place("held_one").alias("place_one"))


@query("interface_sensitivity", "WITH " + CELLS + """, bi AS (SELECT m, i, avg(v) AS b FROM ve GROUP BY ALL), vr AS (SELECT * FROM vw), vc AS (SELECT q, i, CASE WHEN q % 2 = 0 THEN 'fit' ELSE 'eval' END AS side,
  [max(v - b) FILTER (m = 0), max(v - b) FILTER (m = 1), max(v - b) FILTER (m = 2), max(v - b) FILTER (m = 3), max(v - b) FILTER (m = 4)] AS x FROM ve JOIN bi USING (m, i) GROUP BY q, i HAVING count(*) = 5), """ + vector_fit_sql("f") + ", " + vector_fit_sql("c").replace("FROM vw", "FROM vc") + """,
em AS (SELECT t, a, b, avg(abs(x[t + 1] - w * x[a + 1] - (1 - w) * x[b + 1])) AS raw FROM vw, f WHERE side = 'eval' GROUP BY ALL), k AS (SELECT t, a, b, any_value(w) AS w, avg(abs(x[t + 1] - w * x[a + 1] - (1 - w) * x[b + 1])) AS corrected FROM vc, c WHERE side = 'eval' GROUP BY ALL)
SELECT t, a, b, round(raw, 9) AS raw, round(corrected, 9) AS corrected, round(w, 8) AS corrected_weight FROM em JOIN k USING (t, a, b)""")  # fmt: skip
def interface_sensitivity(spark, sf_dir):
    """Fits of responses freed of each model's mean by place, against fits of raw ones."""
    cells = mean_vectors(spark, sf_dir)
    bias = cells.groupBy("m").agg(F.array(*[F.avg(F.get("p", F.lit(i))) for i in range(64)]).alias("b"))
    freed = cells.join(F.broadcast(bias), "m").select("m", "q", F.zip_with("p", "b", lambda p, b: p - b).alias("p"))  # 5 rows
    raw, corrected = vector_wide(spark, sf_dir), vector_wide(spark, sf_dir, freed)

    def error(rows, name: str):
        j = rows.where("side = 'eval'").crossJoin(F.broadcast(fit_vectors(rows)))  # 30 fits
        return j.groupBy("t", "a", "b").agg(R9(F.avg(F.abs(off(F.col("w"))))).alias(name), F.round(F.first("w"), 8).alias(f"{name}_weight"))

    return checks.merge(error(raw, "raw"), error(corrected, "corrected"), ["t", "a", "b"], "1:1").select("t", "a", "b", "raw", "corrected", "corrected_weight")


@query("bias_records", "WITH " + CELLS + ", c AS (SELECT m, i, avg(zv) AS z FROM ve GROUP BY ALL), d AS (SELECT m, i, z - avg(z) OVER (PARTITION BY m) AS b FROM c) SELECT m, list(round(b, 9) ORDER BY i) AS bias, round(abs(sum(b)), 9) AS total FROM d GROUP BY m")
def bias_records(spark, sf_dir):
    """Estimates by place collected into each model's array, in order of place; they sum to zero."""
    c = mean_vectors(spark, sf_dir).select("m", F.posexplode("z").alias("i", "z")).groupBy("m", "i").agg(F.avg("z").alias("z"))
    d = c.withColumn("b", F.col("z") - F.avg("z").over(Window.partitionBy("m")))
    return d.groupBy("m").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", R9("b").alias("b")))), lambda s: s["b"]).alias("bias"), F.abs(F.round(F.sum("b"), 9)).alias("total"))


@query("alignment_subsets", "WITH " + CELLS + """, d AS (SELECT t::INTEGER AS t, p::INTEGER AS p, avg(abs(x[t + 1] - x[p + 1])) AS e FROM vw, range(5) r(t), range(5) s(p) WHERE t <> p GROUP BY ALL), h AS (SELECT t, avg(e) AS mean FROM d GROUP BY t), k AS (SELECT t FROM h QUALIFY row_number() OVER (ORDER BY round(mean, 12), t) <= 4),
u AS (SELECT d.t, min(e) AS whole, min(e) FILTER (p IN (SELECT t FROM k)) AS restricted FROM d GROUP BY d.t) SELECT t, round(whole, 9) AS whole, round(restricted, 9) AS restricted, t IN (SELECT t FROM k) AS aligned, rank() OVER (ORDER BY round(whole, 9))::INTEGER AS place_whole, rank() OVER (ORDER BY round(restricted, 9))::INTEGER AS place_restricted FROM u""")  # fmt: skip
def alignment_subsets(spark, sf_dir):
    """Nearest peers of each target among all models and among the four that agree best with the rest, with ranks under both."""
    cells = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("p"), F.abs(F.get("x", F.lit(t)) - F.get("x", F.lit(p))).alias("d")) for t, p in itertools.permutations(range(5), 2)])
    d = vector_wide(spark, sf_dir).select(F.explode(cells).alias("c")).groupBy("c.t", "c.p").agg(F.avg("c.d").alias("e"))
    one = Window.partitionBy(F.lit(0))  # one row for each model
    k = d.groupBy("t").agg(F.avg("e").alias("mean")).withColumn("aligned", F.row_number().over(one.orderBy(F.round("mean", 12), "t")) <= 4).select("t", "aligned")
    j = d.join(F.broadcast(k.select(F.col("t").alias("p"), "aligned")), "p").groupBy("t").agg(R9(F.min("e")).alias("whole"), R9(F.min(F.when(F.col("aligned"), F.col("e")))).alias("restricted"))
    j = j.join(F.broadcast(k), "t")  # 5 rows
    return j.select("t", "whole", "restricted", "aligned", F.rank().over(one.orderBy("whole")).alias("place_whole"), F.rank().over(one.orderBy("restricted")).alias("place_restricted"))


@query("scale_noise_response", "WITH " + LOGITS + """, y AS (SELECT vec_id, theta, list_sum(list_transform(range(1, 65), lambda i: z[i] * theta * i / 64)) + ('0x' || sha256(concat_ws(chr(31), '17', vec_id::VARCHAR))[1:7])::BIGINT / 268435456.0 - 0.5 AS y FROM z, (VALUES (0.0::DOUBLE), (0.5), (1.0)) t(theta)) SELECT theta, count(*) AS n, round(avg(y), 9) AS mean, round(stddev_samp(y), 9) AS sd FROM y GROUP BY theta""")
def scale_noise_response(spark, sf_dir):
    """A linear model with noise by hash, under an intervention that scales its input; scale one leaves the sample as it is."""
    noise = F.conv(F.substring(stable_key("17", F.col("vec_id").cast("string")), 1, 7), 16, 10).cast("double") / 268435456.0 - 0.5
    rows = logits(spark, sf_dir).select("vec_id", "z", noise.alias("noise"), F.explode(F.array(*[F.lit(x) for x in (0.0, 0.5, 1.0)])).alias("theta"))
    y = vectors.total(F.transform("z", lambda x, i: x * F.col("theta") * (i + 1) / 64)) + F.col("noise")
    return rows.select("theta", y.alias("y")).groupBy("theta").agg(F.count("*").alias("n"), R9(F.avg("y")).alias("mean"), R9(F.stddev_samp("y")).alias("sd"))


ORDERS4 = list(itertools.permutations(range(4)))[1:]


@query("option_permutations", """WITH o(code) AS (SELECT unnest([x.a || x.b || x.c || x.d]) FROM (SELECT a, b, c, d FROM range(4) p(a), range(4) q(b), range(4) r(c), range(4) s(d) WHERE a <> b AND a <> c AND a <> d AND b <> c AND b <> d AND c <> d) x),
g AS (SELECT item_id, code, row_number() OVER (PARTITION BY item_id ORDER BY sha256(concat_ws(chr(31), '23', item_id::VARCHAR, code))[1:16], code) AS h FROM benchmark, o WHERE code <> '0123')
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY code) - 1)::INTEGER AS place, code AS shown, (instr(code, '0') - 1) || '' || (instr(code, '1') - 1) || (instr(code, '2') - 1) || (instr(code, '3') - 1) AS back FROM g WHERE h <= 3""")  # fmt: skip
def option_permutations(spark, sf_dir):
    """Three different orders of each item's four options, none of them its own, by hash, with the way back."""
    made = F.array(*[F.struct(F.lit("".join(map(str, p))).alias("shown"), F.lit("".join(str(p.index(i)) for i in range(4))).alias("back")) for p in ORDERS4])
    order = F.array_sort(F.transform(made, lambda s: F.struct(stable_key("23", F.col("item_id").cast("string"), s["shown"]).alias("h"), s["shown"].alias("shown"), s["back"].alias("back"))))
    first = F.array_sort(F.transform(F.slice(order, 1, 3), lambda s: F.struct(s["shown"].alias("shown"), s["back"].alias("back"))))
    return table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(first).alias("place", "o")).select("item_id", "place", "o.shown", "o.back")


@query("generation_subset", """WITH g AS (SELECT item_id, item_id % 4 AS category, row_number() OVER (PARTITION BY item_id % 4 ORDER BY sha256(concat_ws(chr(31), '29', (item_id % 4)::VARCHAR, item_id::VARCHAR))[1:16], item_id) AS h FROM benchmark)
SELECT category, item_id, condition, sha256(concat_ws(chr(31), item_id::VARCHAR, condition))[1:16] AS prompt_id FROM g, (VALUES ('clean'), ('context'), ('deletion')) c(condition) WHERE h <= 5""")  # fmt: skip
def generation_subset(spark, sf_dir):
    """Five items of each category in hash order, under three conditions, with their prompts' ids."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", (F.col("item_id") % 4).alias("category"))
    w = Window.partitionBy("category").orderBy(stable_key("29", F.col("category").cast("string"), F.col("item_id").cast("string")), "item_id")
    rows = rows.withColumn("h", F.row_number().over(w)).where("h <= 5").withColumn("condition", F.explode(F.array(F.lit("clean"), F.lit("context"), F.lit("deletion"))))
    return rows.select("category", "item_id", "condition", stable_key(F.col("item_id").cast("string"), F.col("condition")).alias("prompt_id"))


@query("question_gate", """SELECT item_id % 4 AS stratum, count(*) AS n, count(*) FILTER (text IS NULL OR text = '') AS n_empty, (count(*) - count(DISTINCT item_id))::BIGINT AS n_repeated, min(length(text)) AS shortest, max(length(text)) AS longest FROM benchmark GROUP BY ALL""")
def question_gate(spark, sf_dir):
    """Rows, empty texts, repeated ids and bounds of each stratum of the items."""
    b = table(spark, sf_dir, "benchmark").withColumn("stratum", F.col("item_id") % 4)
    return b.groupBy("stratum").agg(F.count("*").alias("n"), F.sum((F.coalesce(F.length("text"), F.lit(0)) == 0).cast("long")).alias("n_empty"), (F.count("*") - F.countDistinct("item_id")).alias("n_repeated"), F.min(F.length("text")).cast("long").alias("shortest"), F.max(F.length("text")).cast("long").alias("longest"))


@query("normalized_rows", """SELECT CASE WHEN k = 0 THEN conv_id::VARCHAR ELSE conv_id || '--' || k END AS id, n_chars FROM (SELECT conv_id, length(trim(text)) AS n_chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations)""")
def normalized_rows(spark, sf_dir):
    """Rows whose text has one of three names, as one column; repeated ids get their number as a suffix."""
    c = table(spark, sf_dir, "conversations")
    named = [F.when(F.col("turn") % 3 == i, F.col("text")).alias(n) for i, n in enumerate(("question", "query", "prompt"))]
    raw = c.select("conv_id", "turn", F.to_json(F.struct(*named)).alias("row"))
    found = F.coalesce(*[F.get_json_object("row", f"$.{n}") for n in ("question", "query", "prompt")])
    k = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    rows = raw.select("conv_id", F.length(F.trim(found)).cast("long").alias("n_chars"), k.alias("k"))
    return rows.select(F.when(F.col("k") == 0, F.col("conv_id").cast("string")).otherwise(F.concat_ws("--", F.col("conv_id").cast("string"), F.col("k").cast("string"))).alias("id"), "n_chars")


ANSWERS = """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN (o_orderkey % 9)::VARCHAR WHEN 1 THEN substr('ABCDEFGHIJ', (o_orderkey % 10 + 1)::INTEGER, 1) WHEN 2 THEN ' ' || lower(substr('ABCDEFGHIJ', (o_orderkey % 10 + 1)::INTEGER, 1)) || ' ' ELSE o_orderstatus END AS raw, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 6 END AS answer_index FROM orders"""


@query("answer_index", "WITH a AS (" + ANSWERS + """) SELECT o_orderkey, CASE WHEN answer_index BETWEEN 0 AND 4 THEN answer_index WHEN upper(trim(raw)) IN ('A', 'B', 'C', 'D', 'E') THEN ascii(upper(trim(raw))) - 65 WHEN trim(raw) IN ('0', '1', '2', '3', '4') THEN trim(raw)::INTEGER END::INTEGER AS answer FROM a""")
def answer_index(spark, sf_dir):
    """The place of an answer among five options: a valid integer field, else a letter, else a digit, else null."""
    key = F.col("o_orderkey")
    letter = F.substring(F.lit("ABCDEFGHIJ"), (key % 10 + 1).cast("int"), F.lit(1))
    raw = F.when(key % 4 == 0, (key % 9).cast("string")).when(key % 4 == 1, letter).when(key % 4 == 2, F.concat(F.lit(" "), F.lower(letter), F.lit(" "))).otherwise(F.col("o_orderstatus"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.upper(F.trim(raw)).alias("raw"), F.when(key % 5 == 0, key % 6).alias("i"))
    answer = F.when(F.col("i").between(0, 4), F.col("i")).when(F.col("raw").rlike("^[A-E]$"), F.ascii("raw") - 65).when(F.col("raw").rlike("^[0-4]$"), F.expr("try_cast(raw AS int)"))
    return rows.select("o_orderkey", answer.cast("int").alias("answer"))


@query("error_code_filter", """WITH e AS (SELECT event_type, value, CASE WHEN event_id % 7 = 0 THEN NULL ELSE (props::JSON->>'$.k')::INTEGER % 3 END AS error FROM events) SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM e WHERE coalesce(error, 0) = 0 GROUP BY event_type""")
def error_code_filter(spark, sf_dir):
    """Rows without an error code, or with code zero."""
    error = F.when(F.col("event_id") % 7 != 0, F.get_json_object("props", "$.k").cast("int") % 3)
    rows = table(spark, sf_dir, "events").withColumn("error", F.coalesce(error, F.lit(0))).where("error = 0")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("constant_columns", """SELECT 'o_orderstatus' AS name, 'F' AS expected, count(*) AS n, count(*) FILTER (o_orderstatus IS DISTINCT FROM 'F') AS n_bad FROM orders UNION ALL SELECT 'n_regionkey_known', 'true', count(*), count(*) FILTER (n_regionkey IS NULL) FROM nation""")
def constant_columns(spark, sf_dir):
    """Rows of a column that differ from the literal that all should be."""
    bad = lambda df, name, expected, value: df.agg(F.lit(name).alias("name"), F.lit(expected).alias("expected"), F.count("*").alias("n"), F.sum((~value.eqNullSafe(F.lit(expected))).cast("long")).alias("n_bad"))
    return bad(table(spark, sf_dir, "orders"), "o_orderstatus", "F", F.col("o_orderstatus")).unionByName(bad(table(spark, sf_dir, "nation"), "n_regionkey_known", "true", F.col("n_regionkey").isNotNull().cast("string")))


@query("model_groups", """SELECT CASE WHEN p_name LIKE '%red%' THEN 'Robust' WHEN p_name LIKE '%ring%' OR p_name LIKE '%widget%' THEN 'Transformer' ELSE 'Standard' END AS grp, count(*) AS n, round(avg(p_retailprice), 6) AS mean FROM part GROUP BY ALL""")
def model_groups(spark, sf_dir):
    name = F.col("p_name")
    grp = F.when(name.contains("red"), "Robust").when(name.contains("ring") | name.contains("widget"), "Transformer").otherwise("Standard")
    return table(spark, sf_dir, "part").groupBy(grp.alias("grp")).agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 6).alias("mean"))


@query("low_similarity_prefix", """WITH k AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY abs(p_size - 25) / 50.0, p_partkey) AS place, count(*) OVER (PARTITION BY p_brand) AS n FROM part) SELECT p_brand, p_partkey, place::INTEGER AS place FROM k WHERE place <= greatest(4, ceil(0.25 * n))""")
def low_similarity_prefix(spark, sf_dir):
    """Of each brand the quarter of parts of least similarity, four at least, in order of (similarity, key)."""
    w = Window.partitionBy("p_brand")
    k = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.row_number().over(w.orderBy(F.abs(F.col("p_size") - 25) / 50.0, "p_partkey")).alias("place"), F.count("*").over(w).alias("n"))
    return k.where(F.col("place") <= F.greatest(F.lit(4), F.ceil(0.25 * F.col("n")))).select("p_brand", "p_partkey", "place")


@query("provenance_join", """SELECT r_name AS panel, string_agg(n_name, ';' ORDER BY n_nationkey) AS sources, count(*) AS n_sources, sum(c.n)::BIGINT AS n_rows FROM region JOIN nation ON n_regionkey = r_regionkey JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY ALL) c ON c_nationkey = n_nationkey GROUP BY r_name""")
def provenance_join(spark, sf_dir):
    """Every panel with its sources in order and their rows; customers are counted before they are joined."""
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    n = checks.merge(table(spark, sf_dir, "nation"), c, ["n_nationkey"], "1:1").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 5 rows
    order = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda s: s["n_name"])
    return n.groupBy(F.col("r_name").alias("panel")).agg(F.array_join(order, ";").alias("sources"), F.count("*").alias("n_sources"), F.sum("n").alias("n_rows"))


@query("stage_markers", """WITH m AS (SELECT o_orderpriority AS stage, count(*) AS n, sum(hash_) AS h FROM (SELECT o_orderpriority, ('0x' || sha256(o_orderkey::VARCHAR)[1:7])::BIGINT AS hash_ FROM orders) GROUP BY ALL), t AS (SELECT stage, n + CASE WHEN stage LIKE '1%' THEN 1 ELSE 0 END AS n, h + CASE WHEN stage LIKE '2%' THEN 1 ELSE 0 END AS h FROM m WHERE stage NOT LIKE '3%')
SELECT m.stage, CASE WHEN t.stage IS NULL THEN 'absent' WHEN m.n <> t.n THEN 'rows differ' WHEN m.h <> t.h THEN 'hash differs' ELSE 'valid' END AS state FROM m LEFT JOIN t USING (stage)""")  # fmt: skip
def stage_markers(spark, sf_dir):
    """A stage is valid if its marker's row count and hash are those of its output; markers here lack one stage and are wrong in two."""
    h = F.conv(F.substring(F.sha2(F.col("o_orderkey").cast("string"), 256), 1, 7), 16, 10).cast("long")
    m = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("stage")).agg(F.count("*").alias("n"), F.sum(h).alias("h"))
    at = lambda d: F.col("stage").startswith(d).cast("long")
    marked = m.where(~F.col("stage").startswith("3")).select("stage", (F.col("n") + at("1")).alias("n2"), (F.col("h") + at("2")).alias("h2"))
    j = checks.merge(m, marked, ["stage"], "1:1", "left")
    return j.select("stage", F.when(F.col("n2").isNull(), "absent").when(F.col("n") != F.col("n2"), "rows differ").when(F.col("h") != F.col("h2"), "hash differs").otherwise("valid").alias("state"))


@query("sentiment_buckets", "WITH " + LOGITS + """, s AS (SELECT vec_id, 1 / (1 + exp(-8 * z[1])) AS p FROM z) SELECT CASE WHEN p <= 0.2 THEN 'negative' WHEN p >= 0.8 THEN 'positive' ELSE 'ambiguous' END AS bucket, count(*) AS n, round(avg(p), 9) AS mean FROM s GROUP BY ALL""")
def sentiment_buckets(spark, sf_dir):
    """Rows by the strength of a positive-class probability."""
    p = logits(spark, sf_dir).select((1 / (1 + F.exp(-8 * F.get("z", F.lit(0))))).alias("p"))
    return p.groupBy(text.bucket_sentiment(F.col("p")).alias("bucket")).agg(F.count("*").alias("n"), R9(F.avg("p")).alias("mean"))


@query("rotation_zero_audit", "WITH " + SOFT + """, m AS (SELECT DISTINCT doc_id AS vec_id, doc_id % 3 = 0 AS wrong FROM labels WHERE doc_id IS NOT NULL), j AS (SELECT m.vec_id, p.p IS NULL AS missing, m.wrong AND p.p IS NOT NULL AS differs FROM m LEFT JOIN p USING (vec_id))
SELECT vec_id % 5 AS m, count(*) AS n, count(*) FILTER (missing) AS n_missing, count(*) FILTER (differs) AS n_differ FROM j GROUP BY ALL""")  # fmt: skip
def rotation_zero_audit(spark, sf_dir):
    """Stored vectors against what a manifest expects by digest: missing ones, and ones that differ (every third digest is made wrong here)."""
    p = logits(spark, sf_dir).select("vec_id", F.sha2(F.array_join(F.transform("z", lambda x: x.cast("string")), ","), 256).alias("stored"))
    named = table(spark, sf_dir, "labels").where("doc_id IS NOT NULL").select(F.col("doc_id").alias("vec_id")).distinct().join(p, "vec_id", "left")
    expected = F.when(F.col("vec_id") % 3 == 0, F.lit("other")).otherwise(F.col("stored"))
    j = named.select("vec_id", F.col("stored").isNull().alias("missing"), (F.col("stored") != expected).alias("differs"))
    n = lambda c: F.sum(F.coalesce(F.col(c), F.lit(False)).cast("long"))
    return j.groupBy((F.col("vec_id") % 5).alias("m")).agg(F.count("*").alias("n"), n("missing").alias("n_missing"), n("differs").alias("n_differ"))


@query("refit_chunks", """SELECT t::INTEGER AS t, a::INTEGER AS a, b::INTEGER AS b, c::INTEGER AS chunk, (c * 20)::INTEGER AS first, least(c * 20 + 20, 1000)::INTEGER AS upto, sha256(concat_ws(chr(31), '41', t::VARCHAR, a::VARCHAR, b::VARCHAR, c::VARCHAR))[1:16] AS seed FROM range(5) q(t), range(5) r(a), range(5) s(b), range(50) k(c) WHERE a < b AND t <> a AND t <> b""")
def refit_chunks(spark, sf_dir):
    """Jobs of twenty replicates each for every target and pair, with their seeds: what a resumable run has to finish."""
    jobs = spark.createDataFrame(TRIPLES, "t int, a int, b int").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(49))))
    seed = stable_key("41", *[F.col(c).cast("string") for c in ("t", "a", "b", "chunk")])
    return jobs.select("*", (F.col("chunk") * 20).alias("first"), F.least(F.col("chunk") * 20 + 20, F.lit(1000)).alias("upto"), seed.alias("seed"))


CALIBRATED = TEMPERED + """, bt AS (SELECT m, arg_min(temp, (round(raw, 10), k)) AS temp FROM l GROUP BY m), se AS (SELECT vec_id, m, list_transform(z, lambda x: exp((x - list_max(z)) / temp)) AS e FROM (SELECT vec_id, vec_id % 5 AS m, z FROM z0) JOIN bt USING (m)),
ve AS (SELECT m::INTEGER AS m, vec_id // 5 % 40 AS q, i::INTEGER AS i, avg(e[i] / list_sum(e)) AS v FROM se, range(1, 65) r(i) GROUP BY ALL),
vw AS""" + CELLS.split("vw AS")[1]  # fmt: skip


def calibrated_wide(spark, sf_dir):
    """The vectors of ``vector_wide`` under each model's fitted temperature, which is held fixed from here on."""
    best = tempered(spark, sf_dir).groupBy("m").agg(F.min_by("temp", F.struct(F.round("raw", 10), "k")).alias("temp"))
    rows = logits(spark, sf_dir).select((F.col("vec_id") % 5).alias("m"), (F.floor(F.col("vec_id") / 5) % 40).alias("q"), "z").join(F.broadcast(best), "m")  # 5 rows
    p = vectors.normalized(vectors.let(F.array_max("z"), lambda top: F.transform("z", lambda x: F.exp((x - top) / F.col("temp")))))
    cells = rows.select(F.col("m").cast("int").alias("m"), "q", p.alias("p")).groupBy("m", "q").agg(F.array(*[F.avg(F.get("p", F.lit(i))) for i in range(64)]).alias("p"))
    return vector_wide(spark, sf_dir, staged(spark, ("calibrated", sf_dir), lambda: cells))


@query("calibrated_vector_fit", "WITH " + CALIBRATED + ", " + vector_fit_sql("f") + f" SELECT t, a, b, round(any_value(w), 8) AS weight, round(avg(tv), 8) AS mean_tv FROM {tv_sql('f')} GROUP BY t, a, b")
def calibrated_vector_fit(spark, sf_dir):
    """Fits of vectors whose models are calibrated first."""
    rows = calibrated_wide(spark, sf_dir)
    return judged(rows, fit_vectors(rows)).groupBy("t", "a", "b").agg(F.round(F.first("w"), 8).alias("weight"), F.round(F.avg("tv"), 8).alias("mean_tv"))


QDRAW = """qd AS (SELECT q, replicate::INTEGER AS replicate, ('0x' || sha256(concat_ws(chr(31), '53', replicate::VARCHAR, q::VARCHAR))[1:7])::BIGINT % 20 AS pick, side FROM (SELECT DISTINCT q, side FROM vw), range(20) r(replicate)),
qm AS (SELECT x.q, x.replicate, count(d.q) AS n FROM qd x LEFT JOIN qd d ON d.replicate = x.replicate AND d.side = x.side AND d.pick = x.q // 2 GROUP BY ALL)"""  # fmt: skip


@query("calibrated_bootstrap", "WITH " + CALIBRATED + ", " + QDRAW + """, kf AS (SELECT replicate, t, a, b, least(greatest(sum(n * (x[t + 1] - x[b + 1]) * (x[a + 1] - x[b + 1])) / sum(n * (x[a + 1] - x[b + 1]) ** 2), 0), 1) AS w FROM vw JOIN qm USING (q), tri WHERE side = 'fit' GROUP BY ALL),
ke AS (SELECT replicate, t, a, b, sum(n * abs(x[t + 1] - w * x[a + 1] - (1 - w) * x[b + 1])) / sum(n) AS e FROM vw JOIN qm USING (q) JOIN kf USING (replicate) WHERE side = 'eval' GROUP BY ALL)
SELECT t, a, b, round(avg(e), 9) AS mean, round(quantile_cont(e, 0.025), 9) AS low, round(quantile_cont(e, 0.975), 9) AS high, count(*) AS n_replicates FROM ke GROUP BY ALL""")  # fmt: skip
def calibrated_bootstrap(spark, sf_dir):
    """Refit intervals of calibrated responses: temperatures stay fixed while either half of the questions is drawn again."""
    rows = calibrated_wide(spark, sf_dir)
    q = rows.select("q", "side").distinct().withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(19))))
    q = q.withColumn("pick", draw(F.lit(20), "53", F.col("replicate").cast("string"), F.col("q").cast("string")))
    n = q.groupBy("replicate", "side", F.col("pick").alias("half")).agg(F.count("*").alias("n"))
    m = q.select("q", "replicate", "side", F.floor(F.col("q") / 2).cast("int").alias("half")).join(n, ["replicate", "side", "half"], "left").select("q", "replicate", F.coalesce("n", F.lit(0)).alias("n"))
    j = rows.join(m, "q")
    fits = pair_fits(j.where("side = 'fit'"), ["replicate"], weight="n").withColumnRenamed("wa", "w")
    e = j.where("side = 'eval'").join(fits, "replicate").groupBy("replicate", "t", "a", "b").agg((F.sum(F.col("n") * F.abs(off(F.col("w")))) / F.sum("n")).alias("e"))
    return e.groupBy("t", "a", "b").agg(R9(F.avg("e")).alias("mean"), R9(F.percentile("e", F.lit(0.025))).alias("low"), R9(F.percentile("e", F.lit(0.975))).alias("high"), F.count("*").alias("n_replicates"))
