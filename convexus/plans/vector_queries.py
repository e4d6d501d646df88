"""Queries over probability vectors and stable hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hashing, vectors
from ..registry import query
from ..sources.tables import table


def logits(spark: SparkSession, sf_dir: str, n: int = 64) -> DataFrame:
    """vec_id, label and the components, of which there are n, as doubles."""
    rows = table(spark, sf_dir, "embeddings").where(F.col("embedding").isNotNull())
    return rows.select("vec_id", "label", F.transform(F.slice("embedding", 1, n), lambda x: x.cast("double")).alias("z"))


LOGITS = "z AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS z FROM embeddings WHERE embedding IS NOT NULL)"
SOFT = LOGITS + """, e AS (SELECT vec_id, label, z, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM z),
p AS (SELECT vec_id, label, z, list_transform(e, lambda x: x / list_sum(e)) AS p FROM e)"""  # fmt: skip


@query("hash_keys", """
SELECT o_orderkey, sha256(concat_ws(chr(31), '20260828', o_orderpriority, o_orderkey::VARCHAR))[1:16] AS stable_key,
  ('0x' || sha256(concat_ws(chr(31), '20260828', o_orderpriority, o_orderkey::VARCHAR))[9:16])::BIGINT AS seed32,
  ('0x' || md5(concat_ws('|', '7', o_orderstatus, '0.250000', o_orderkey::VARCHAR))[1:8])::BIGINT AS dose_seed,
  sha1('{"k":' || o_orderkey || '}')[1:12] AS config_hash, replace(replace(o_orderpriority, '/', '__'), ' ', '_') AS slug
FROM orders""")  # fmt: skip
def hash_keys(spark, sf_dir):
    """Stable keys, seeds and slugs of orders."""
    rows = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    return rows.select(
        "o_orderkey",
        hashing.stable_key("20260828", F.col("o_orderpriority"), key).alias("stable_key"),
        hashing.stable_seed("20260828", F.col("o_orderpriority"), key).alias("seed32"),
        hashing.dose_seed(7, F.col("o_orderstatus"), F.lit(0.25), key).alias("dose_seed"),
        hashing.config_hash(F.to_json(F.struct(F.col("o_orderkey").alias("k")))).alias("config_hash"),
        hashing.slug(F.col("o_orderpriority")).alias("slug"),
    )


@query("softmax_temperature", "WITH " + LOGITS + """, e AS (SELECT vec_id, list_transform(z, lambda x: exp((x - list_max(z)) / 0.5)) AS e FROM z)
SELECT vec_id, (i - 1)::INTEGER AS i, round(e[i] / list_sum(e), 9) AS p FROM e, range(1, 65) r(i)""")  # fmt: skip
def softmax_temperature(spark, sf_dir):
    """Softmax at temperature 0.5, one row per component."""
    rows = logits(spark, sf_dir).select("vec_id", F.posexplode(vectors.softmax(F.col("z"), 0.5)).alias("i", "p"))
    return rows.select("vec_id", "i", F.round("p", 9).alias("p"))


@query("scatter_remap", "WITH " + SOFT + """
SELECT vec_id, i::INTEGER AS i, round(p[((i - vec_id % 64 + 64) % 64 + 1)::INTEGER], 9) AS semantic, round(p[((i + vec_id) % 64 + 1)::INTEGER], 9) AS visible FROM p, range(0, 64) r(i)""")  # fmt: skip
def scatter_remap(spark, sf_dir):
    """Visible to semantic order by a cyclic mapping, and back."""
    p = logits(spark, sf_dir).withColumn("p", vectors.softmax(F.col("z"))).withColumn("map", vectors.cyclic(F.lit(64), (F.col("vec_id") % 64).cast("int")))
    both = p.select("vec_id", F.arrays_zip(vectors.scatter(F.col("p"), F.col("map")).alias("s"), vectors.gather(F.col("p"), F.col("map")).alias("v")).alias("a"))
    return both.select("vec_id", F.posexplode("a").alias("i", "a")).select("vec_id", "i", F.round("a.s", 9).alias("semantic"), F.round("a.v", 9).alias("visible"))


ROTATED = SOFT + """, r AS (SELECT p.vec_id, p.label, r.r, i.i, p[((i.i + r.r) % 64 + 1)::INTEGER] * (1 + 0.01 * r.r * i.i) AS v FROM p, range(0, 4) r(r), range(0, 64) i(i)),
n AS (SELECT vec_id, label, r, i, v / sum(v) OVER (PARTITION BY vec_id, r) AS v FROM r),
a AS (SELECT vec_id, label, i, avg(v) AS a FROM n GROUP BY ALL)"""  # fmt: skip


@query("cyclic_rotation_average", "WITH " + ROTATED + """
, t AS (SELECT n.vec_id, n.r, 0.5 * sum(abs(v - a)) AS tv FROM n JOIN a USING (vec_id, i) GROUP BY ALL),
g AS (SELECT vec_id, stddev_pop(v) AS gold_sd, avg(v) AS gold FROM n WHERE i = label % 64 GROUP BY ALL)
SELECT vec_id, round(avg(tv), 9) AS mean_tv, round(max(tv), 9) AS max_tv, round(any_value(gold), 9) AS gold, round(any_value(gold_sd), 9) AS gold_sd, count(*) AS rotations
FROM t JOIN g USING (vec_id) GROUP BY vec_id""")  # fmt: skip
def cyclic_rotation_average(spark, sf_dir):
    """Mean vector over four rotations of each row, the rotations' distance to it and the spread of the gold probability.

    One pass per row: all rotations of a row are array elements, so nothing is shuffled."""
    p = logits(spark, sf_dir).withColumn("p", vectors.softmax(F.col("z")))

    def rotation(r: int):
        raw = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.get("p", (i + r) % 64) * (1 + 0.01 * r * i))
        return vectors.normalized(raw)

    rows = p.select("vec_id", (F.col("label") % 64).alias("g"), F.array(*[rotation(r) for r in range(4)]).alias("rot"))
    mean = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: vectors.total(F.transform("rot", lambda v: F.get(v, i))) / 4)
    rows = rows.withColumn("mean", mean)
    rows = rows.withColumn("tv", F.transform("rot", lambda v: vectors.total_variation(v, F.col("mean")))).withColumn("gold", F.get("mean", F.col("g")))
    sd = F.sqrt(vectors.total(F.transform("rot", lambda v: F.pow(F.get(v, F.col("g")) - F.col("gold"), 2))) / 4)
    return rows.select("vec_id", F.round(vectors.total(F.col("tv")) / 4, 9).alias("mean_tv"), F.round(F.array_max("tv"), 9).alias("max_tv"), F.round("gold", 9).alias("gold"), F.round(sd, 9).alias("gold_sd"), F.size("rot").cast("long").alias("rotations"))


PAIRS = SOFT + """, q AS (SELECT vec_id, label, p, lead(vec_id) OVER w AS partner, lead(p) OVER w AS q FROM p WINDOW w AS (PARTITION BY label, vec_id // 100 ORDER BY vec_id)),
u AS (SELECT vec_id, partner, label, i, p[i] AS a, q[i] AS b, p, q FROM q, range(1, 65) r(i) WHERE partner IS NOT NULL)"""  # fmt: skip


def neighbour_pairs(spark, sf_dir) -> DataFrame:
    """Each vector with the next of its label and hundred of ids: the windows have 100 rows at most per label."""
    p = logits(spark, sf_dir).withColumn("p", vectors.softmax(F.col("z")))
    w = Window.partitionBy("label", F.floor(F.col("vec_id") / 100)).orderBy("vec_id")
    return p.select("vec_id", "label", "p", F.lead("vec_id").over(w).alias("partner"), F.lead("p").over(w).alias("q")).where("partner IS NOT NULL")


@query("tv_js_agreement", "WITH " + PAIRS + """
SELECT vec_id, partner, round(0.5 * sum(abs(a - b)), 9) AS tv,
  round(0.5 * sum(a * ln(2 * a / (a + b))) + 0.5 * sum(b * ln(2 * b / (a + b))), 9) AS js,
  (list_position(any_value(p), list_max(any_value(p))) = list_position(any_value(q), list_max(any_value(q))))::INTEGER AS top1,
  ((list_position(any_value(p), list_max(any_value(p))) - 1 = any_value(label) % 64) = (list_position(any_value(q), list_max(any_value(q))) - 1 = any_value(label) % 64))::INTEGER AS correctness
FROM u GROUP BY vec_id, partner""")  # fmt: skip
def tv_js_agreement(spark, sf_dir):
    """Total variation, Jensen-Shannon divergence, agreement of the top option and of being correct."""
    pairs, p, q, gold = neighbour_pairs(spark, sf_dir), F.col("p"), F.col("q"), F.col("label") % 64
    return pairs.select("vec_id", "partner", F.round(vectors.total_variation(p, q), 9).alias("tv"), F.round(vectors.jensen_shannon(p, q), 9).alias("js"), (vectors.argmax(p) == vectors.argmax(q)).cast("int").alias("top1"), ((vectors.argmax(p) == gold) == (vectors.argmax(q) == gold)).cast("int").alias("correctness"))


@query("vector_group_metrics", "WITH " + PAIRS + """, m AS (SELECT vec_id, label, 0.5 * sum(abs(a - b)) AS tv FROM u GROUP BY ALL)
SELECT label, count(*) AS n, count(DISTINCT vec_id) AS n_distinct, round(avg(tv), 9) AS mean_tv, round(max(tv), 9) AS max_tv FROM m GROUP BY label""")  # fmt: skip
def vector_group_metrics(spark, sf_dir):
    """Instance metrics summed up by label."""
    pairs = neighbour_pairs(spark, sf_dir).withColumn("tv", vectors.total_variation(F.col("p"), F.col("q")))
    return pairs.groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("vec_id").alias("n_distinct"), F.round(F.avg("tv"), 9).alias("mean_tv"), F.round(F.max("tv"), 9).alias("max_tv"))


@query("weight_geometry", "WITH " + SOFT + """
SELECT vec_id, round(list_max(p), 9) AS top1_mass, round(list_sum(list_sort(p, 'DESC')[1:3]), 9) AS top3_mass,
  round(1 / list_sum(list_transform(p, lambda x: x * x)), 9) AS effective_peers, round(-list_sum(list_transform(p, lambda x: x * ln(x))), 9) AS entropy,
  round(-list_sum(list_transform(p, lambda x: x * ln(x))) / ln(64), 9) AS entropy_normalized, len(list_filter(p, lambda x: x > 0.015625))::INTEGER AS support
FROM p""")  # fmt: skip
def weight_geometry(spark, sf_dir):
    """Mass, effective number, entropy and support of weights."""
    p = logits(spark, sf_dir).select("vec_id", vectors.softmax(F.col("z")).alias("p"))
    h, col = vectors.entropy(F.col("p")), F.col("p")
    return p.select("vec_id", F.round(F.array_max("p"), 9).alias("top1_mass"), F.round(vectors.top_mass(col, 3), 9).alias("top3_mass"), F.round(1 / vectors.total(col, lambda x: x * x), 9).alias("effective_peers"), F.round(h, 9).alias("entropy"), F.round(h / F.log(F.lit(64.0)), 9).alias("entropy_normalized"), vectors.support(col, 0.015625).alias("support"))


@query("weight_change", "WITH " + PAIRS + """
SELECT vec_id, partner, round(sum(abs(a - b)), 9) AS l1, round(sqrt(sum((a - b) * (a - b))), 9) AS l2 FROM u GROUP BY vec_id, partner""")  # fmt: skip
def weight_change(spark, sf_dir):
    pairs = neighbour_pairs(spark, sf_dir)
    return pairs.select("vec_id", "partner", F.round(vectors.l1(F.col("p"), F.col("q")), 9).alias("l1"), F.round(vectors.l2(F.col("p"), F.col("q")), 9).alias("l2"))


@query("response_scalarizer", "WITH " + SOFT + """
SELECT vec_id, round(p[label % 64 + 1], 9) AS gold_probability, round(z[label % 64 + 1] - list_max(list_concat(z[1:label % 64], z[label % 64 + 2:64])), 9) AS margin,
  (list_position(p, list_max(p)) - 1)::INTEGER AS answer, round(exp(2 * least(greatest(z[1], -5), 5)) / (exp(2 * least(greatest(z[1], -5), 5)) + 1) * 2 - 1, 9) AS tanh_first
FROM p""")  # fmt: skip
def response_scalarizer(spark, sf_dir):
    """Gold probability, logit margin, answer and a bounded first component."""
    rows = logits(spark, sf_dir).withColumn("p", vectors.softmax(F.col("z"))).withColumn("g", F.col("label") % 64)
    return rows.select("vec_id", F.round(F.get("p", F.col("g")), 9).alias("gold_probability"), F.round(vectors.margin(F.col("z"), F.col("g")), 9).alias("margin"), vectors.argmax(F.col("p")).alias("answer"), F.round(F.tanh(F.get("z", F.lit(0))), 9).alias("tanh_first"))


@query("clip_renormalize", "WITH " + SOFT + """, c AS (SELECT vec_id, list_transform(p, lambda x: greatest(least(x, 1.0), 0.1)) AS c FROM p)
SELECT vec_id, (i - 1)::INTEGER AS i, round(c[i] / list_sum(c), 9) AS p FROM c, range(1, 65) r(i)""")  # fmt: skip
def clip_renormalize(spark, sf_dir):
    rows = logits(spark, sf_dir).select("vec_id", F.posexplode(vectors.clip_renormalize(vectors.softmax(F.col("z")), 0.1)).alias("i", "p"))
    return rows.select("vec_id", "i", F.round("p", 9).alias("p"))


@query("simplex_projection", "WITH " + LOGITS + """, s AS (SELECT vec_id, z, list_sort(z, 'DESC') AS s FROM z),
t AS (SELECT vec_id, max((list_sum(s[1:k]) - 1) / k) AS theta FROM s, range(1, 65) r(k) GROUP BY vec_id)
SELECT z.vec_id, (i - 1)::INTEGER AS i, round(greatest(z[i] - theta, 0), 9) AS w FROM z JOIN t USING (vec_id), range(1, 65) r(i)""")  # fmt: skip
def simplex_projection(spark, sf_dir):
    rows = logits(spark, sf_dir).select("vec_id", F.posexplode(vectors.simplex_projection(F.col("z"))).alias("i", "w"))
    return rows.select("vec_id", "i", F.round("w", 9).alias("w"))


@query("probability_validator", "WITH " + SOFT + """
SELECT label, count(*) AS n, count(*) FILTER (abs(list_sum(p) - 1) <= 1e-9 AND len(p) = 64 AND list_min(p) >= 0) AS n_valid,
  count(*) FILTER (list_min(z) >= 0 AND abs(list_sum(z) - 1) <= 1e-9) AS n_valid_logits FROM p GROUP BY label""")  # fmt: skip
def probability_validator(spark, sf_dir):
    rows = logits(spark, sf_dir).withColumn("p", vectors.softmax(F.col("z")))
    ok = lambda c: F.sum(vectors.is_probability(F.col(c), 64).cast("int"))
    return rows.groupBy("label").agg(F.count("*").alias("n"), ok("p").alias("n_valid"), ok("z").alias("n_valid_logits"))


@query("answer_entropy", "WITH " + SOFT + """, c AS (SELECT label, list_position(p, list_max(p)) AS a, count(*) AS n FROM p GROUP BY ALL),
f AS (SELECT label, n / sum(n) OVER (PARTITION BY label) AS f, n, a FROM c)
SELECT label, round(-sum(f * ln(f)), 9) AS entropy, sum(n)::BIGINT AS n, (arg_max(a, n * 100 - a) - 1)::INTEGER AS modal_answer, round(max(f), 9) AS modal_share FROM f GROUP BY label""")  # fmt: skip
def answer_entropy(spark, sf_dir):
    """Entropy, mode (ties to the smaller) and modal share of the answers of each label."""
    rows = logits(spark, sf_dir).select("label", vectors.argmax(F.col("z")).alias("a"))
    counts = rows.groupBy("label", "a").agg(F.count("*").alias("n"))
    f = counts.withColumn("f", F.col("n") / F.sum("n").over(Window.partitionBy("label")))
    return f.groupBy("label").agg(F.round(-F.sum(F.col("f") * F.log("f")), 9).alias("entropy"), F.sum("n").alias("n"), F.max_by("a", F.struct("n", -F.col("a"))).alias("modal_answer"), F.round(F.max("f"), 9).alias("modal_share"))


@query("permutation_balance", "WITH " + LOGITS + """
SELECT ((i + r) % 64)::INTEGER AS visible, i::INTEGER AS semantic, count(*) AS n FROM z, range(0, 64) r(r), range(0, 64) q(i) GROUP BY ALL""")  # fmt: skip
def permutation_balance(spark, sf_dir):
    """How often each option comes at each place over all cyclic rotations."""
    rows = logits(spark, sf_dir).select(F.explode(F.sequence(F.lit(0), F.lit(63))).alias("r"))
    rows = rows.groupBy("r").agg(F.count("*").alias("n"))  # before the expansion
    rows = rows.select("n", F.posexplode(vectors.cyclic(F.lit(64), F.col("r"))).alias("semantic", "visible"))
    return rows.groupBy("visible", "semantic").agg(F.sum("n").alias("n"))
