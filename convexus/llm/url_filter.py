"""URL rule lists by hashed host-suffix and path-prefix expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, free_name

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rule tables up to this many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_RULES = 100_000
#: So many shapes of rules are joined one by one at most.
SHAPES = 16

#: The production rules (host, path, action).
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def split_url(url):
    """(host, path) of a URL column. Null and what has no ``://`` give two empty strings."""
    part = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "rule_host string, rule_path string, action string")


def _compiled(rules: DataFrame) -> DataFrame:
    """(rule, digest, labels, n_path, action): each rule once, its host in lower case; of equal rules, block."""
    rules = rules.where(F.col("rule_host").isNotNull() & F.col("rule_path").isNotNull() & F.col("action").isNotNull())
    host = F.translate("rule_host", UPPER, LOWER)
    rule = F.concat(host, F.col("rule_path"))
    rules = rules.select(rule.alias("rule"), F.sha2(rule, 256).alias("digest"), F.size(F.split(host, r"\.")).alias("labels"), F.length("rule_path").alias("n_path"), "action")
    return rules.groupBy("rule", "digest", "labels", "n_path").agg(F.max("action").alias("action"))


def _expression(host: str, path: str, labels: int, n_path: int):
    """The host's last labels and the path's first characters; null where it has not so many."""
    suffix = F.when(F.size(F.split(host, r"\.")) >= labels, F.substring_index(host, ".", -labels))
    return F.concat(suffix, F.when(F.length(path) >= n_path, F.substring(path, 1, n_path)))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", prefix_hex: int = 8) -> DataFrame:
    """``pages`` with host, path, rule and verdict; a rule fits its host and all subdomains where the path starts with the rule's.

    A URL is expanded into its host suffixes and path prefixes, of the shapes (labels of the host, length of the path) that
    rules have; others can't match. Expressions meet the rules by an equi-join on a short prefix of their SHA-256;
    the full digest confirms. The longest rule wins; of two equal rules, block. Up to SHAPES shapes, the rules of
    each shape are broadcast to the pages, which are not shuffled; beyond, the distinct (host, path head) are expanded
    and joined, and the best rule of each comes back. Pages that no rule fits get ``default`` and a null rule. Null, empty,
    very long and repeated URLs are judged like any other; page columns named like the results are replaced, others stay.
    """
    rules = Scratch(pages.sparkSession, "url-rules").save(_compiled(rules), "rules")
    shapes = sorted((r["labels"], r["n_path"]) for r in rules.select("labels", "n_path").distinct().limit(SHAPES + 1).collect())
    host, path = split_url(F.col(url))
    pages = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    if len(shapes) <= SHAPES and rules.count() <= BROADCAST_RULES:
        return _by_shape(pages, rules, shapes, default, prefix_hex)
    return _by_key(pages, rules, default, prefix_hex)


def _by_shape(pages: DataFrame, rules: DataFrame, shapes: list[tuple[int, int]], default: str, prefix_hex: int) -> DataFrame:
    names = {n: free_name(pages.columns, n) for n in ("_best", "_short", "_full", "_rules")}
    best = F.lit(None).cast("struct<n:int,action:string,rule:string>")
    columns = pages.columns
    pages = pages.withColumn(names["_best"], best)
    for labels, n_path in shapes:
        own = rules.where((F.col("labels") == labels) & (F.col("n_path") == n_path))
        # Rules whose short prefixes collide share a row, so a page stays one row.
        own = own.groupBy(F.substring("digest", 1, prefix_hex).alias(names["_short"])).agg(F.collect_list(F.struct("digest", "action", "rule")).alias(names["_rules"]))
        pages = pages.withColumn(names["_full"], F.sha2(_expression("host", "path", labels, n_path), 256)).withColumn(names["_short"], F.substring(names["_full"], 1, prefix_hex))
        sure = F.get(F.filter(names["_rules"], lambda r: r["digest"] == F.col(names["_full"])), F.lit(0))
        found = F.when(sure.isNotNull(), F.struct(F.length(sure["rule"]).alias("n"), sure["action"].alias("action"), sure["rule"].alias("rule")))
        pages = pages.join(F.broadcast(own), names["_short"], "left")  # at most BROADCAST_RULES rules
        pages = pages.withColumn(names["_best"], F.greatest(names["_best"], found)).select(*columns, names["_best"])
    best = F.col(names["_best"])
    return pages.select(*columns, best["rule"].alias("rule"), F.coalesce(best["action"], F.lit(default)).alias("verdict"))


def _by_key(pages: DataFrame, rules: DataFrame, default: str, prefix_hex: int) -> DataFrame:
    head = free_name(pages.columns, "_head")
    # Lengths are bounded by what a host and a path may be, however many rules there are.
    sizes = rules.agg(F.collect_set("labels").alias("labels"), F.collect_set("n_path").alias("paths")).first()
    pages = pages.withColumn(head, F.substring("path", 1, max(sizes["paths"], default=0)))
    made = F.array(*[_expression("host", "head", n, k) for n in sorted(sizes["labels"]) for k in sorted(sizes["paths"])])
    seen = pages.select("host", F.col(head).alias("head")).distinct().select("host", "head", F.explode(F.filter(made, lambda x: x.isNotNull())).alias("expression"))
    seen = seen.withColumn("full", F.sha2("expression", 256)).withColumn("short", F.substring("full", 1, prefix_hex))
    rules = rules.withColumn("short", F.substring("digest", 1, prefix_hex)).drop("labels", "n_path")
    best = seen.join(rules, "short").where("full = digest").groupBy("host", "head").agg(F.max(F.struct(F.length("rule").alias("n"), "action", "rule")).alias("best"))
    best = best.select("host", F.col("head").alias(head), F.col("best.rule").alias("rule"), F.col("best.action").alias("verdict"))
    return pages.join(best, ["host", head], "left").drop(head).withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


OP9_SQL = r"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(rule_host, rule_path, action) AS (VALUES
  ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (
  SELECT page_id, host, path, rule_host || rule_path AS rule, action,
         row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rule_host || rule_path) DESC NULLS LAST) AS k
  FROM u LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM m WHERE k = 1
"""
