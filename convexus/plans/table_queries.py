"""Queries over sets, contracts, inventories, windows and streams."""

from __future__ import annotations

import itertools

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.hashing import stable_key
from ..registry import query
from ..sources import tables
from ..sources.tables import table
from ..streaming import windows


@query("inventory_diff", """WITH b AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 5 <> 0), a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 7 <> 0)
SELECT coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'added' WHEN a.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS status FROM b FULL JOIN a ON a.o_orderkey = b.o_orderkey WHERE b.o_totalprice IS DISTINCT FROM a.o_totalprice""")  # fmt: skip
def inventory_diff(spark, sf_dir):
    """Before and after of a made-up change: what was added, removed and changed."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    after = o.where("o_orderkey % 7 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 11 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return tables.inventory_diff(o.where("o_orderkey % 5 <> 0"), after, "o_orderkey", "o_totalprice")


@query("contract_checks", """SELECT 'orders.o_orderkey' AS contract, count(*) AS n_rows, (count(*) - count(DISTINCT o_orderkey))::BIGINT AS n_repeated, count(*) FILTER (o_totalprice IS NULL OR o_totalprice < 0) AS n_invalid FROM orders
UNION ALL SELECT 'customer.c_custkey', count(*), (count(*) - count(DISTINCT c_custkey))::BIGINT, count(*) FILTER (c_acctbal IS NULL OR c_acctbal < 0) FROM customer
UNION ALL SELECT 'part.p_partkey', count(*), (count(*) - count(DISTINCT p_partkey))::BIGINT, count(*) FILTER (p_retailprice IS NULL OR p_retailprice < 0) FROM part""")  # fmt: skip
def contract_checks(spark, sf_dir):
    """Rows, repeated keys and invalid values of three tables."""

    def contract(name: str, key: str, value: str):
        bad = F.col(value).isNull() | (F.col(value) < 0)
        return table(spark, sf_dir, name).agg(F.lit(f"{name}.{key}").alias("contract"), F.count("*").alias("n_rows"), (F.count("*") - F.countDistinct(key)).alias("n_repeated"), F.sum(bad.cast("long")).alias("n_invalid"))

    return contract("orders", "o_orderkey", "o_totalprice").unionByName(contract("customer", "c_custkey", "c_acctbal")).unionByName(contract("part", "p_partkey", "p_retailprice"))


@query("repeated_keys", """SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def repeated_keys(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query("suffix_repeated_ids", """WITH k AS (SELECT l_orderkey || '-' || l_linenumber AS id, l_partkey, l_suppkey, l_shipdate, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS i FROM lineitem)
SELECT CASE WHEN i = 0 THEN id ELSE id || '--' || i END AS id, l_partkey FROM k""")  # fmt: skip
def suffix_repeated_ids(spark, sf_dir):
    """Unique ids: repeats get their number as a suffix."""
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    k = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), "l_partkey", (F.row_number().over(w) - 1).alias("i"))
    return k.select(F.when(F.col("i") == 0, F.col("id")).otherwise(F.concat_ws("--", "id", "i")).alias("id"), "l_partkey")


@query("set_gates", """SELECT 'both' AS part, count(*) AS n FROM (SELECT DISTINCT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer)
UNION ALL SELECT 'orders_only', count(*) FROM (SELECT DISTINCT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer)
UNION ALL SELECT 'customer_only', count(*) FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders)
UNION ALL SELECT 'union', count(*) FROM (SELECT c_custkey AS k FROM customer UNION SELECT o_custkey FROM orders)""")  # fmt: skip
def set_gates(spark, sf_dir):
    """Intersection, differences and union of two key sets, by one full join."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).distinct().withColumn("o", F.lit(1))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).distinct().withColumn("c", F.lit(1))
    n = o.join(c, "k", "full_outer").agg(*[F.sum(x.cast("long")).alias(a) for a, x in (("both", F.col("o").isNotNull() & F.col("c").isNotNull()), ("orders_only", F.col("c").isNull()), ("customer_only", F.col("o").isNull()))], F.count("*").alias("union"))
    return n.select(F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.coalesce(F.col(p), F.lit(0)).cast("long").alias("n")) for p in ("both", "orders_only", "customer_only", "union")])).alias("s")).select("s.part", "s.n")


@query("pending_jobs", """SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')""")
def pending_jobs(spark, sf_dir):
    """Jobs without a finished part: an anti-join."""
    jobs = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey")
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return jobs.join(done, "o_orderkey", "left_anti")


@query("canonical_json_digest", """SELECT n_nationkey, sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}') AS digest FROM nation""")
def canonical_json_digest(spark, sf_dir):
    """SHA-256 of each row's canonical JSON."""
    return table(spark, sf_dir, "nation").select("n_nationkey", F.sha2(tables.canonical_json("n_nationkey", "n_name", "n_regionkey"), 256).alias("digest"))


PARTS = ", ".join(f"sum(('0x' || h[{1 + 8 * k}:{8 + 8 * k}])::BIGINT)::VARCHAR" for k in range(8))


@query("table_digest", """WITH l AS (SELECT sha256('{"o_custkey":' || o_custkey || ',"o_orderdate":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%g') || '","o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '","o_totalprice":' || o_totalprice || '}') AS h FROM orders)
SELECT count(*) AS n_rows, sha256(concat_ws(':', """ + PARTS + ")) AS digest FROM l")  # fmt: skip
def table_digest(spark, sf_dir):
    """One digest of a table, whatever the order of its rows."""
    return tables.table_digest(table(spark, sf_dir, "orders"))


@query("peer_subsets", """SELECT a::INTEGER AS a, b::INTEGER AS b, c::INTEGER AS c FROM range(8) q(a), range(8) r(b), range(8) s(c) WHERE a < b AND b < c""")
def peer_subsets(spark, sf_dir):
    """All sets of three of eight peers: made on the driver, since a roster is small."""
    return spark.createDataFrame(list(itertools.combinations(range(8), 3)), "a int, b int, c int")


@query("random_removal_null", """WITH g AS (SELECT r.draw, p_brand, row_number() OVER (PARTITION BY r.draw ORDER BY sha256(concat_ws(chr(31), '13', r.draw::VARCHAR, p_brand))[1:16], p_brand) AS place FROM (SELECT DISTINCT p_brand FROM part), range(100) r(draw))
SELECT draw::INTEGER AS draw, p_brand FROM g WHERE place <= 3""")  # fmt: skip
def random_removal_null(spark, sf_dir):
    """A hundred hash-ordered removals of three brands."""
    g = table(spark, sf_dir, "part").select("p_brand").distinct().withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(99))))
    w = Window.partitionBy("draw").orderBy(stable_key("13", F.col("draw").cast("string"), F.col("p_brand")), "p_brand")
    return g.withColumn("place", F.row_number().over(w)).where("place <= 3").select("draw", "p_brand")


@query("nearest_within_tolerance", """WITH p AS (SELECT p_brand, p_partkey, p_retailprice, min(p_retailprice) OVER (PARTITION BY p_brand) AS best FROM part) SELECT p_brand, min(p_partkey) AS p_partkey, count(*) AS n_tied FROM p WHERE p_retailprice <= best + 1.0 GROUP BY p_brand""")
def nearest_within_tolerance(spark, sf_dir):
    """The least value's rows within a tolerance, and of these the first."""
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice")
    best = p.groupBy("p_brand").agg(F.min("p_retailprice").alias("best"))
    return p.join(best, "p_brand").where("p_retailprice <= best + 1.0").groupBy("p_brand").agg(F.min("p_partkey").alias("p_partkey"), F.count("*").alias("n_tied"))


@query("lowest_and_highest", """(SELECT 'low' AS side, o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 6) UNION ALL (SELECT 'high', o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 3)""")
def lowest_and_highest(spark, sf_dir):
    """A top-k report: the six lowest and three highest."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return o.orderBy("o_totalprice", "o_orderkey").limit(6).select(F.lit("low").alias("side"), "*").unionByName(o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(3).select(F.lit("high").alias("side"), "*"))


@query("last_per_group", """SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice, count(*) AS n FROM orders GROUP BY o_custkey""")
def last_per_group(spark, sf_dir):
    """Each customer's last order, by date and key: one aggregation, no window."""
    last = F.max(F.struct("o_orderdate", "o_orderkey", "o_totalprice")).alias("last")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(last, F.count("*").alias("n")).select("o_custkey", "last.o_orderkey", "last.o_totalprice", "n")


@query("dose_grouping_sets", """SELECT CASE WHEN grouping(l_returnflag) = 1 THEN 'overall' WHEN grouping(l_linestatus) = 1 THEN 'flag' ELSE 'cell' END AS scope, l_returnflag, l_linestatus, count(*) AS n, round(avg(l_discount), 9) AS mean FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def dose_grouping_sets(spark, sf_dir):
    """Cells, subtotals and the pooled total in one pass, told apart by a scope column and not by nulls."""
    scope = F.when(F.grouping("l_returnflag") == 1, "overall").when(F.grouping("l_linestatus") == 1, "flag").otherwise("cell")
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(scope.alias("scope"), F.count("*").alias("n"), F.round(F.avg("l_discount"), 9).alias("mean"))


@query("pricing_summary", """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 9) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY ALL""")
def pricing_summary(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("2000-09-02").cast("timestamp"))
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 9).alias("avg_disc"), F.count("*").alias("n"))


@query("value_counts_json", """WITH c AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) SELECT o_orderpriority, '{' || string_agg('"' || o_orderstatus || '":' || n, ',' ORDER BY o_orderstatus) || '}' AS counts, arg_min(o_orderstatus, (-n, o_orderstatus)) AS mode FROM c GROUP BY o_orderpriority""")
def value_counts_json(spark, sf_dir):
    """Value counts as JSON in order of value, and the mode with ties to the first value."""
    c = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    return c.groupBy("o_orderpriority").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("o_orderstatus", "n"))))).alias("counts"), F.min_by("o_orderstatus", F.struct(-F.col("n"), "o_orderstatus")).alias("mode"))  # three statuses


@query("interval_json", """SELECT o_orderkey, round(o_totalprice * 0.9, 4) AS low, round(o_totalprice * 1.1, 4) AS high FROM orders""")
def interval_json(spark, sf_dir):
    """Intervals written as JSON text and parsed back."""
    text = F.to_json(F.array(F.round(F.col("o_totalprice") * 0.9, 4), F.round(F.col("o_totalprice") * 1.1, 4)))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.from_json(text, "array<double>").alias("i"))
    return o.select("o_orderkey", F.get("i", F.lit(0)).alias("low"), F.get("i", F.lit(1)).alias("high"))


MOMENTS = """SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS window_start, count(*) AS n, round(sum(value), 6) AS s1, round(sum(value * value), 3) AS s2 FROM events WHERE ts IS NOT NULL GROUP BY ALL"""


def _rounded(df):
    return df.select("event_type", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n", F.round("s1", 6).alias("s1"), F.round("s2", 3).alias("s2"))


@query("window_moments", MOMENTS)
def window_moments(spark, sf_dir):
    return _rounded(windows.window_moments(table(spark, sf_dir, "events"), ["event_type"], "ts", "value"))


@query("stream_window_moments", MOMENTS)
def stream_window_moments(spark, sf_dir):
    """The same by Structured Streaming over the events file, run to its end."""
    schema = table(spark, sf_dir, "events").schema
    stream = windows.stream_parquet(spark, sf_dir, "events.parquet", schema)
    out = windows.run_to_end(windows.window_moments(stream, ["event_type"], "ts", "value"), ["event_type", "window_start"], windows.shared_folder(spark))
    return _rounded(out)
