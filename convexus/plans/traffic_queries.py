"""Queries over event series: the event type is the city, the user the detector."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import splits
from ..registry import query
from ..sources.tables import table


def series(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type IS NOT NULL AND user_id IS NOT NULL AND ts IS NOT NULL")
    return e.select(F.col("event_type").alias("city"), F.col("user_id").alias("detid"), "ts", "event_id", F.when(~F.isnan("value"), F.col("value")).alias("flow"))


ORDER = ["ts", "event_id"]
S = "s AS (SELECT event_type AS city, user_id AS detid, ts, event_id, value AS flow FROM events WHERE event_type IS NOT NULL AND user_id IS NOT NULL AND ts IS NOT NULL)"


@query("lag_lead_features", "WITH " + S + """
SELECT city, event_id, lag(flow, 1) OVER w AS lag1, lag(flow, 2) OVER w AS lag2, lead(flow, 3) OVER w AS target, round(flow - lag(flow, 1) OVER w, 9) AS difference, (row_number() OVER w - 1)::INTEGER AS position, count(*) OVER (PARTITION BY city, detid) AS n_rows
FROM s WINDOW w AS (PARTITION BY city, detid ORDER BY ts, event_id)""")  # fmt: skip
def lag_lead_features(spark, sf_dir):
    """Lags, the target three steps ahead, the first difference and the place in each detector's series; one shuffle for all."""
    p = Window.partitionBy("city", "detid")
    w = p.orderBy(*ORDER)
    lag1 = F.lag("flow", 1).over(w)
    return series(spark, sf_dir).select("city", "event_id", lag1.alias("lag1"), F.lag("flow", 2).over(w).alias("lag2"), F.lead("flow", 3).over(w).alias("target"), F.round(F.col("flow") - lag1, 9).alias("difference"), (F.row_number().over(w) - 1).alias("position"), F.count("*").over(p).alias("n_rows"))


@query("horizon_split", "WITH " + S + """, k AS (SELECT city, detid, event_id, row_number() OVER (PARTITION BY city, detid ORDER BY ts, event_id) - 1 AS p, count(*) OVER (PARTITION BY city, detid) AS n FROM s)
SELECT event_id, city, CASE WHEN p < floor(0.6::DOUBLE * n) - 1 THEN 'train' WHEN p >= floor(0.6::DOUBLE * n) AND p < floor(0.8::DOUBLE * n) - 1 THEN 'validation' WHEN p >= floor(0.8::DOUBLE * n) THEN 'test' END AS split FROM k""")  # fmt: skip
def horizon_split(spark, sf_dir):
    """Time-ordered 60/20/20 with a row's horizon dropped before each cut."""
    return splits.horizon_split(series(spark, sf_dir), ["city", "detid"], ORDER, 1).select("event_id", "city", "split")


@query("recent_days", "WITH " + S + " SELECT event_id, city FROM (SELECT *, max(ts::DATE) OVER (PARTITION BY city) AS last FROM s) WHERE ts::DATE >= last - 6")
def recent_days(spark, sf_dir):
    """Rows of each city's last seven days; the last day is aggregated first and joined back, so a large city isn't one window."""
    s = series(spark, sf_dir)
    last = s.groupBy("city").agg(F.max(F.to_date("ts")).alias("last"))
    return s.join(last, "city").where(F.to_date("ts") >= F.date_sub("last", 6)).select("event_id", "city")


@query("top_detectors", "WITH " + S + """, c AS (SELECT city, detid, count(*) AS n FROM s GROUP BY ALL HAVING count(*) >= 2), k AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY n DESC, detid) AS place FROM c)
SELECT s.event_id, s.city, s.detid FROM s JOIN k USING (city, detid) WHERE place <= 20""")  # fmt: skip
def top_detectors(spark, sf_dir):
    """Rows of each city's 20 busiest detectors of at least two points."""
    s = series(spark, sf_dir)
    c = s.groupBy("city", "detid").agg(F.count("*").alias("n")).where("n >= 2")
    top = c.withColumn("place", F.row_number().over(Window.partitionBy("city").orderBy(F.desc("n"), "detid"))).where("place <= 20")
    return s.join(top.select("city", "detid"), ["city", "detid"]).select("event_id", "city", "detid")


@query("calendar_features", "WITH " + S + """
SELECT event_id, (isodow(ts) - 1)::INTEGER AS dow, round(sin(2 * pi() * (isodow(ts) - 1) / 7), 9) + 0.0 AS dow_sin, round(cos(2 * pi() * (isodow(ts) - 1) / 7), 9) + 0.0 AS dow_cos, (isodow(ts) >= 6)::INTEGER AS weekend,
  round(sin(2 * pi() * (hour(ts) * 60 + minute(ts)) / 1440), 9) + 0.0 AS tod_sin, round(cos(2 * pi() * (hour(ts) * 60 + minute(ts)) / 1440), 9) + 0.0 AS tod_cos FROM s""")  # fmt: skip
def calendar_features(spark, sf_dir):
    dow, minutes, turn = F.weekday("ts"), F.hour("ts") * 60 + F.minute("ts"), lambda x, n: 2 * F.pi() * x / n
    r = lambda c: F.round(c, 9) + 0.0
    return series(spark, sf_dir).select("event_id", dow.alias("dow"), r(F.sin(turn(dow, 7))).alias("dow_sin"), r(F.cos(turn(dow, 7))).alias("dow_cos"), (dow >= 5).cast("int").alias("weekend"), r(F.sin(turn(minutes, 1440))).alias("tod_sin"), r(F.cos(turn(minutes, 1440))).alias("tod_cos"))


@query("persistence_baseline", "WITH " + S + """, l AS (SELECT city, flow, lag(flow, 1) OVER (PARTITION BY city, detid ORDER BY ts, event_id) AS p, avg(flow) OVER (PARTITION BY city, detid) AS m FROM s)
SELECT city, count(*) AS n, round(avg(abs(flow - p)), 6) AS persistence_mae, round(avg(abs(flow - m)), 6) AS mean_mae, round(avg(flow), 6) AS mean_flow, round(1 - avg(abs(flow - m)) / nullif(avg(abs(flow - p)), 0), 6) AS skill
FROM l WHERE p IS NOT NULL GROUP BY city""")  # fmt: skip
def persistence_baseline(spark, sf_dir):
    """The last value, and the detector's mean, as forecasts; skill of one over the other."""
    p = Window.partitionBy("city", "detid")
    l = series(spark, sf_dir).select("city", "flow", F.lag("flow", 1).over(p.orderBy(*ORDER)).alias("p"), F.avg("flow").over(p).alias("m")).where("p IS NOT NULL")
    a, b = F.avg(F.abs(F.col("flow") - F.col("p"))), F.avg(F.abs(F.col("flow") - F.col("m")))
    return l.groupBy("city").agg(F.count("*").alias("n"), F.round(a, 6).alias("persistence_mae"), F.round(b, 6).alias("mean_mae"), F.round(F.avg("flow"), 6).alias("mean_flow"), F.round(1 - F.try_divide(b, a), 6).alias("skill"))


@query("event_props", """SELECT event_type, count(*) AS n, count(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER)) AS n_k, sum(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER))::BIGINT AS sum_k FROM events GROUP BY event_type""")
def event_props(spark, sf_dir):
    """A field of the JSON column, read with a declared schema; what doesn't parse is null."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count(k).alias("n_k"), F.sum(k.cast("long")).alias("sum_k"))


@query("finite_rows", """SELECT event_type, count(*) FILTER (value IS NOT NULL AND isfinite(value)) AS n_finite, count(*) FILTER (value IS NULL OR NOT isfinite(value)) AS n_dropped FROM events GROUP BY event_type""")
def finite_rows(spark, sf_dir):
    fine = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(fine.cast("long")).alias("n_finite"), F.sum((~fine).cast("long")).alias("n_dropped"))


@query("hash_row_cap", "WITH " + S + " SELECT event_id FROM s ORDER BY sha256(concat_ws(chr(31), '9', event_id::VARCHAR))[1:16], event_id LIMIT 100")
def hash_row_cap(spark, sf_dir):
    """A seeded sample of 100 rows in hash order (a sampling operator): each task keeps its first 100."""
    from ..functions.hashing import stable_key

    return series(spark, sf_dir).select("event_id").orderBy(stable_key("9", F.col("event_id").cast("string")), "event_id").limit(100)


@query("city_regressor")
def city_regressor(spark, sf_dir):
    """Ridge regression of the value three steps ahead on lags and calendar for each city: Gram sums by city, then one small solve each."""
    import numpy as np
    import pandas as pd

    f = lag_lead_features(spark, sf_dir).join(calendar_features(spark, sf_dir), "event_id").where("lag1 IS NOT NULL AND lag2 IS NOT NULL AND target IS NOT NULL")
    cols = [F.lit(1.0), F.col("lag1"), F.col("lag2"), F.col("dow_sin"), F.col("dow_cos"), F.col("tod_sin"), F.col("tod_cos"), F.col("target")]
    sums = f.groupBy("city").agg(F.array(*[F.sum(a * b) for i, a in enumerate(cols) for b in cols[i:]]).alias("g"), F.count("*").alias("n"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        from .. import operators  # noqa: F401
        from ..operators.solvers import full

        g = full(pdf["g"].iloc[0], 8)
        x, y, n = g[:7, :7], g[:7, 7], pdf["n"].iloc[0]
        penalty = 1e-6 * n * np.eye(7)
        penalty[0, 0] = 0
        w = np.linalg.solve(x + penalty, y)
        return pd.DataFrame({"city": [pdf["city"].iloc[0]], "n": [n], "coefficients": [w.tolist()], "mse": [float((g[7, 7] - 2 * w @ y + w @ x @ w) / n)]})

    return sums.groupBy("city").applyInPandas(solve, "city string, n long, coefficients array<double>, mse double")
