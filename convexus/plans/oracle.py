"""SQL that the coverage queries share."""

from __future__ import annotations

from ..operators.ecosystem import MODELS


def e(extra: str = "") -> str:
    """Responses; ``extra`` may add the track."""
    return f"""e AS (SELECT r_name AS model, p_brand AS question, p_brand[1:7] AS category, (year(l_shipdate) - 1995)::INTEGER AS dose{', (l_linenumber % 3)::INTEGER AS track' if extra else ''},
  avg(l_discount) AS response FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)"""


def wide(extra: str = "") -> str:
    cells = ", ".join(f"max(response) FILTER (model = '{m}')" for m in MODELS)
    return e(extra) + f""", w AS (SELECT question, category, dose{', track' if extra else ''}, [{cells}] AS x FROM e GROUP BY ALL HAVING count(*) = {len(MODELS)})"""


SPLITS = """s(split_seed) AS (VALUES (20260828::BIGINT), (20260829), (20260830)),
sp AS (SELECT split_seed, category, question, CASE WHEN row_number() OVER (PARTITION BY split_seed, category
  ORDER BY sha256(concat_ws(chr(31), split_seed::VARCHAR, category, question))[1:16], question) <= count(*) OVER (PARTITION BY split_seed, category) // 2
  THEN 'fit' ELSE 'eval' END AS side FROM (SELECT DISTINCT category, question FROM e), s)"""


def residuals(extra: str = "", fit_when: str = "true") -> str:
    return wide(extra) + ", " + SPLITS + f""",
tri AS (SELECT t::INTEGER AS t, a::INTEGER AS a, b::INTEGER AS b FROM range(5) q(t), range(5) r(a), range(5) u(b) WHERE a < b AND t <> a AND t <> b),
f AS (SELECT split_seed, t, a, b, least(greatest(sum((x[t + 1] - x[b + 1]) * (x[a + 1] - x[b + 1])) / sum((x[a + 1] - x[b + 1]) ** 2), 0), 1) AS wa
  FROM w JOIN sp USING (category, question), tri WHERE side = 'fit' AND {fit_when} GROUP BY ALL),
r AS (SELECT *, x[t + 1] - wa * x[a + 1] - (1 - wa) * x[b + 1] AS res FROM w JOIN sp USING (category, question) JOIN f USING (split_seed))"""  # fmt: skip
