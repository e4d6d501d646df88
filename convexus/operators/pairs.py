"""Coverage of a target by mixtures of two peers, in closed form from one Gram matrix."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged
from . import ecosystem, gram, medians, splits

SEEDS = [20260828, 20260829, 20260830]
N_FITS = 30 * len(SEEDS)
TRIPLES = [(t, a, b) for t in range(5) for a in range(5) for b in range(a + 1, 5) if t not in (a, b)]


def place(i: int, j: int, n: int) -> int:
    """Place of (i, j) in the row-major upper triangle."""
    i, j = min(i, j), max(i, j)
    return i * n - i * (i - 1) // 2 + j - i


def pair_fits(aligned: DataFrame, keys: list[str], n: int = 5, weight: str | None = None) -> DataFrame:
    """keys, t, a, b, wa: the weight of peer a (b has the rest) that fits target t best in squares; one aggregation for all."""
    g = gram.gram(aligned, keys, n, weight=weight)
    at = lambda i, j: F.get("g", F.lit(place(i, j, n)))

    def weight(t: int, a: int, b: int):
        up = at(t, a) - at(t, b) - at(a, b) + at(b, b)
        down = at(a, a) - 2 * at(a, b) + at(b, b)
        return F.when(down > 1e-18, F.least(F.greatest(up / down, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)

    cells = [F.struct(F.lit(t).alias("t"), F.lit(a).alias("a"), F.lit(b).alias("b"), weight(t, a, b).alias("wa")) for t, a, b in TRIPLES]
    return g.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, "c.t", "c.a", "c.b", "c.wa")


def triple_fits(aligned: DataFrame, keys: list[str], n: int = 5, weight: str | None = None) -> DataFrame:
    """keys, t, a, b, c, wa, wb: the weights of three peers (c has the rest) that fit target t best in squares.

    With c as origin the loss is a quadratic in two weights: the optimum is inside, if that is a mixture, else on one of
    three edges. Losses are compared to twelve decimals, ties to the inside and the earlier edge."""
    g = gram.gram(aligned, keys, n, weight=weight)
    at = lambda i, j: F.get("g", F.lit(place(i, j, n)))
    clip = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    zero = F.lit(0.0)

    def cell(t: int, a: int, b: int, c: int):
        diff = lambda i, j: at(i, j) - at(i, c) - at(j, c) + at(c, c)
        uu, vv, uv, uy, vy = diff(a, a), diff(b, b), diff(a, b), diff(a, t), diff(b, t)
        det, edge = uu * vv - uv * uv, F.try_divide(uy - vy - uv + vv, uu - 2 * uv + vv)
        found = [(F.try_divide(uy * vv - vy * uv, det), F.try_divide(vy * uu - uy * uv, det)), (clip(F.try_divide(uy, uu)), zero), (zero, clip(F.try_divide(vy, vv))), (clip(edge), 1 - clip(edge))]
        loss = lambda p, q: F.round(p * p * uu + q * q * vv + 2 * p * q * uv - 2 * p * uy - 2 * q * vy, 12)
        made = F.array(*[F.struct(loss(p, q).alias("loss"), F.lit(k).alias("k"), p.alias("wa"), q.alias("wb")) for k, (p, q) in enumerate(found)])
        best = F.array_min(F.filter(made, lambda s: (s["wa"] >= 0) & (s["wb"] >= 0) & (s["wa"] + s["wb"] <= 1)))
        return F.struct(F.lit(t).alias("t"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c"), best.alias("s"))

    chosen = [(t, *p) for t in range(n) for p in itertools.combinations([i for i in range(n) if i != t], 3)]
    rows = g.select(*keys, F.explode(F.array(*[cell(*x) for x in chosen])).alias("f"))
    return rows.select(*keys, "f.t", "f.a", "f.b", "f.c", "f.s.wa", "f.s.wb")


def aligned_splits(spark, sf_dir: str, *extra: str) -> DataFrame:
    """Aligned responses (x in the roster's order) with each split's side; staged, as fits and evaluations both read them."""

    def make() -> DataFrame:
        frame = ecosystem.responses(spark, sf_dir, *extra)
        wide = ecosystem.align(frame, ecosystem.MODELS, ["question", "category", "dose", *extra])
        return wide.join(splits.half_split(frame.select("category", "question"), SEEDS), ["category", "question"])

    return staged(spark, ("aligned", sf_dir, *extra), make)


def pair_residuals(spark, sf_dir: str, *extra: str, fit_when=None) -> DataFrame:
    """All rows of both sides with every pair's weight and residual; fits see only the fitting side (and ``fit_when``)."""
    rows = aligned_splits(spark, sf_dir, *extra)
    fits = pair_fits(rows.where(F.col("side") == "fit").where(fit_when if fit_when is not None else F.lit(True)), ["split_seed"])
    joined = rows.join(medians.small(fits, N_FITS), "split_seed")
    guess = F.col("wa") * F.get("x", F.col("a")) + (1 - F.col("wa")) * F.get("x", F.col("b"))
    return joined.withColumn("res", F.get("x", F.col("t")) - guess)
