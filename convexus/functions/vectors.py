"""Probability vectors as array columns."""

from __future__ import annotations

from pyspark.sql import functions as F


def total(values, f=lambda x: x):
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + f(x))


def let(value, f):
    """``f`` of a value that is computed once, however often ``f`` uses it: lambdas evaluate what they close over for every element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def normalized(values):
    return let(values, lambda v: let(total(v), lambda s: F.transform(v, lambda x: x / s)))


def softmax(logits, temperature: float = 1.0):
    return normalized(let(F.array_max(logits), lambda top: F.transform(logits, lambda x: F.exp((x - top) / temperature))))


def scatter(values, mapping):
    """out[mapping[i]] = values[i] (mapping a permutation of 0..n-1)."""
    return F.transform(F.sequence(F.lit(0), F.size(values) - 1), lambda i: F.get(values, (F.array_position(mapping, i) - 1).cast("int")))


def gather(values, mapping):
    return F.transform(mapping, lambda i: F.get(values, i))


def cyclic(n, shift):
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: (i + shift) % n)


def argmax(values):
    """Place of the first maximum, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def total_variation(p, q):
    return 0.5 * total(F.zip_with(p, q, lambda a, b: F.abs(a - b)))


def jensen_shannon(p, q):
    """Natural logarithms; 0 log 0 is 0."""
    side = lambda x, y: total(F.zip_with(x, y, lambda a, b: F.when(a > 0, a * F.log(2 * a / (a + b))).otherwise(0.0)))
    return 0.5 * side(p, q) + 0.5 * side(q, p)


def entropy(p):
    return -total(p, lambda x: F.when(x > 0, x * F.log(x)).otherwise(0.0))


def clip_renormalize(p, least: float = 1e-15):
    return normalized(F.transform(p, lambda x: F.greatest(F.least(x, F.lit(1.0)), F.lit(least))))


def dot(a, b):
    return total(F.zip_with(a, b, lambda x, y: x * y))


def margin(logits, gold):
    """The gold value over the best other one."""
    return F.get(logits, gold) - F.array_max(F.filter(logits, lambda x, i: i != gold))


def top_mass(weights, k: int):
    return total(F.slice(F.sort_array(weights, asc=False), 1, k))


def support(weights, least: float):
    return F.size(F.filter(weights, lambda x: x > least))


def l1(a, b):
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def l2(a, b):
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def is_probability(p, size, tolerance: float = 1e-9):
    fine = F.forall(p, lambda x: x.isNotNull() & ~F.isnan(x) & (x >= -tolerance) & (x <= 1 + tolerance))
    return F.coalesce((F.size(p) == size) & fine & (F.abs(total(p) - 1) <= tolerance), F.lit(False))


def simplex_projection(values):
    """Euclidean projection onto the probability simplex, by sorted cumulative sums."""
    def threshold(ordered):
        sums = F.transform(F.sequence(F.lit(1), F.size(ordered)), lambda k: total(F.slice(ordered, F.lit(1), k)))
        return F.array_max(F.zip_with(sums, F.sequence(F.lit(1), F.size(ordered)), lambda s, k: (s - 1) / k))

    theta = let(F.sort_array(values, asc=False), threshold)
    return let(theta, lambda t: F.transform(values, lambda x: F.greatest(x - t, F.lit(0.0))))
