"""Stable keys and seeds."""

from __future__ import annotations

from pyspark.sql import functions as F

SEPARATOR = "\x1f"


def stable_key(*parts):
    """The first 16 hex digits of the SHA-256 of parts joined by the unit separator; as text it orders as the number does."""
    return F.substring(F.sha2(F.concat_ws(SEPARATOR, *[p if hasattr(p, "cast") else F.lit(p) for p in parts]), 256), 1, 16)


def stable_u64(*parts):
    return F.conv(stable_key(*parts), 16, 10).cast("decimal(20,0)")


def stable_seed(*parts):
    """The number modulo 2^32: its last eight hex digits."""
    return F.conv(F.substring(stable_key(*parts), 9, 8), 16, 10).cast("long")


def dose_seed(base: int, context, dose, text):
    """A 32-bit seed of (base, context, dose with six decimals, text) by MD5."""
    line = F.concat_ws("|", F.lit(str(base)), context, F.format_string("%.6f", dose), text)
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def config_hash(json):
    return F.substring(F.sha1(json), 1, 12)


def slug(text):
    return F.replace(F.replace(text, F.lit("/"), F.lit("__")), F.lit(" "), F.lit("_"))


def draw(n, *parts):
    """A hash-indexed draw of 0..n-1: 31 bits of the key modulo n."""
    return (F.conv(F.substring(stable_key(*parts), 1, 7), 16, 10).cast("long") % n).cast("int")
