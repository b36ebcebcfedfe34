"""Vector arithmetic as column expressions, summed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(as_double(a), lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y))))


def l1(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(as_double(a), as_double(b), lambda x, y: F.abs(x - y)))


def distance(metric: str, a: Column, b: Column) -> Column:
    """``cosine``, ``l2``, ``l1`` or ``dot`` (negated, so that less is nearer)."""
    if metric == "cosine":
        return 1 - cosine(a, b)
    if metric == "dot":
        return -dot(a, b)
    return {"l2": l2, "l1": l1}[metric](a, b)


def normalise(a: Column) -> Column:
    """Length 1; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(as_double(a), lambda x: x / n)).otherwise(as_double(a))


def mean_pool(tokens: Column, mask: Column) -> Column:
    """Mean of the token vectors whose mask is 1; the count has a floor of 1e-9."""
    kept = F.filter(F.arrays_zip(tokens.alias("t"), mask.alias("m")), lambda z: z["m"] == 1)
    total = F.aggregate(F.transform(kept, lambda z: z["t"].cast("array<double>")), F.transform(F.get(tokens, 0), lambda _: F.lit(0.0)), lambda a, t: F.zip_with(a, t, lambda x, y: x + y))
    return F.transform(total, lambda x: x / F.greatest(F.size(kept).cast("double"), F.lit(1e-9)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def similarity(d: Column, strict: bool = True) -> Column:
    """1 - distance; without ``strict``, null is 0, 1 and beyond is 1, and below 0 is 1 - |distance|."""
    if strict:
        return 1 - d
    return F.when(d.isNull(), 0.0).when(d >= 1, 1.0).when(d < 0, 1 - F.abs(d)).otherwise(1 - d)


def rerank_width(n: Column | int, least: int = 10, most: int = 50, share: float = 0.1) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.greatest(F.lit(least), F.least(F.lit(most), F.ceil(n * share))).cast("int")
