"""Numeric functions that Spark lacks, as column expressions (whole-stage codegen) with their SQL twins."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hart's rational approximation of the normal integral, as published by West (2005).
_P = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_Q = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
_SPLIT, _ROOT = 7.07106781186547, 2.506628274631
EPS = 1e-6


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def _horner(cs: Sequence[float], x: Column) -> Column:
    out = F.lit(cs[0])
    for c in cs[1:]:
        out = out * x + F.lit(c)
    return out


def ndtr(x: Column) -> Column:
    """Normal distribution function; absolute error about 1e-15, null for null."""
    a = F.abs(x)
    e = F.exp(-a * a / 2)
    tail = a + 0.65
    for k in (4, 3, 2, 1):
        tail = a + F.lit(float(k)) / tail
    c = F.when(a > 37, F.lit(0.0)).when(a < _SPLIT, e * _horner(_P, a) / _horner(_Q, a)).otherwise(e / tail / _ROOT)
    return F.when(x > 0, 1 - c).otherwise(c)


def ndtr_sql(x: str) -> str:
    """The same in SQL."""
    a = f"abs({x})"

    def horner(cs: Sequence[float]) -> str:
        out = repr(cs[0])
        for c in cs[1:]:
            out = f"({out} * {a} + {c!r})"
        return out

    tail = f"({a} + 0.65)"
    for k in (4, 3, 2, 1):
        tail = f"({a} + {k}.0 / {tail})"
    c = f"(case when {a} > 37 then 0.0 when {a} < {_SPLIT} then exp(-{a} * {a} / 2) * {horner(_P)} / {horner(_Q)} else exp(-{a} * {a} / 2) / {tail} / {_ROOT} end)"
    return f"(case when {x} > 0 then 1 - {c} else {c} end)"


def log_ndtr(x: Column) -> Column:
    """Log of ndtr; below -30 by the asymptotic series, where ndtr itself underflows."""
    series = -x * x / 2 - F.log(-x) - 0.9189385332046727 + F.log1p(-1 / (x * x) + 3 / F.pow(x, 4))
    return F.when(x > -30, F.log(F.greatest(ndtr(x), F.lit(1e-300)))).otherwise(series)


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi))))


def logit(p: Column, eps: float = EPS) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.log(q / (1 - q))


def expit(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def log_loss(p: Column, y: Column, eps: float = EPS) -> Column:
    q = clip(p, eps, 1 - eps)
    return -(y * F.log(q) + (1 - y) * F.log(1 - q))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of equal length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def interpolate(x: Column, xs: Sequence[float], ys: Sequence[Column | float]) -> Column:
    """Piecewise linear through the nodes, flat beyond them."""
    xs, ys = list(xs), [lit(y) for y in ys]
    out = F.when(x <= xs[0], ys[0])
    for (x0, y0), (x1, y1) in zip(zip(xs, ys), zip(xs[1:], ys[1:])):
        out = out.when(x <= x1, y0 + (y1 - y0) * (x - x0) / (x1 - x0))
    return out.when(x.isNotNull(), ys[-1])


def order_key(micros: Column, tie: Column) -> Column:
    """One decimal that orders by microseconds, then by a whole number: what min_by and max_by compare in a hash aggregate,
    where a struct would make Spark sort all rows first. Null where the tie is; null microseconds come first."""
    us = F.coalesce(micros, F.lit(-(10**16))).cast("decimal(17,0)")
    return (us * F.lit(Decimal(2 * 10**19)).cast("decimal(20,0)") + (tie.cast("decimal(20,0)") + F.lit(Decimal(2**63)).cast("decimal(20,0)")).cast("decimal(20,0)")).cast("decimal(38,0)")
