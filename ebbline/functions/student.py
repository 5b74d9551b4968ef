"""Two-sided p-values of Student's t as native column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The continued fraction of the incomplete beta function settles to some 14 digits within this
# many steps for every number of degrees of freedom, on the side of its switching point used here.
_STEPS = 50
# Steps up to where the series of a gamma ratio has settled.
_SHIFT = 16


def _gamma_ratio(z: Column) -> Column:
    """Gamma(z + 1/2) / Gamma(z): steps up by the recurrence, then the series around z - 1/4."""
    steps = F.lit(1.0)
    for k in range(_SHIFT):
        steps = steps * ((z + k) / (z + (k + 0.5)))
    w = z + (_SHIFT - 0.25)
    u = 1 / (w * w)
    return steps * F.sqrt(w) * (1 + u * (1 / 64 + u * (-19 / 8192 + u * (631 / 524288 + u * (-174317 / 134217728)))))


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, evaluated from its end."""

    def step(rest: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = (a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return 1 + even / (1 - odd / rest)

    down = F.sequence(F.lit(_STEPS), F.lit(1), F.lit(-1))
    rest = F.aggregate(F.transform(down, lambda m: m.cast("double")), F.lit(1.0), step)
    return 1 / (1 - (a + b) * x / (a + 1) / rest)


def t_pvalue(statistic: Column, df: Column) -> Column:
    """Two-sided p-value; NULL when the statistic is missing or ``df`` < 1.

    It is the incomplete beta function I_x(df/2, 1/2) at x = df / (df + t^2). Beyond the point
    where the fraction settles slowly its mirror 1 - I_(1-x)(1/2, df/2) is taken, so small values
    keep their digits.
    """
    n = df.cast("double")
    half, size = n / 2, F.abs(statistic) / F.sqrt(n)
    square = size * size
    x, rest = 1 / (1 + square), F.when(size > 1e8, 1.0).otherwise(square / (1 + square))
    log = F.when(size > 1e8, 2 * F.ln(size)).otherwise(F.log1p(square))
    tail = x < (half + 1) / (half + 2.5)
    a, b = F.when(tail, half).otherwise(0.5), F.when(tail, 0.5).otherwise(half)
    front = F.exp(-half * log) * F.sqrt(rest) * _gamma_ratio(half) / math.sqrt(math.pi) / a
    part = front * _fraction(a, b, F.when(tail, x).otherwise(rest))
    return F.when(statistic.isNotNull() & (df >= 1), F.when(tail, part).otherwise(1 - part))
