"""Means, ratios and calendar helpers with explicit missing-value rules.

Missing is always NULL here; NaN and infinities are turned into NULL where data
enters, and divisions by zero give NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """NaN and infinities become NULL."""
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def ratio(num: Column, den: Column) -> Column:
    return F.try_divide(num, den)


def strict_mean(x: Column) -> Column:
    """Mean that is missing as soon as one value is missing."""
    return F.when(F.count(x) == F.count(F.lit(1)), F.avg(x))


def poisoned_mean(x: Column, rows: Column, over: WindowSpec) -> Column:
    """Window mean of ``x`` over the chosen rows; one missing value makes it 0.

    NULL when the window holds no chosen row at all.
    """
    spoiled = F.max(F.when(rows, x.isNull())).over(over)
    return F.when(spoiled, F.lit(0.0)).otherwise(F.avg(F.when(rows, x)).over(over))


def rmse(target: Column, prediction: Column) -> Column:
    return F.sqrt(F.avg((target - prediction) * (target - prediction)))


def clip_unit(x: Column) -> Column:
    """Values beyond one in size become their sign; missing stays missing."""
    return F.when(x.isNull(), x).when(F.abs(x) >= 1, F.signum(x)).otherwise(x)


def week_of_year(day: Column) -> Column:
    """Count of complete seven-day blocks since 1 January, plus one."""
    return (F.floor((F.dayofyear(day) - 1) / 7) + 1).cast("int")


def tidy(x: Column, places: int) -> Column:
    """Rounded to ``places``, with a guard that sends near-ties upwards.

    Values such as k/8 fall on rounding ties; without the guard the last bit of a
    sum decides their last digit.
    """
    scale = 10.0**places
    return F.floor(x * scale + 0.5001) / scale
