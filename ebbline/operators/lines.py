"""Straight lines over time from mergeable sums per month.

The fit of a line needs n, sx, sy, sxx and sxy only, and these add up. Kept per series and month,
with days counted from the start of the month, they give the line through any stretch of days as
a sum of few rows: whole months from their sums, days of cut months one by one.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbline.functions.measures import ratio

SUMS = ["n", "sx", "sy", "sxx", "sxy"]
# Where the intercept of a line is taken.
EPOCH = date(1970, 1, 1)


def _sums(x: Column, y: Column) -> list[Column]:
    return [
        F.count(y).cast("double").alias("n"),
        F.sum(F.when(y.isNotNull(), x)).alias("sx"),
        F.sum(y).alias("sy"),
        F.sum(F.when(y.isNotNull(), x * x)).alias("sxx"),
        F.sum(x * y).alias("sxy"),
    ]


def month_sums(df: DataFrame, keys: list[str], y: str) -> DataFrame:
    """keys, month and the sums of ``y`` over the days of the month."""
    month = F.trunc("date", "month")
    x = F.datediff("date", "month").cast("double")
    return df.withColumn("month", month).groupBy(*keys, "month").agg(*_sums(x, F.col(y)))


def _shifted(origin: date) -> list[Column]:
    """The sums of a row with days counted from ``origin``."""
    d = F.datediff("month", F.lit(origin)).cast("double")
    n, sx, sy, sxx, sxy = (F.col(c) for c in SUMS)
    return [
        n,
        (sx + n * d).alias("sx"),
        sy,
        (sxx + 2 * d * sx + n * d * d).alias("sxx"),
        (sxy + d * sy).alias("sxy"),
    ]


def _line(rows: DataFrame, keys: list[str], origin: date) -> DataFrame:
    """n_points, slope and the line's value at the epoch; NULL where all days are one."""
    total = rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in SUMS])
    n, sx, sy, sxx, sxy = (F.col(c) for c in SUMS)
    spread = n * sxx - sx * sx
    slope = F.when(spread > 0, (n * sxy - sx * sy) / spread)
    from_epoch = (origin - EPOCH).days
    return total.select(
        *keys, n.cast("bigint").alias("n_points"), slope.alias("slope"),
        ((sy - slope * sx) / n - slope * from_epoch).alias("epoch_intercept"),
    )


def _whole_months(first: date, last: date) -> tuple[date, date]:
    """The first month that starts in the stretch, and the first day behind its whole months."""
    low = first if first.day == 1 else (first.replace(day=1) + timedelta(days=32)).replace(day=1)
    behind = last + timedelta(days=1)
    return low, behind.replace(day=1)


def window_lines(
    months: DataFrame, days: DataFrame, keys: list[str], y: str, first: date, last: date
) -> DataFrame:
    """The line through ``y`` of all days from ``first`` to ``last``.

    ``months`` are the sums of the rows in ``days``, which is read for cut months only.
    """
    low, high = _whole_months(first, last)
    month = F.col("month")
    if low < high:
        inside = (month >= F.lit(low)) & (month < F.lit(high))
        cut = F.col("date").between(F.lit(first), F.lit(low - timedelta(days=1))) | F.col("date").between(
            F.lit(high), F.lit(last)
        )
    else:
        inside, cut = F.lit(False), F.col("date").between(F.lit(first), F.lit(last))
    rows = months.filter(inside).select(*keys, *_shifted(first))
    if not (low == first and high == last + timedelta(days=1)):
        one = month_sums(days.filter(cut), keys, y)
        rows = rows.unionByName(one.select(*keys, *_shifted(first)))
    return _line(rows, keys, first)


def monthly_mean_lines(months: DataFrame, keys: list[str], first: date, last: date) -> DataFrame:
    """The line through the mean of each month, one point per day, over whole months.

    A day stands for the mean of its month, so a month's sxy is sx * sy / n.
    """
    low, high = _whole_months(first, last)
    if low != first or high != last + timedelta(days=1):
        raise ValueError("lines through monthly means need whole months")
    inside = (F.col("month") >= F.lit(low)) & (F.col("month") < F.lit(high))
    flat = months.filter(inside).withColumn("sxy", F.coalesce(ratio(F.col("sx") * F.col("sy"), F.col("n")), F.lit(0.0)))
    return _line(flat.select(*keys, *_shifted(first)), keys, first)
