"""Grouped simple linear regression in closed form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbline.functions.measures import ratio
from ebbline.functions.student import t_pvalue

# Coefficient names.
INTERCEPT = "Intercept"


def fit_terms(
    df: DataFrame, keys: list[str], slope_name: str, n: Column, x_mean: Column, y_mean: Column,
    sxx: Column, sxy: Column, syy: Column,
) -> DataFrame:
    """Two rows per group, intercept and slope, with error, statistic and p-value.

    ``sxx`` is NULL where the regressor does not vary: the slope is then missing
    and the intercept is the mean of the response.
    """
    flat = sxx.isNull()
    slope = ratio(sxy, sxx)
    left = F.greatest(syy - F.coalesce(sxy * slope, F.lit(0.0)), F.lit(0.0))
    freedom = n - F.when(flat, 1).otherwise(2)
    noise = F.when(freedom > 0, ratio(left, freedom))
    with_stats = df.select(
        *keys,
        freedom.alias("_df"),
        F.array(
            F.struct(
                F.lit(INTERCEPT).alias("coefficient_name"),
                F.when(flat, y_mean).otherwise(y_mean - slope * x_mean).alias("coefficient_value"),
                F.sqrt(
                    noise * (ratio(F.lit(1.0), n) + F.coalesce(ratio(x_mean * x_mean, sxx), F.lit(0.0)))
                ).alias("std_error"),
            ),
            F.struct(
                F.lit(slope_name).alias("coefficient_name"),
                slope.alias("coefficient_value"),
                F.sqrt(ratio(noise, sxx)).alias("std_error"),
            ),
        ).alias("_terms"),
    )
    statistic = ratio(F.col("coefficient_value"), F.col("std_error"))
    return (
        with_stats.select(*keys, "_df", F.inline("_terms"))
        .withColumn("statistic", statistic)
        .withColumn("p_value", t_pvalue(F.col("statistic"), F.col("_df")))
        .drop("_df")
    )


def ols_by_group(df: DataFrame, keys: list[str], y: str, x: str) -> DataFrame:
    """Regress ``y`` on ``x`` inside each group over the rows that have both."""
    xc, yc = F.col(x), F.col(y)
    sums = (
        df.filter(xc.isNotNull() & yc.isNotNull())
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).cast("double").alias("n"),
            F.avg(xc).alias("x_mean"),
            F.avg(yc).alias("y_mean"),
            F.when(F.min(xc) < F.max(xc), F.regr_sxx(yc, xc)).alias("sxx"),
            F.regr_sxy(yc, xc).alias("sxy"),
            F.regr_syy(yc, xc).alias("syy"),
        )
    )
    return fit_terms(
        sums, keys, x, *[F.col(c) for c in ("n", "x_mean", "y_mean", "sxx", "sxy", "syy")]
    )


def line(y: str, x: str, suffix: str = "") -> list[Column]:
    """Aggregates: slope and intercept of a straight line through the points of a group."""
    xc, yc = F.col(x), F.col(y)
    varies = F.min(F.when(yc.isNotNull(), xc)) < F.max(F.when(yc.isNotNull(), xc))
    return [
        F.when(varies, F.regr_slope(yc, xc)).alias(f"slope{suffix}"),
        F.when(varies, F.regr_intercept(yc, xc)).alias(f"intercept{suffix}"),
    ]


def panel_lines(df: DataFrame, keys: list[str], y: str, x: str) -> DataFrame:
    """Slope and intercept of a straight line per panel."""
    return df.groupBy(*keys).agg(F.regr_count(F.col(y), F.col(x)).alias("n_points"), *line(y, x))
