"""The ordered chain of ratio factors.

A factor is the mean of (residual so far / trend) over the training rows that
share its levels. It explains ratio * trend of each row, and the next factor works
on what is left.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbline.functions.measures import poisoned_mean, ratio
from ebbline.settings import SERIES


@dataclass(frozen=True)
class Factor:
    """One factor: its name, its levels and the training rows it is fitted on."""

    name: str
    levels: tuple[str, ...]
    campaign_era: bool = False
    lagged_only: bool = False

    @property
    def ratio(self) -> str:
        return f"Ratio_{self.name}"

    @property
    def predict(self) -> str:
        return f"Predict_{self.name}"

    @property
    def residual(self) -> str:
        return f"Residual_{self.name}"

    @property
    def aggregate(self) -> str:
        return f"Agg_Predict_{self.name}"

    def rows(self) -> Column:
        """The training rows the factor is fitted on."""
        chosen = ~F.col("is_test")
        if self.campaign_era:
            chosen = chosen & F.col("campaign_era")
        if self.lagged_only:
            chosen = chosen & F.col("edm_lagged_flag")
        return chosen


@dataclass(frozen=True)
class VolumeFactor(Factor):
    """A factor regressed on campaign volume inside each level."""

    campaign_era: bool = True

    def rows(self) -> Column:
        return super().rows() & on_campaign()


def on_campaign() -> Column:
    return (F.col("edm_flag") == 1) & (F.col("sent.n") > 0)


# Factor names and levels, in training order.
RATIO_FACTORS = (
    Factor("SeasonalMonth", ("month_no",)),
    Factor("SeasonalDOW", ("day_no_week",)),
    Factor("SeasonalSchoolHoliday", ("school_holiday",)),
    Factor("SeasonalInfluentialDate", ("influential_date",)),
    Factor("EDMMajorAvg", ("edm_type",), campaign_era=True),
    Factor("EDMMajorMonth", ("edm_type", "month_no"), campaign_era=True),
    Factor("EDMMajorDOW", ("edm_type", "day_no_week"), campaign_era=True),
    Factor("EDMMajorLaggedAvg", ("prior_edm_type", "edm_lagged_flag"), campaign_era=True),
    Factor(
        "EDMMajorLaggedDays",
        ("prior_edm_type", "edm_lagged_flag", "days_from_edm_start"),
        campaign_era=True,
        lagged_only=True,
    ),
    Factor(
        "EDMMajorLaggedDaysDOW",
        ("edm_lagged_flag", "day_no_week", "days_from_edm_start"),
        campaign_era=True,
        lagged_only=True,
    ),
)
VOLUME_FACTORS = (
    VolumeFactor("EDMMajorMonthRgr", ("month_no",)),
    VolumeFactor("EDMMajorDOWRgr", ("day_no_week",)),
)
FACTORS: tuple[Factor, ...] = RATIO_FACTORS + VOLUME_FACTORS
BY_NAME = {f.name: f for f in FACTORS}


def _residual_after(so_far: Column, share: Column) -> Column:
    return so_far - F.coalesce(share, F.lit(0.0)) * F.col("trend")


def fit_ratio(df: DataFrame, factor: Factor) -> DataFrame:
    """Add the factor's ratio to every row and move ``left`` on to what remains.

    The ratio is a window over the series and its levels, so the levels of test
    rows pick up the training ratio without a join and NULL levels form a group.
    """
    group = Window.partitionBy(*SERIES, *factor.levels)
    share = poisoned_mean(ratio(F.col("left"), F.col("trend")), factor.rows(), group)
    return df.withColumn(factor.ratio, share).withColumn(
        "left", _residual_after(F.col("left"), F.col(factor.ratio))
    )


def fit_volume(df: DataFrame, factor: VolumeFactor) -> DataFrame:
    """Add the ratio regressed on campaign volume and move ``left`` on.

    ``sent`` holds the volumes of a day as (n, mean, sum of squares about the mean,
    min, max), so several campaigns on a day weigh as several observations without
    multiplying rows. A level with one volume only has no slope and explains
    nothing.
    """
    group = Window.partitionBy(*SERIES, *factor.levels)
    rows = factor.rows()
    n, x = F.col("sent.n"), F.col("sent.mean")
    y = F.coalesce(ratio(F.col("left"), F.col("trend")), F.lit(0.0))

    def total(value: Column) -> Column:
        return F.sum(F.when(rows, value)).over(group)

    sums = {
        "n": total(n),
        "x": total(n * x),
        "y": total(n * y),
        "low": F.min(F.when(rows, F.col("sent.min"))).over(group),
        "high": F.max(F.when(rows, F.col("sent.max"))).over(group),
    }
    at = F.col("_at")
    x_mean, y_mean = ratio(at["x"], at["n"]), ratio(at["y"], at["n"])
    dx = x - x_mean
    spread = {
        "sxx": total(F.col("sent.ss") + n * dx * dx),
        "sxy": total(n * dx * (y - y_mean)),
    }
    about = F.col("_about")
    slope = F.when(at["low"] < at["high"], ratio(about["sxy"], about["sxx"]))
    # sum over the day's campaigns of intercept + slope * volume
    share = F.when(on_campaign(), n * (y_mean + slope * dx))
    return (
        df.withColumn("_at", F.struct(*[v.alias(k) for k, v in sums.items()]))
        .withColumn("_about", F.struct(*[v.alias(k) for k, v in spread.items()]))
        .withColumn(factor.ratio, share)
        .withColumn("left", _residual_after(F.col("left"), F.col(factor.ratio)))
        .drop("_at", "_about")
    )


def fit_chain(df: DataFrame) -> DataFrame:
    """Fit all factors in training order in one pass over co-located series.

    Needs ``trend``, ``residual_trend``, ``is_test``, ``campaign_era`` and the day
    attributes. Every window is keyed by the series, so rows placed by product and
    stay (a bucketed stage, or one repartition) are never moved; local sorts are shared where the levels of
    one factor refine those of the one before. Columns the chain does not touch
    travel packed in one struct, which keeps the rows cheap to copy.
    """
    order = {
        "EDMMajorAvg": ("edm_type", "month_no"),
        "EDMMajorLaggedAvg": ("prior_edm_type", "edm_lagged_flag", "days_from_edm_start"),
    }
    levels = list(dict.fromkeys(level for f in FACTORS for level in f.levels))
    used = [*SERIES, *levels, "trend", "is_test", "campaign_era", "edm_flag", "sent"]
    carried = [c for c in df.columns if c not in used]
    df = df.select(
        *used, F.struct(*carried).alias("carried"), F.col("residual_trend").alias("left")
    )
    for factor in RATIO_FACTORS:
        if factor.name in order:
            df = df.sortWithinPartitions(*SERIES, *order[factor.name])
        df = fit_ratio(df, factor)
    for factor in VOLUME_FACTORS:
        df = fit_volume(df, factor)
    return df.select(*used, "carried.*", *[f.ratio for f in FACTORS])


def with_parts(df: DataFrame, upto: str = "EDMMajorDOWRgr") -> DataFrame:
    """Add what each factor explains, what it leaves and the running total."""
    left, total = F.col("residual_trend"), F.col("trend")
    df = df.withColumn("Predict_TrendLong", F.col("trend"))
    for factor in FACTORS:
        df = df.withColumn(
            factor.predict, F.coalesce(F.col(factor.ratio), F.lit(0.0)) * F.col("trend")
        ).withColumns(
            {
                factor.residual: left - F.col(factor.predict),
                factor.aggregate: total + F.col(factor.predict),
            }
        )
        left, total = F.col(factor.residual), F.col(factor.aggregate)
        if factor.name == upto:
            break
    return df


def residual_before(factor: Factor) -> str:
    place = FACTORS.index(factor)
    return FACTORS[place - 1].residual if place else "residual_trend"
