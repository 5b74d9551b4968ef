"""Regime tags, growing window widths and amount cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbline.functions.measures import finite
from ebbline.settings import SERIES, Settings

# Regimes follow each other in time, so ordering a series by regime and date is
# ordering it by date; sharing this order lets every window below reuse one sort.
TIME = ["regime_no", "date"]


def _by_regime(settings: Settings, pick) -> Column:
    day = F.col("date")
    *closed, final = list(enumerate(settings.regimes, start=1))
    chain = F.when(F.lit(False), pick(*final))
    for number, regime in closed:
        chain = chain.when(day <= F.lit(regime.last), pick(number, regime))
    return chain.otherwise(pick(*final))


def tag_regime(df: DataFrame, settings: Settings) -> DataFrame:
    """Add the name and the running number of the regime each date falls in."""
    return df.withColumns(
        {
            "regime": _by_regime(settings, lambda number, regime: F.lit(regime.name)),
            "regime_no": _by_regime(settings, lambda number, regime: F.lit(number)),
        }
    )


def growing_width(df: DataFrame, settings: Settings) -> DataFrame:
    """Add ``width``: days since the series entered the regime, capped."""
    entered = F.first("date").over(Window.partitionBy(*SERIES, "regime_no").orderBy("date"))
    days = F.datediff(F.col("date"), entered) + 1
    return df.withColumn("width", F.least(F.lit(settings.trend_cap), days))


def clean_amounts(df: DataFrame, settings: Settings) -> DataFrame:
    """Add ``amount``: prices carry the last sound value forward, gaps become 0."""
    price = F.col("amount_type") == settings.price_measure
    raw = finite(F.col("raw_amount"))
    usable = F.when(price & (raw == 0), F.lit(None)).otherwise(raw)
    so_far = Window.partitionBy(*SERIES).orderBy(*TIME).rowsBetween(Window.unboundedPreceding, 0)
    carried = F.last(usable, ignorenulls=True).over(so_far)
    amount = F.coalesce(F.when(price, carried).otherwise(usable), F.lit(0.0))
    return df.withColumn("amount", amount)
