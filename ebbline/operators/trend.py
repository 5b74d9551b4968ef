"""Centred long-term trend, residual and relative price change."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbline.functions.measures import ratio
from ebbline.operators.clean import TIME
from ebbline.settings import SERIES, Settings


def centred_trend(df: DataFrame) -> DataFrame:
    """Add ``trend``: the mean of ``width`` rows around each row of its regime.

    A row of width w covers floor((w-1)/2) rows before it and floor(w/2) rows
    after it, cut at the ends of the regime. Frames of varying width become two
    look-ups in the running sum of the regime, so the work per row does not grow
    with the width. The running sums of one series and regime, one per day, are
    held as an array; nothing else is gathered.
    """
    in_regime = (
        Window.partitionBy(*SERIES, "regime_no")
        .orderBy("date")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    carried = [c for c in df.columns if c not in (*SERIES, "regime_no")]
    fields = ["date", *[c for c in carried if c != "date"], "running"]
    gathered = (
        df.withColumn("running", F.sum("amount").over(in_regime))
        .groupBy(*SERIES, "regime_no")
        .agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("days"))
        .withColumn("n_days", F.size("days"))
    )

    def with_trend(row, index):
        place = index + 1
        before = F.greatest(place - 1 - F.floor((row["width"] - 1) / 2), F.lit(0)).cast("int")
        upto = F.least(place + F.floor(row["width"] / 2), F.col("n_days")).cast("int")
        left_out = F.when(
            before > 0, F.element_at("days", F.greatest(before, F.lit(1)))["running"]
        ).otherwise(0.0)
        total = F.element_at("days", upto)["running"] - left_out
        return F.struct(
            *[row[c].alias(c) for c in carried], (total / (upto - before)).alias("trend")
        )

    return gathered.select(*SERIES, "regime_no", F.inline(F.transform("days", with_trend)))


def centred_trend_by_frames(df: DataFrame, settings: Settings) -> DataFrame:
    """The same trend from a fixed frame of ``trend_cap`` rows per row.

    Costs one copy of the frame per row; kept as the plain statement of the
    definition that :func:`centred_trend` is tested against.
    """
    cap = settings.trend_cap
    back, ahead = (cap - 1) // 2, cap // 2
    in_regime = Window.partitionBy(*SERIES, "regime_no").orderBy("date")
    frame = F.collect_list("amount").over(in_regime.rowsBetween(-back, ahead))
    place = F.row_number().over(in_regime)
    rows_before = F.least(place - 1, F.lit(back))
    want_before = F.floor((F.col("width") - 1) / 2)
    skip = F.greatest(F.col("rows_before") - want_before, F.lit(0))
    length = F.least(F.col("rows_before"), want_before) + 1 + F.floor(F.col("width") / 2)
    cut = F.slice("frame", (skip + 1).cast("int"), length.cast("int"))
    return (
        df.withColumns({"frame": frame, "rows_before": rows_before})
        .withColumn("frame", cut)
        .withColumn(
            "trend",
            F.aggregate("frame", F.lit(0.0), lambda a, x: a + x) / F.size("frame"),
        )
        .drop("frame", "rows_before")
    )


def detrend(df: DataFrame) -> DataFrame:
    return df.withColumn("residual_trend", F.col("amount") - F.col("trend"))


def price_change(df: DataFrame, settings: Settings) -> DataFrame:
    """Add the daily price change relative to the prior day and to the trend.

    The change is computed on the price rows and shared with all measures of the
    same day, product and stay.
    """
    is_price = F.col("amount_type") == settings.price_measure
    prior = F.lag("amount").over(Window.partitionBy(*SERIES).orderBy(*TIME))
    change = F.col("amount") - F.col("amount_prior")
    same_day = Window.partitionBy("product_key", "stay_key", "date")

    def shared(x):
        return F.max(F.when(is_price, x)).over(same_day)

    return (
        df.withColumn("amount_prior", prior)
        .withColumns(
            {
                "price_change_prior": shared(ratio(change, F.col("amount_prior"))),
                "price_change_trend": shared(ratio(change, F.col("trend"))),
            }
        )
        .drop("amount_prior")
    )


def monthly_average(df: DataFrame) -> DataFrame:
    """Attach the mean amount of the series in the same year and month."""
    month = Window.partitionBy(*SERIES, F.year("date"), F.month("date"))
    return df.withColumn("month_average", F.avg("amount").over(month))
