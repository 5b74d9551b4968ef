"""Factor checks, residual studies and the tables behind the charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbline.functions.measures import clip_unit, finite, ratio, strict_mean, week_of_year
from ebbline.operators.factors import BY_NAME, FACTORS, Factor, residual_before
from ebbline.operators.hierarchy import NAMES, with_hierarchy
from ebbline.operators.regression import INTERCEPT, line, ols_by_group, panel_lines
from ebbline.operators.score import volume_points
from ebbline.plans.accuracy import with_stay_name
from ebbline.settings import SERIES, Settings

LAST_RESIDUAL = FACTORS[-1].residual


def _left_before(factor: Factor) -> str:
    """The residual shown before a factor; the lagged-days check looks one back."""
    if factor.name == "EDMMajorLaggedDays":
        return BY_NAME["EDMMajorDOW"].residual
    return residual_before(factor)


def factor_check(parts: DataFrame, name: str) -> DataFrame:
    """Mean relative residual per factor level before and after the factor."""
    factor = BY_NAME[name]
    rows = parts.filter(factor.rows())
    means = [
        strict_mean(ratio(F.col(column), F.col("trend"))).alias(alias)
        for column, alias in ((_left_before(factor), "mean_before"), (factor.residual, "mean_after"))
    ]
    return rows.groupBy(*SERIES, *factor.levels).agg(*means)


def lagged_weekday_check(
    parts: DataFrame, dim_stay: DataFrame, stays: tuple[int, ...] = ()
) -> DataFrame:
    """The weekday-after-campaign check by stay name, with the sign of the mean; of the given
    stays only, where there are any."""
    rows = parts.filter(F.col("stay_key").isin(*stays)) if stays else parts
    checked = factor_check(rows, "EDMMajorLaggedDaysDOW").drop("edm_lagged_flag")
    return with_stay_name(checked, dim_stay).drop("stay_key").withColumn(
        "sign_before", F.signum("mean_before")
    )


def running_parts(parts: DataFrame) -> DataFrame:
    """What each factor leaves and the running prediction after it, per row."""
    return parts.select("date", *SERIES, *[c for f in FACTORS for c in (f.residual, f.aggregate)])


def volume_lines(parts: DataFrame, campaigns: DataFrame, name: str) -> DataFrame:
    """Straight lines through the campaign points of each panel."""
    points = volume_points(parts, campaigns, name)
    keys = [*SERIES, *BY_NAME[name].levels]
    return points.groupBy(*keys).agg(
        F.regr_count("ratio_before", "amount_sent").alias("n_points"),
        *line("ratio_before", "amount_sent"),
        *line("ratio_after", "amount_sent", "_after"),
    )


def trend_lines(main: DataFrame) -> DataFrame:
    """Straight lines over time through amount and de-trended amount of a series."""
    day = F.datediff(F.col("date"), F.lit("1970-01-01").cast("date")).cast("double")
    rows = main.withColumn("day", day)
    aggregates = []
    for column in ("amount", "residual_trend"):
        y = F.col(column)
        varies = F.min("day") < F.max("day")
        aggregates += [
            F.when(varies, F.regr_slope(y, F.col("day"))).alias(f"{column}_slope"),
            F.when(varies, F.regr_intercept(y, F.col("day"))).alias(f"{column}_intercept"),
        ]
    return rows.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n_points"), *aggregates)


def relative_residuals(training: DataFrame, settings: Settings) -> DataFrame:
    """Volume rows with their relative residual and the price change of the day."""
    return training.filter(F.col("amount_type") == settings.volume_measure).select(
        "date",
        *SERIES,
        "day_no_week",
        "trend",
        finite(ratio(F.col(LAST_RESIDUAL), F.col("trend"))).alias("resid_perc"),
        "price_change_prior",
        "price_change_trend",
        "amount",
    )


def _named_rows(
    training: DataFrame,
    dim_stay: DataFrame,
    settings: Settings,
    years: tuple[int, int] | None,
    without: tuple[str, ...],
) -> DataFrame:
    rows = relative_residuals(training, settings)
    if years:
        rows = rows.filter(F.year("date").between(*years))
    rows = with_stay_name(rows, dim_stay)
    if without:
        rows = rows.filter(F.col("stay_name").isNull() | ~F.col("stay_name").isin(*without))
    clipped = clip_unit(F.col("resid_perc"))
    return rows.withColumns({"perc_var": clipped, "abs_perc_var": F.abs(clipped)})


def residual_heat(
    training: DataFrame,
    dim_stay: DataFrame,
    settings: Settings,
    years: tuple[int, int] | None = None,
    without: tuple[str, ...] = (),
) -> DataFrame:
    """Clipped relative residual per day with the first day seen of its week.

    A week of one product holds at most seven days per stay, so its first day comes
    from a window.
    """
    rows = _named_rows(training, dim_stay, settings, years, without).withColumns(
        {"year_no": F.year("date"), "week_no": week_of_year(F.col("date"))}
    )
    week = Window.partitionBy("product_key", "year_no", "week_no")
    return rows.withColumn("start_of_week", F.min("date").over(week)).select(
        "date",
        "product_key",
        "stay_name",
        "day_no_week",
        "start_of_week",
        "perc_var",
        "abs_perc_var",
    )


def stay_label_breaks(dim_stay: DataFrame, without: tuple[str, ...] = ()) -> DataFrame:
    """Every other stay name by rank, as used for axis labels."""
    named = dim_stay.filter(~F.col("stay_name").isin(*without)) if without else dim_stay
    return (
        named.filter(F.col("stay_rank") % 2 == 1)
        .select("stay_name")
        .distinct()
    )


def residual_sample(
    training: DataFrame,
    dim_stay: DataFrame,
    settings: Settings,
    years: tuple[int, int] | None = None,
    without: tuple[str, ...] = (),
) -> DataFrame:
    """Error and bias in percent, total and share of total per product and stay."""
    per_stay = (
        _named_rows(training, dim_stay, settings, years, without)
        .groupBy("product_key", "stay_name")
        .agg(
            (F.lit(100) * F.round(strict_mean(F.col("abs_perc_var")), 2)).alias("mae_percent"),
            (F.lit(100) * F.round(strict_mean(F.col("perc_var")), 2)).alias("mbe_percent"),
            F.sum("amount").alias("total_purchases"),
        )
    )
    whole = F.sum("total_purchases").over(Window.partitionBy("product_key"))
    share = F.round(ratio(F.lit(100) * F.col("total_purchases"), whole), 2)
    return per_stay.withColumn("share_percent", share)


def price_correlation(training: DataFrame, dim_stay: DataFrame, settings: Settings) -> DataFrame:
    """Correlation of price change and relative residual per product and stay."""
    rows = with_stay_name(relative_residuals(training, settings), dim_stay)

    def correlation(x: str) -> Column:
        both = F.col(x).isNotNull() & F.col("resid_perc").isNotNull()
        varies = (F.min(F.when(both, F.col(x))) < F.max(F.when(both, F.col(x)))) & (
            F.min(F.when(both, F.col("resid_perc"))) < F.max(F.when(both, F.col("resid_perc")))
        )
        return F.when(varies, F.corr(x, "resid_perc"))

    return rows.groupBy("product_key", "stay_name").agg(
        correlation("price_change_prior").alias("cor_prior"),
        correlation("price_change_trend").alias("cor_trend"),
        F.round(correlation("price_change_trend"), 2).alias("against_trend"),
        F.round(correlation("price_change_prior"), 2).alias("against_prior_day"),
        F.sum("amount").alias("total_purchases"),
    )


def price_regression(
    training: DataFrame, dim_stay: DataFrame, settings: Settings, x: str
) -> DataFrame:
    """Slope of the relative residual on a price change, with its p-value."""
    rows = with_stay_name(relative_residuals(training, settings), dim_stay)
    terms = ols_by_group(rows, ["product_key", "stay_name"], "resid_perc", x)
    return terms.filter(F.col("coefficient_name") != INTERCEPT)


def price_points(
    training: DataFrame, dim_stay: DataFrame, settings: Settings, only: tuple[str, ...] = ()
) -> DataFrame:
    """Relative residual and price change to the trend in whole percent."""
    rows = with_stay_name(relative_residuals(training, settings), dim_stay)
    if only:
        rows = rows.filter(F.col("stay_name").isin(*only))
    return rows.select(
        "date",
        "product_key",
        "stay_name",
        F.round(100 * F.col("resid_perc"), 0).alias("resid_percent"),
        F.round(100 * F.col("price_change_trend"), 0).alias("price_change_percent"),
    )


def price_lines(
    training: DataFrame, dim_stay: DataFrame, settings: Settings, only: tuple[str, ...] = ()
) -> DataFrame:
    """Lines through the price points that lie within 100 percent."""
    points = price_points(training, dim_stay, settings, only).filter(
        F.abs("resid_percent") <= 100
    )
    return panel_lines(
        points, ["product_key", "stay_name"], "resid_percent", "price_change_percent"
    )


def price_prior_lines(
    training: DataFrame, dim_stay: DataFrame, settings: Settings, only: tuple[str, ...] = ()
) -> DataFrame:
    rows = with_stay_name(relative_residuals(training, settings), dim_stay)
    if only:
        rows = rows.filter(F.col("stay_name").isin(*only))
    return panel_lines(rows, ["product_key", "stay_name"], "resid_perc", "price_change_prior")


def histogram(df: DataFrame, keys: list[str], value: str, bins: int) -> DataFrame:
    """Counts per equal-width bin between the least and largest value of a group.

    Bins are numbered from 1; empty bins have no row; a group with one distinct
    value has the single bin 1.
    """
    group = Window.partitionBy(*keys)
    joined = df.withColumns({"_lo": F.min(value).over(group), "_hi": F.max(value).over(group)})
    place = F.floor(ratio((F.col(value) - F.col("_lo")) * bins, F.col("_hi") - F.col("_lo")))
    bin_no = F.least(F.coalesce(place, F.lit(0)) + 1, F.lit(bins)).cast("int")
    return (
        joined.filter(F.col(value).isNotNull())
        .groupBy(*keys, "_lo", "_hi", bin_no.alias("bin_no"))
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .select(
            *keys,
            "bin_no",
            (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("bin_no") - 1) / bins).alias(
                "bin_from"
            ),
            "n_rows",
        )
    )


def residual_histogram(scored: DataFrame, bins: int = 20) -> DataFrame:
    """Histogram of the daily residual of each product."""
    keys = ["data", "product_key", "amount_type"]
    daily = scored.groupBy("date", *keys).agg(F.sum("Residual").alias("residual"))
    return histogram(daily, keys, "residual", bins)


def sales_histogram(scored: DataFrame, bins: int = 30) -> DataFrame:
    """Histogram of the daily sales of each series."""
    return histogram(scored.select("data", *SERIES, "Amount"), ["data", *SERIES], "Amount", bins)


def _occurring(scored: DataFrame) -> DataFrame:
    """The decomposition names of the long form that have a value in any row: all values are
    counted by part in one pass, and the one row of counts is turned."""
    counts = scored.agg(*[F.count(n).alias(n) for n in NAMES])
    found = counts.unpivot([], NAMES, "decomposition_name", "n_values")
    return found.filter("n_values > 0").select("decomposition_name")


def factor_listing(scored: DataFrame) -> DataFrame:
    """The model parts that occur, with both of their groups."""
    return (
        with_hierarchy(_occurring(scored))
        .select("decomposition_l1", "decomposition_l2", "decomposition_name")
        .filter(F.col("decomposition_l1") == "Model Results")
    )


def hierarchy_table(scored: DataFrame) -> DataFrame:
    """Distinct decomposition names with both groups and their display rank."""
    return with_hierarchy(_occurring(scored))
