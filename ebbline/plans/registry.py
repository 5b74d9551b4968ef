"""Every report table by name, over the order tables of a folder."""

from __future__ import annotations

import functools
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbline.functions.measures import tidy
from ebbline.operators import clean, hierarchy, lines, split, trend
from ebbline.operators.factors import BY_NAME, VolumeFactor
from ebbline.operators.score import Model
from ebbline.plans import accuracy as acc
from ebbline.plans import results, stages, studies
from ebbline.plans.stages import Decomposition
from ebbline.plans.results import Results
from ebbline.settings import SERIES
from ebbline.sources import orders

Query = Callable[[SparkSession, str], DataFrame]
Table = Callable[[Decomposition], DataFrame]

ROW = ["date", *SERIES]
# The year of the filtered report tables.
ONE_YEAR = (1996, 1996)
# Stretches of the straight lines over time: whole months, one month, and cut months.
LINE_WINDOWS = {
    "long": (date(1996, 2, 1), date(1996, 8, 31)),
    "short": (date(1996, 2, 1), date(1996, 2, 29)),
    "cut": (date(1996, 11, 12), date(1997, 3, 9)),
}
MONTHLY = (date(1996, 1, 1), date(1997, 12, 31))
# Products are split by supplier into so many for work on many series.
FINE = 50


def present(df: DataFrame, places: dict[str, int], default: int = 4) -> DataFrame:
    """Round the double columns for display."""
    shown = [
        tidy(F.col(f.name), places.get(f.name, default)).alias(f.name)
        if isinstance(f.dataType, T.DoubleType)
        else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(*shown)


def _fit(name: str) -> Table:
    return lambda d: d.model_table(name)


def _check(name: str) -> Table:
    return lambda d: studies.factor_check(d.parts, name)


def _points(name: str) -> Table:
    return lambda d: studies.volume_points(d.parts, d.campaigns, name)


def _lines(name: str) -> Table:
    return lambda d: studies.volume_lines(d.parts, d.campaigns, name)


def _training(build: Callable[..., DataFrame], *more) -> Table:
    return lambda d: build(d.campaign_training, d.dim_stay, d.settings, *more)


def _monthly(d: Decomposition) -> DataFrame:
    train = d.divided.filter(~F.col("is_test")).select(*ROW, "amount")
    return trend.monthly_average(train).select(*ROW, "month_average")


def _window_lines(d: Decomposition) -> DataFrame:
    """Lines through the training amounts of seven months and of one."""
    training = d.divided.filter(~F.col("is_test")).select(*ROW, "amount")
    found = [
        lines.window_lines(d.month_sums, training, SERIES, "amount", first, last).withColumn("window", F.lit(name))
        for name, (first, last) in LINE_WINDOWS.items()
    ]
    return functools.reduce(DataFrame.unionByName, found)


def _split_by_series(d: Decomposition) -> DataFrame:
    """What the split gives each series and stratum."""
    return d.divided.groupBy(*SERIES, "stratum").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.col("is_test").cast("bigint")).alias("n_test"),
        F.min("amount").alias("least"),
        F.max("amount").alias("most"),
    )


# Short names of the factor tables.
FACTOR_TABLES = {
    "month": "SeasonalMonth",
    "dow": "SeasonalDOW",
    "school_holiday": "SeasonalSchoolHoliday",
    "influential": "SeasonalInfluentialDate",
    "edm_avg": "EDMMajorAvg",
    "edm_month": "EDMMajorMonth",
    "edm_dow": "EDMMajorDOW",
    "lag_avg": "EDMMajorLaggedAvg",
    "lag_days": "EDMMajorLaggedDays",
    "lag_days_dow": "EDMMajorLaggedDaysDOW",
    "month_rgr": "EDMMajorMonthRgr",
    "dow_rgr": "EDMMajorDOWRgr",
}

_FINE = {"coefficient_value": 8, "std_error": 8, "slope": 8, "slope_after": 8, "intercept": 6,
         "intercept_after": 6, "amount_slope": 6, "residual_trend_slope": 6,
         "epoch_intercept": 3, "amount_intercept": 4, "residual_trend_intercept": 4}


def tables() -> dict[str, Table]:
    found: dict[str, Table] = {
        "daily_fact": lambda d: d.inputs.daily_fact,
        "calendar": lambda d: d.inputs.calendar,
        "campaigns": lambda d: d.inputs.campaigns,
        "regime_tag": lambda d: clean.tag_regime(d.inputs.daily_fact, d.settings).select(
            *ROW, "regime", "regime_no"
        ),
        "growing_width": lambda d: stages.cleaned(d.inputs.daily_fact, d.settings).select(
            *ROW, "width"
        ),
        "clean_amounts": lambda d: stages.cleaned(d.inputs.daily_fact, d.settings).select(
            *ROW, "amount"
        ),
        "centred_trend": lambda d: stages.trended(
            d.inputs.daily_fact, d.settings, d.placed
        ).select(*ROW, "trend"),
        "detrend": lambda d: d.main.select(*ROW, "amount", "trend", "residual_trend"),
        "price_change": lambda d: d.main.select(*ROW, "price_change_prior", "price_change_trend"),
        "monthly_average": _monthly,
        "hash_split": lambda d: d.divided.select(*ROW, "stratum", "is_test"),
        "split_balance": lambda d: split.split_balance(d.divided),
        "split_within_series": lambda d: split.split_balance(
            split.split_within_series(d.main, d.settings.test_share), *SERIES
        ),
        "check_lag_days_dow_named": lambda d: studies.lagged_weekday_check(d.parts, d.dim_stay),
        "check_lag_days_dow_stays": lambda d: studies.lagged_weekday_check(d.parts, d.dim_stay, (2,)),
        "trend_lines": lambda d: studies.trend_lines(d.main),
        "lines_window": _window_lines,
        "lines_monthly": lambda d: lines.monthly_mean_lines(d.month_sums, SERIES, *MONTHLY),
        "model_sample": lambda d: d.model_sample("SeasonalMonth", 1, 1, 103),
        "acc_one_product": lambda d: acc.accuracy_of_product(d.scored_in_place, d.dim_stay, 2, ("short",)),
        "score_wide": lambda d: d.scored,
        "score_in_place": lambda d: d.scored_in_place,
        "decomposition_long": lambda d: hierarchy.decompose_long(d.scored_in_place),
        "hierarchy": lambda d: studies.hierarchy_table(d.scored_in_place),
        "factor_listing": lambda d: studies.factor_listing(d.scored_in_place),
        "acc_full": lambda d: acc.accuracy_by_stay_name(d.scored_in_place, d.dim_stay),
        "acc_product": lambda d: acc.accuracy(d.scored_in_place, acc.PRODUCT),
        "acc_high": lambda d: acc.accuracy(d.scored_in_place, acc.HIGH),
        "acc_grains": lambda d: acc.accuracy_all_grains(d.scored_in_place),
        "acc_rounded": lambda d: acc.accuracy_rounded(d.scored_in_place, d.dim_stay),
        "overall_acc": lambda d: acc.overall_accuracy(d.scored_in_place),
        "step_full": lambda d: acc.error_steps_by_stay_name(d.scored_in_place, d.dim_stay),
        "step_product": lambda d: acc.error_steps(d.scored_in_place, acc.PRODUCT),
        "step_high": lambda d: acc.error_steps(d.scored_in_place, acc.HIGH),
        "overall_step": lambda d: acc.overall_steps(d.scored_in_place),
        "step_percent": lambda d: acc.error_step_percent(d.scored_in_place),
        "product_series": lambda d: acc.daily_series(d.scored_in_place, acc.PRODUCT),
        "product_series_wide": lambda d: acc.spread_levels(
            hierarchy.decompose_long(d.scored_in_place), acc.PRODUCT
        ),
        "residual_heat": _training(studies.residual_heat),
        "residual_sample": _training(studies.residual_sample),
        "price_corr": _training(studies.price_correlation),
        "price_regression_prior": _training(studies.price_regression, "price_change_prior"),
        "price_regression_trend": _training(studies.price_regression, "price_change_trend"),
        "price_points": _training(studies.price_points),
        "price_lines": _training(studies.price_lines),
        "price_prior_lines": _training(studies.price_prior_lines),
        "residual_heat_year": _training(studies.residual_heat, ONE_YEAR, ("long",)),
        "residual_sample_year": _training(studies.residual_sample, ONE_YEAR, ("long",)),
        "price_points_named": _training(studies.price_points, ("short",)),
        "price_lines_named": _training(studies.price_lines, ("short",)),
        "price_prior_lines_named": _training(studies.price_prior_lines, ("short",)),
        "residual_histogram": lambda d: studies.residual_histogram(d.scored_in_place),
        "sales_histogram": lambda d: studies.sales_histogram(d.scored_in_place),
    }
    for short, name in FACTOR_TABLES.items():
        found[f"fit_{short}"] = _fit(name)
        if isinstance(BY_NAME[name], VolumeFactor):
            found[f"points_{short}"] = _points(name)
            found[f"lines_{short}"] = _lines(name)
        else:
            found[f"check_{short}"] = _check(name)
    return found


def _loaded(spark: SparkSession, folder: str) -> Results:
    """A model fitted on line counts, saved, loaded and applied to the units of the same lines."""
    fitted = stages.from_orders(spark, folder)
    path = f"{fitted.store.folder}/models/{fitted.label}"
    # saved once per application: saving again would change files that lazy results still read
    if fitted.store.once(path):
        fitted.model.save(path, fitted.settings)
    new = stages.from_orders(spark, folder, volume=orders.UNITS).inputs
    model = Model.load(spark, path, fitted.settings)
    return results.apply_model(new, model, fitted.settings, fitted.store, "loaded", placed=True)


def _by_grain(*frames: DataFrame) -> DataFrame:
    """The reports of series, product and measure in one table."""
    tagged = [f.withColumn("grain", F.lit(g)) for f, g in zip(frames, ("full", "product", "high"))]
    whole = tagged[0]
    for one in tagged[1:]:
        whole = whole.unionByName(one, allowMissingColumns=True)
    return whole


LOADED: dict[str, Callable[[Results], DataFrame]] = {
    "score_loaded": lambda r: r.scored,
    "loaded_long": lambda r: r.long,
    "loaded_series": lambda r: r.series,
    "loaded_acc": lambda r: _by_grain(r.accuracy_full, r.accuracy_product, r.accuracy_high),
    "loaded_steps": lambda r: _by_grain(r.steps_full, r.steps_product, r.steps_high),
}


def _loaded_query(pick: Callable[[Results], DataFrame]) -> Query:
    return lambda spark, folder: present(pick(_loaded(spark, folder)), _FINE)


def _query(table: Table) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return present(table(stages.from_orders(spark, folder)), _FINE)

    return run


def queries() -> dict[str, Query]:
    more = {
        # running sums of large prices: shown to cents, as wide as their rounding errors allow
        "running_parts": lambda spark, folder: present(
            studies.running_parts(stages.from_orders(spark, folder).parts), {}, 2
        ),
        "hash_split_fine": lambda spark, folder: present(
            _split_by_series(stages.from_orders(spark, folder, FINE)), _FINE
        ),
        "stay_label_breaks": lambda spark, folder: studies.stay_label_breaks(
            orders.priority_stays(spark.read.parquet(f"{folder}/orders.parquet")), ("5-LOW",)
        ),
    }
    return {name: _query(table) for name, table in tables().items()} | more | {
        name: _loaded_query(pick) for name, pick in LOADED.items()
    }
