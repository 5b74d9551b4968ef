"""Accuracy and error steps of scored rows at three grains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbline.functions.measures import ratio, rmse
from ebbline.operators.hierarchy import MODEL_PARTS, NAMES
from ebbline.plans.stages import TEST, TRAIN

FULL = ["product_key", "stay_key", "amount_type"]
PRODUCT = ["product_key", "amount_type"]
HIGH = ["amount_type"]

ACCURACY = ["RMSE", "ActualMean", "RMSEPerc", "MAEPerc", "MBEPerc", "MAE", "MBE", "Total"]


def check_stay_names(dim_stay: DataFrame) -> DataFrame:
    """Fail when two stays share a name, as tables by name would mix them."""
    names = Window.partitionBy("stay_name")
    clash = F.count(F.lit(1)).over(names) > 1
    return dim_stay.withColumn(
        "stay_name",
        F.when(clash, F.raise_error(F.lit("stay names are not unique"))).otherwise(
            F.col("stay_name")
        ),
    )


def with_stay_name(df: DataFrame, dim_stay: DataFrame) -> DataFrame:
    return df.join(check_stay_names(dim_stay.select("stay_key", "stay_name")), "stay_key", "left")


def _day_totals(scored: DataFrame) -> list[Column]:
    model = sum((F.col(p) for p in MODEL_PARTS[1:]), F.col(MODEL_PARTS[0]))
    return [
        F.sum("Amount").alias("actual"),
        F.sum(model).alias("model"),
        F.sum("Residual").alias("residual"),
    ]


def _accuracy_columns() -> list[Column]:
    """Root mean square over all days; the relative errors over days with sales."""
    actual, model, residual = F.col("actual"), F.col("model"), F.col("residual")
    relative = ratio(residual, actual)
    usable = relative.isNotNull()
    error = rmse(actual, model)
    return [
        error.alias("RMSE"),
        F.avg(actual).alias("ActualMean"),
        ratio(error, F.avg(actual)).alias("RMSEPerc"),
        F.avg(F.abs(relative)).alias("MAEPerc"),
        F.avg(relative).alias("MBEPerc"),
        F.avg(F.when(usable, F.abs(residual))).alias("MAE"),
        F.avg(F.when(usable, residual)).alias("MBE"),
        F.sum(F.when(usable, actual)).alias("Total"),
    ]


def accuracy(scored: DataFrame, grain: list[str]) -> DataFrame:
    """Accuracy per grain and data set, from daily sums at that grain."""
    keys = ["data", *grain]
    daily = scored.groupBy("date", *keys).agg(*_day_totals(scored))
    return daily.groupBy(*keys).agg(*_accuracy_columns())


def accuracy_by_stay_name(scored: DataFrame, dim_stay: DataFrame) -> DataFrame:
    named = with_stay_name(accuracy(scored, FULL), dim_stay)
    return named.select("data", "product_key", "stay_name", "amount_type", *ACCURACY)


def accuracy_all_grains(scored: DataFrame) -> DataFrame:
    """All three grains; ``grain`` names the level of a row.

    The rows are summed once per day and series. Days of a product are sums of these sums, and
    days of a measure sums of those, so no row is multiplied and each level is smaller than the
    one below.
    """
    keys = ["data", "date"]
    sums = [F.sum(c).alias(c) for c in ("actual", "model", "residual")]
    full = scored.groupBy(*keys, *FULL).agg(*_day_totals(scored))
    product = full.groupBy(*keys, *PRODUCT).agg(*sums)
    high = product.groupBy(*keys, *HIGH).agg(*sums)
    levels = []
    for name, daily, grain in (("full", full, FULL), ("product", product, PRODUCT), ("high", high, HIGH)):
        level = daily.groupBy("data", *grain).agg(*_accuracy_columns())
        absent = [F.lit(None).cast("int").alias(k) for k in FULL if k not in grain]
        levels.append(level.select("data", *grain, *absent, *ACCURACY, F.lit(name).alias("grain")))
    whole = levels[0]
    for level in levels[1:]:
        whole = whole.unionByName(level)
    return whole


def accuracy_of_product(
    scored: DataFrame, dim_stay: DataFrame, product: int, without: tuple[str, ...] = ()
) -> DataFrame:
    """The per-stay report of one product's training rows, without some stays."""
    rows = accuracy_rounded(scored.filter(F.col("product_key") == product), dim_stay)
    kept = rows.filter(F.col("stay_name").isNull() | ~F.col("stay_name").isin(*without)) if without else rows
    return kept.drop("product_key")


def accuracy_rounded(scored: DataFrame, dim_stay: DataFrame) -> DataFrame:
    """The per-stay report of the training rows, to two places."""
    names = ["MAE", "MBE", "RMSE", "MAEPerc", "MBEPerc", "RMSEPerc"]
    full = accuracy_by_stay_name(scored.filter(F.col("data") == TRAIN), dim_stay)
    return full.select(
        "product_key", "stay_name", *[F.round(n, 2).alias(n) for n in names]
    )


def overall_accuracy(scored: DataFrame) -> DataFrame:
    """Test and training accuracy side by side."""
    columns = ["MAE", "MBE", "RMSE", "MAEPerc", "MBEPerc", "RMSEPerc"]
    return accuracy(scored, HIGH).select("data", *columns)


def error_steps(scored: DataFrame, grain: list[str]) -> DataFrame:
    """RMSE after each further part, and its change over the part before.

    The parts stay columns: they are summed per day and grain, run up in display
    order inside the row, and only the final handful of errors per grain is turned
    into rows. No row is multiplied before the aggregation and no window is needed.
    """
    keys = ["data", *grain]
    daily = scored.groupBy("date", *keys).agg(
        F.sum("Amount").alias("actual"), *[F.sum(p).alias(p) for p in MODEL_PARTS]
    )
    running, upto = {}, F.lit(0.0)
    for part in MODEL_PARTS:
        upto = upto + F.col(part)
        running[part] = upto
    errors = daily.groupBy(*keys).agg(
        *[rmse(run, F.col("actual")).alias(part) for part, run in running.items()]
    )
    steps = [
        F.struct(
            F.lit(part).alias("decomposition_name"),
            F.lit(NAMES.index(part)).alias("step_rank"),
            F.col(part).alias("RMSE"),
            (ratio(F.col(part), F.col(MODEL_PARTS[i - 1])) - 1 if i else F.lit(None).cast("double"))
            .alias("RMSEChange"),
        )
        for i, part in enumerate(MODEL_PARTS)
    ]
    return errors.select(*keys, F.inline(F.array(*steps)))


def error_steps_by_stay_name(scored: DataFrame, dim_stay: DataFrame) -> DataFrame:
    named = with_stay_name(error_steps(scored, FULL), dim_stay)
    return named.drop("stay_key")


def error_step_percent(scored: DataFrame) -> DataFrame:
    """The high-level training steps with the change in whole percent."""
    steps = error_steps(scored.filter(F.col("data") == TRAIN), HIGH)
    return steps.select(
        "decomposition_name",
        "step_rank",
        "RMSE",
        (F.lit(100) * F.round("RMSEChange", 2)).alias("change_percent"),
    )


def overall_steps(scored: DataFrame) -> DataFrame:
    """Training and test RMSE per part of the volume measure, side by side."""
    side = lambda name: F.max(F.when(F.col("data") == name, F.col("RMSE"))).alias(f"RMSE_{name}")
    return (
        error_steps(scored, HIGH)
        .groupBy("decomposition_name", "step_rank")
        .agg(side(TRAIN), side(TEST), F.bool_or(F.col("data") == TRAIN).alias("trained"))
        .filter("trained")
        .drop("trained")
    )


def daily_series(scored: DataFrame, grain: list[str]) -> DataFrame:
    """Actual, model and residual per day and grain, one row each."""
    keys = ["data", "date", *grain]
    daily = scored.groupBy(*keys).agg(*_day_totals(scored))
    named = daily.select(
        *keys,
        F.col("actual").alias("Actual Results"),
        F.col("model").alias("Model Results"),
        F.col("residual").alias("Residual"),
    )
    return named.unpivot(
        keys, ["Actual Results", "Model Results", "Residual"], "decomposition_l1", "amount"
    )


def spread_levels(long: DataFrame, grain: list[str]) -> DataFrame:
    """Long decomposition rows back to one column per first-level group."""
    names = {"Actual Results": "actual", "Model Results": "model", "Residual": "residual"}
    wide = long.groupBy("data", "date", *grain).pivot("decomposition_l1", list(names)).sum("amount")
    return wide.withColumnsRenamed(names)
