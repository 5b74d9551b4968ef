"""Stored models and scoring of new data with them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbline.functions.measures import ratio
from ebbline.operators.factors import (
    BY_NAME,
    RATIO_FACTORS,
    VOLUME_FACTORS,
    Factor,
    VolumeFactor,
    on_campaign,
    residual_before,
    with_parts,
)
from ebbline.operators.hierarchy import MODEL_PARTS
from ebbline.operators.packed import TREND_RATIO, VOLUME_TERM, look_up
from ebbline.operators.regression import ols_by_group
from ebbline.settings import SERIES, Settings
from ebbline.sources import artefacts

# The name of the packed model among the tables of a saved one.
PACKED = "packed"


@dataclass(frozen=True)
class Model:
    """One table per factor, keyed by series and factor levels, and the same packed by series."""

    tables: dict[str, DataFrame]
    packed: DataFrame

    def save(self, folder: str, settings: Settings | None = None) -> None:
        """Write all tables, then the manifest that makes them a model."""
        artefacts.save(folder, self.tables | {PACKED: self.packed}, repr(settings))

    @staticmethod
    def load(spark: SparkSession, folder: str, settings: Settings | None = None) -> "Model":
        """Read a saved model; ValueError for half-written, changed or foreign ones, and for a
        model of other ``settings`` where they are given."""
        tables = artefacts.load(spark, folder, [*BY_NAME, PACKED], settings and repr(settings))
        packed = tables.pop(PACKED)
        return Model(tables, packed)


def ratio_table(fitted: DataFrame, factor: Factor) -> DataFrame:
    return (
        fitted.filter(factor.rows())
        .groupBy(*SERIES, *factor.levels)
        .agg(F.max(factor.ratio).alias(TREND_RATIO))
    )


def volume_points(parts: DataFrame, campaigns: DataFrame, name: str) -> DataFrame:
    """Campaign volume against relative residual, one row per campaign and series."""
    factor = BY_NAME[name]

    def relative(column: str) -> Column:
        return F.coalesce(ratio(F.col(column), F.col("trend")), F.lit(0.0))

    rows = parts.filter(factor.rows()).select(
        "date",
        *SERIES,
        *factor.levels,
        relative(residual_before(factor)).alias("ratio_before"),
        relative(factor.residual).alias("ratio_after"),
    )
    sent = campaigns.filter(F.col("amount_sent").isNotNull())
    return rows.join(sent.select("date", "amount_sent"), "date")


def coefficient_table(fitted: DataFrame, campaigns: DataFrame, factor: VolumeFactor) -> DataFrame:
    points = volume_points(with_parts(fitted, factor.name), campaigns, factor.name)
    return ols_by_group(
        points.withColumnRenamed("amount_sent", VOLUME_TERM),
        [*SERIES, *factor.levels],
        "ratio_before",
        VOLUME_TERM,
    )


def model_table(fitted: DataFrame, campaigns: DataFrame, name: str) -> DataFrame:
    factor = BY_NAME[name]
    if isinstance(factor, VolumeFactor):
        return coefficient_table(fitted, campaigns, factor)
    return ratio_table(fitted, factor)


def campaign_days(campaigns: DataFrame) -> DataFrame:
    """The campaign volumes of a day as one struct; one row per day."""
    sent = F.col("amount_sent")
    return (
        campaigns.filter(sent.isNotNull())
        .groupBy("date")
        .agg(
            F.struct(
                F.count(sent).alias("n"),
                F.avg(sent).alias("mean"),
                (F.var_pop(sent) * F.count(sent)).alias("ss"),
                F.min(sent).alias("min"),
                F.max(sent).alias("max"),
            ).alias("sent")
        )
    )


def since_first_campaign(df: DataFrame, campaigns: DataFrame) -> DataFrame:
    return df.filter(F.col("date") >= campaigns.select(F.min("date")).scalar())


def score(df: DataFrame, campaigns: DataFrame, model: Model, settings: Settings) -> DataFrame:
    """Apply stored factors to trended rows of the volume measure.

    Rows before the first campaign are left out. Levels the model has not seen
    contribute nothing. The one join on the series carries no hint: the packed model has a
    known size, so Spark broadcasts a small one and joins a large one on the series.
    """
    carried = [c for c in ("data", "date", *SERIES) if c in df.columns]
    rows = since_first_campaign(df, campaigns).filter(
        F.col("amount_type") == settings.volume_measure
    )
    if "sent" not in rows.columns:
        rows = rows.join(campaign_days(campaigns), "date", "left")
    parts: dict[str, Column] = {"Predict_TrendLong": F.col("trend")}
    for factor in RATIO_FACTORS:
        (share,) = look_up(factor)
        parts[factor.predict] = F.coalesce(share * F.col("trend"), F.lit(0.0))
    for factor in VOLUME_FACTORS:
        intercept, slope = look_up(factor)
        per_day = F.col("sent.n") * (intercept + slope * F.col("sent.mean"))
        share = F.coalesce(F.when(on_campaign(), per_day), F.lit(0.0))
        parts[factor.predict] = share * F.col("trend")
    rows = rows.drop(*[c for c in model.packed.columns if c not in SERIES])
    joined = rows.join(model.packed, SERIES, "left")
    return with_residual(
        joined.select(*carried, "amount", *[c.alias(name) for name, c in parts.items()]), carried
    )


def with_residual(df: DataFrame, carried: list[str]) -> DataFrame:
    """Keep ids, amount and parts; add what the parts leave of the amount."""
    explained = sum((F.col(p) for p in MODEL_PARTS[1:]), F.col(MODEL_PARTS[0]))
    return df.select(
        *carried,
        F.col("amount").alias("Amount"),
        *MODEL_PARTS,
        (F.col("amount") - explained).alias("Residual"),
    )
