"""A stored model applied to a new raw fact, and the whole bundle of results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbline.operators import hierarchy, score
from ebbline.operators.score import Model
from ebbline.plans import accuracy as acc
from ebbline.plans.stages import Decomposition
from ebbline.settings import Settings
from ebbline.sources.tables import Inputs, StageStore, fingerprint


@dataclass(frozen=True)
class Results:
    """What scoring gives: scored rows wide and long, daily series, accuracy and error steps at
    the grain of series, product and measure."""

    scored: DataFrame
    long: DataFrame
    series: DataFrame
    accuracy_full: DataFrame
    accuracy_product: DataFrame
    accuracy_high: DataFrame
    steps_full: DataFrame
    steps_product: DataFrame
    steps_high: DataFrame


def results_of(scored: DataFrame, dim_stay: DataFrame) -> Results:
    return Results(
        scored=scored,
        long=hierarchy.decompose_long(scored),
        series=acc.daily_series(scored, acc.PRODUCT),
        accuracy_full=acc.accuracy_by_stay_name(scored, dim_stay),
        accuracy_product=acc.accuracy(scored, acc.PRODUCT),
        accuracy_high=acc.accuracy(scored, acc.HIGH),
        steps_full=acc.error_steps_by_stay_name(scored, dim_stay),
        steps_product=acc.error_steps(scored, acc.PRODUCT),
        steps_high=acc.error_steps(scored, acc.HIGH),
    )


def apply_model(
    inputs: Inputs,
    model: Model,
    settings: Settings,
    store: StageStore,
    label: str,
    data: str = "New",
    placed: bool = False,
) -> Results:
    """Clean and detrend a raw fact, score it with a model fitted elsewhere, and report on it.

    Series, levels and days the model has not seen contribute nothing. ``data`` names the rows
    in the reports. The scored rows are stored once, as every report reads them.
    """
    frame = Decomposition(inputs, settings, store, label, placed)

    def build() -> DataFrame:
        rows = frame.main.withColumn("data", F.lit(data))
        return score.score(rows, frame.campaigns, model, settings)

    name = f"{frame.label}/scored_{fingerprint(data, model.packed)}"
    return results_of(store.stage(name, build, placed=True), frame.dim_stay)
