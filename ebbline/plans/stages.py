"""The stages every report table starts from: trended, fitted and scored rows."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbline.operators import clean, factors, lines, packed, score, split, trend
from ebbline.operators.factors import FACTORS
from ebbline.operators.score import Model
from ebbline.settings import ORDERS, PLACEMENT, SERIES, Settings
from ebbline.sources import orders
from ebbline.sources.tables import Inputs, StageStore, fingerprint, store_for

TRAIN, TEST = "Train", "Test"
# Buckets can be left unread when they hang on one column only.
SERIES_CODE = "series_code"


def series_code(product: Column, stay: Column, measure: Column) -> Column:
    return F.concat_ws("/", *[k.cast("string") for k in (product, stay, measure)])


def cleaned(fact: DataFrame, settings: Settings) -> DataFrame:
    """Regime, window width and clean amount of every row of the fact."""
    tagged = clean.tag_regime(fact, settings)
    return clean.clean_amounts(clean.growing_width(tagged, settings), settings)


def trended(fact: DataFrame, settings: Settings, placed: bool = False) -> DataFrame:
    """Trend, residual and price change of the dates in scope.

    The fact is placed by product and stay once; ``placed`` says it already is.
    Widths count from the start of the whole fact, the trend sees the dates in
    scope only.
    """
    rows = fact if placed else fact.repartition(*PLACEMENT)
    in_scope = cleaned(rows, settings).filter(
        F.col("date").between(F.lit(settings.date_from), F.lit(settings.date_to))
    )
    narrow = in_scope.select("date", *SERIES, "regime_no", "width", "amount")
    return trend.price_change(trend.detrend(trend.centred_trend(narrow)), settings)


def with_day_attributes(
    df: DataFrame, calendar: DataFrame, campaigns: DataFrame, settings: Settings
) -> DataFrame:
    """Attach factor levels and campaign volume of the day.

    Both tables hold one row per day; their stored size lets Spark broadcast them.
    """
    days = calendar.join(score.campaign_days(campaigns), "date", "left")
    return df.join(days, "date", "left").withColumn(
        "campaign_era", F.col("date") >= F.lit(settings.edm_from)
    )


class Decomposition:
    """A decomposition of one set of inputs, with its stages stored once."""

    def __init__(
        self, inputs: Inputs, settings: Settings, store: StageStore, label: str, placed: bool = False
    ) -> None:
        self.inputs = inputs
        self.settings = settings
        self.store = store
        frames = (inputs.daily_fact, inputs.calendar, inputs.campaigns, inputs.dim_stay)
        # the label is for readers; what a stage holds follows from inputs and settings alone
        self.label = f"{label}_{fingerprint(settings, placed, *frames)}"
        self.placed = placed
        self.dim_stay = inputs.dim_stay

    @property
    def calendar(self) -> DataFrame:
        return self.store.stage(f"{self.label}/calendar", lambda: self.inputs.calendar)

    @property
    def campaigns(self) -> DataFrame:
        return self.store.stage(f"{self.label}/campaigns", lambda: self.inputs.campaigns)

    @property
    def main(self) -> DataFrame:
        """Trended rows with day attributes, before the split."""

        def build() -> DataFrame:
            rows = trended(self.inputs.daily_fact, self.settings, self.placed)
            rows = split.with_row_hash(rows)
            return with_day_attributes(rows, self.calendar, self.campaigns, self.settings)

        return self.store.stage(f"{self.label}/main", build, placed=True)

    @property
    def divided(self) -> DataFrame:
        """Main rows with their stratum and test flag."""
        return self.store.stage(
            f"{self.label}/divided", lambda: split.split(self.main, self.settings.test_share), placed=True
        )

    @property
    def fitted(self) -> DataFrame:
        """Main rows with the ratio of every factor, fitted on training rows."""

        def build() -> DataFrame:
            return factors.fit_chain(self.divided.drop("regime_no", "width"))

        return self.store.stage(f"{self.label}/fitted", build, placed=True)

    @property
    def parts(self) -> DataFrame:
        return factors.with_parts(self.fitted)

    @property
    def campaign_training(self) -> DataFrame:
        """Training rows of the campaign era with all parts and residuals."""
        return self.parts.filter(~F.col("is_test") & F.col("campaign_era"))

    @property
    def model(self) -> Model:
        """The factor tables, each stored and read back with its true size."""
        # both stages exist before the tables, which are small, are written side by side
        _ = self.fitted, self.campaigns
        names = [f.name for f in FACTORS]
        with ThreadPoolExecutor(4) as pool:
            tables = dict(zip(names, pool.map(self.model_table, names)))
        return Model(
            tables, self.store.stage(f"{self.label}/model/packed", lambda: packed.pack(tables), placed=True)
        )

    def _model_rows(self, name: str) -> DataFrame:
        """A factor table with the code of its series, bucketed by it."""

        def build() -> DataFrame:
            table = score.model_table(self.fitted, self.campaigns, name)
            return table.withColumn(SERIES_CODE, series_code(*[F.col(k) for k in SERIES]))

        return self.store.stage(f"{self.label}/model/{name}", build, buckets=[SERIES_CODE])

    def model_table(self, name: str) -> DataFrame:
        return self._model_rows(name).drop(SERIES_CODE)

    def model_sample(self, name: str, product: int, stay: int, measure: int) -> DataFrame:
        """The rows of one series, read from the one bucket that holds it."""
        code = series_code(*[F.lit(k) for k in (product, stay, measure)])
        rows = self._model_rows(name).filter(F.col(SERIES_CODE) == code)
        return rows.drop(SERIES_CODE)

    @property
    def month_sums(self) -> DataFrame:
        """Mergeable sums of straight lines through the training amounts, per series and month."""

        def build() -> DataFrame:
            training = self.divided.filter(~F.col("is_test"))
            return lines.month_sums(training, SERIES, "amount")

        return self.store.stage(f"{self.label}/month_sums", build, placed=True)

    @property
    def scored(self) -> DataFrame:
        """Train and test rows scored with the stored model, flagged by ``data``."""
        flagged = self.fitted.withColumn("data", data_label())
        return score.score(flagged, self.campaigns, self.model, self.settings)

    @property
    def scored_in_place(self) -> DataFrame:
        """The same rows from the ratios already attached by the fit, without joins."""
        rows = score.since_first_campaign(self.parts, self.campaigns).filter(
            F.col("amount_type") == self.settings.volume_measure
        )
        return score.with_residual(
            rows.withColumn("data", data_label()), ["data", "date", *SERIES]
        )


def data_label():
    return F.when(F.col("is_test"), TEST).otherwise(TRAIN)


def from_orders(
    spark: SparkSession, folder: str, product_split: int = 1, volume: str = orders.LINES
) -> Decomposition:
    """The decomposition of the order tables in ``folder``.

    The lines are read once per application: the sums per day are the first stored stage, and
    span, calendar, campaigns and fact start from it.
    """
    store = store_for(spark)
    raw = orders.sums_of(spark, folder, product_split)
    place = f"{folder.strip('/').replace('/', '_')}_{product_split}"
    sums = store.stage(f"{place}/sums_{fingerprint(raw)}", lambda: raw, placed=True)
    inputs = orders.inputs(spark, folder, product_split, volume, sums)
    return Decomposition(inputs, ORDERS, store, f"{place}_{volume}", placed=True)
