"""A model as one row per series: maps from factor levels to ratios and coefficients.

Levels of a factor are few, so the maps stay small however long the series are, and scoring
needs one join on the series and look-ups inside the row in place of one join per factor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbline.operators.factors import FACTORS, Factor, VolumeFactor
from ebbline.operators.regression import INTERCEPT
from ebbline.settings import PLACEMENT, SERIES

# Fixed value: name of the volume coefficient.
VOLUME_TERM = "AmountTotalCampaignSent"
TREND_RATIO = "trend_ratio"


def _levels(factor: Factor) -> Column:
    """The levels of a row as one map key, each with its length so that none runs into the
    next; a missing level is a level of its own."""
    texts = [F.col(c).cast("string") for c in factor.levels]
    known = [F.concat(F.length(t).cast("string"), F.lit(":"), t) for t in texts]
    return F.concat_ws("|", *[F.coalesce(k, F.lit("missing")) for k in known])


def _maps(factor: Factor) -> dict[str, str | None]:
    """The map columns of a factor with the coefficient each of them holds."""
    if isinstance(factor, VolumeFactor):
        return {f"Intercept_{factor.name}": INTERCEPT, f"Slope_{factor.name}": VOLUME_TERM}
    return {factor.ratio: None}


def pack(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per series from the factor tables, which are read once and placed once."""
    entries = None
    for factor in FACTORS:
        volume = isinstance(factor, VolumeFactor)
        own = tables[factor.name].select(
            *SERIES,
            F.lit(factor.name).alias("factor"),
            (F.col("coefficient_name") if volume else F.lit(None).cast("string")).alias("term"),
            _levels(factor).alias("levels"),
            F.col("coefficient_value" if volume else TREND_RATIO).alias("value"),
        )
        entries = own if entries is None else entries.unionByName(own)
    maps = []
    for factor in FACTORS:
        for name, term in _maps(factor).items():
            own = (F.col("factor") == factor.name) & F.col("term").eqNullSafe(F.lit(term).cast("string"))
            maps.append(F.map_from_entries(F.collect_list(F.when(own, F.struct("levels", "value")))).alias(name))
    return entries.repartition(*PLACEMENT).groupBy(*SERIES).agg(*maps)


def look_up(factor: Factor) -> list[Column]:
    """What the packed row holds for the levels of the row; NULL for unseen ones."""
    return [F.try_element_at(F.col(name), _levels(factor)) for name in _maps(factor)]
