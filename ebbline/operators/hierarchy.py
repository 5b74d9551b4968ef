"""Names, display order and two-level grouping of decomposition parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Decomposition names in display order, with their groups.
PARTS = (
    ("Amount", "Actual Results", "Actual Results"),
    ("Predict_TrendLong", "Model Results", "Long Term Trend"),
    ("Predict_SeasonalMonth", "Model Results", "Seasonality"),
    ("Predict_SeasonalDOW", "Model Results", "Seasonality"),
    ("Predict_SeasonalSchoolHoliday", "Model Results", "Seasonality"),
    ("Predict_SeasonalInfluentialDate", "Model Results", "Seasonality"),
    ("Predict_EDMMajorAvg", "Model Results", "EDM Initial Impact"),
    ("Predict_EDMMajorMonth", "Model Results", "EDM Initial Impact"),
    ("Predict_EDMMajorDOW", "Model Results", "EDM Initial Impact"),
    ("Predict_EDMMajorMonthRgr", "Model Results", "EDM Initial Impact"),
    ("Predict_EDMMajorDOWRgr", "Model Results", "EDM Initial Impact"),
    ("Predict_EDMMajorLaggedAvg", "Model Results", "EDM Lagged Impact"),
    ("Predict_EDMMajorLaggedDays", "Model Results", "EDM Lagged Impact"),
    ("Predict_EDMMajorLaggedDaysDOW", "Model Results", "EDM Lagged Impact"),
    ("Residual", "Residual", "Residual"),
)
OTHER = "Other"

NAMES = [name for name, _, _ in PARTS]
MODEL_PARTS = [name for name, l1, _ in PARTS if l1 == "Model Results"]


def _lookup(name: Column, values: list, default) -> Column:
    chain = F.when(F.lit(False), F.lit(default))
    for part, value in zip(NAMES, values):
        chain = chain.when(name == part, F.lit(value))
    return chain.otherwise(F.lit(default))


def with_hierarchy(df: DataFrame, column: str = "decomposition_name") -> DataFrame:
    """Add both group levels and the display rank of a decomposition name."""
    name = F.col(column)
    return df.withColumns(
        {
            "decomposition_l1": _lookup(name, [l1 for _, l1, _ in PARTS], OTHER),
            "decomposition_l2": _lookup(name, [l2 for _, _, l2 in PARTS], OTHER),
            "step_rank": _lookup(name, list(range(len(PARTS))), len(PARTS)),
        }
    )


def decompose_long(scored: DataFrame) -> DataFrame:
    """One row per scored row and part, in the vocabulary of :data:`PARTS`."""
    ids = [c for c in scored.columns if c not in NAMES]
    return with_hierarchy(scored.unpivot(ids, NAMES, "decomposition_name", "amount"))
