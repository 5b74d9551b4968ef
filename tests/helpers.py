from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from ebbline.settings import Regime, Settings
from ebbline.sources import schema

DAY0 = date(2020, 1, 1)


def settings(cap=364, regimes=(Regime("all", None),), edm_from=DAY0, share=0.2) -> Settings:
    return Settings(regimes, DAY0, date(2030, 1, 1), edm_from, cap, share)


def fact(spark, amounts, amount_type=103, product=1, stay=1, offsets=None):
    """A fact of one series, one row per day unless day offsets are given."""
    offsets = offsets or range(len(amounts))
    rows = [
        (DAY0 + timedelta(days=d), product, stay, amount_type, None if a is None else float(a))
        for d, a in zip(offsets, amounts)
    ]
    return spark.createDataFrame(rows, schema.FACT)


def column(df, name):
    return [r[name] for r in df.orderBy("date").select(name).collect()]


def trended_rows(spark, rows):
    """Rows for the factor chain from (day, residual, trend, extras) dicts."""
    full = []
    for i, row in enumerate(rows):
        base = {
            "date": DAY0 + timedelta(days=row.pop("day", i)),
            "product_key": 1,
            "stay_key": 1,
            "amount_type": 103,
            "trend": 10.0,
            "is_test": False,
            "month_no": 1,
            "day_no_week": 1,
            "school_holiday": "None",
            "influential_date": "None",
            "edm_type": 0,
            "edm_flag": 0,
            "prior_edm_type": None,
            "edm_lagged_flag": False,
            "days_from_edm_start": None,
            "sent": None,
            "campaign_era": True,
        }
        base.update(row)
        base["residual_trend"] = float(base["residual_trend"])
        full.append(base)
    df = spark.createDataFrame(
        [tuple(r.values()) for r in full],
        "date date, product_key int, stay_key int, amount_type int, trend double, is_test boolean, "
        "month_no int, day_no_week int, school_holiday string, influential_date string, "
        "edm_type int, edm_flag int, prior_edm_type int, edm_lagged_flag boolean, "
        "days_from_edm_start int, "
        "sent struct<n: long, mean: double, ss: double, min: double, max: double>, "
        "campaign_era boolean, residual_trend double",
    )
    return df.withColumn("amount", F.col("trend") + F.col("residual_trend"))
