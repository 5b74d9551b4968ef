"""Declared schemas of the input tables and a check against them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

FACT = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("product_key", T.IntegerType()),
        T.StructField("stay_key", T.IntegerType()),
        T.StructField("amount_type", T.IntegerType()),
        T.StructField("raw_amount", T.DoubleType()),
    ]
)

# One row per day; every factor level is an attribute of the day.
CALENDAR = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("month_no", T.IntegerType()),
        T.StructField("day_no_week", T.IntegerType()),
        T.StructField("school_holiday", T.StringType()),
        T.StructField("influential_date", T.StringType()),
        T.StructField("edm_type", T.IntegerType()),
        T.StructField("edm_flag", T.IntegerType()),
        T.StructField("prior_edm_type", T.IntegerType()),
        T.StructField("edm_lagged_flag", T.BooleanType()),
        T.StructField("days_from_edm_start", T.IntegerType()),
    ]
)

CAMPAIGNS = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("edm_type", T.IntegerType()),
        T.StructField("amount_sent", T.DoubleType()),
    ]
)

DIM_STAY = T.StructType(
    [
        T.StructField("stay_key", T.IntegerType()),
        T.StructField("stay_name", T.StringType()),
        T.StructField("stay_rank", T.IntegerType()),
    ]
)

TABLES = {"daily_fact": FACT, "calendar": CALENDAR, "campaigns": CAMPAIGNS, "dim_stay": DIM_STAY}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project to the declared columns; fail when one is absent or of another type."""
    found = {f.name: f.dataType for f in df.schema.fields}
    wrong = [
        f"{f.name}: want {f.dataType.simpleString()}, found "
        f"{found[f.name].simpleString() if f.name in found else 'nothing'}"
        for f in schema.fields
        if found.get(f.name) != f.dataType
    ]
    if wrong:
        raise ValueError("input does not match its schema: " + "; ".join(wrong))
    return df.select(*schema.fieldNames())
