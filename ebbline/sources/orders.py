"""Decomposition inputs derived from the order tables.

Line items become daily amounts per product (return flag) and stay (line status):
measure 103 counts the lines of a day, measure 100 is their mean price. Campaign
days carry the number of orders placed that day as their volume.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ebbline.settings import PLACEMENT
from ebbline.sources import schema
from ebbline.sources.tables import Inputs

# Fixed values of the order tables.
PRODUCT_OF_FLAG = {"A": 1, "N": 2, "R": 3}
STAY_OF_STATUS = {"F": 1, "O": 2}
# What a day's volume counts: its lines, or the units on them.
LINES, UNITS = "lines", "units"
STAYS = "VALUES (1, 'short', 1), (2, 'long', 2) AS t(stay_key, stay_name, stay_rank)"


def _code(column: str, codes: dict[str, int]) -> Column:
    chain = F.when(F.lit(False), F.lit(None).cast("int"))
    for value, code in codes.items():
        chain = chain.when(F.col(column) == value, F.lit(code))
    return chain


def day_sums(lineitem: DataFrame, product_split: int = 1) -> DataFrame:
    """Lines, units and revenue per day, product and stay: the one pass over the raw lines.

    Lines are summed before anything is placed by series, so a product holding a large share of
    the lines costs one row per day and stay. ``product_split`` widens the product key by
    supplier.
    """
    product = _code("l_returnflag", PRODUCT_OF_FLAG)
    if product_split > 1:
        product = product + F.lit(len(PRODUCT_OF_FLAG)) * (
            F.col("l_suppkey") % product_split
        ).cast("int")
    units = F.col("l_quantity") if "l_quantity" in lineitem.columns else F.lit(1.0)
    return (
        lineitem.select(
            F.to_date("l_shipdate").alias("date"),
            product.alias("product_key"),
            _code("l_linestatus", STAY_OF_STATUS).alias("stay_key"),
            F.col("l_extendedprice").cast("decimal(12,2)").alias("price"),
            units.alias("units"),
        )
        .groupBy("date", *PLACEMENT)
        .agg(
            F.count(F.lit(1)).cast("double").alias("lines"),
            F.sum("units").cast("double").alias("units"),
            F.sum("price").cast("double").alias("revenue"),
        )
    )


def ship_days(sums: DataFrame) -> tuple[Column, Column]:
    """First and last day as scalar subqueries."""
    return sums.select(F.min("date")).scalar(), sums.select(F.max("date")).scalar()


def fact_of(sums: DataFrame, volume: str = LINES, placed: bool = False) -> DataFrame:
    """One row per day, product, stay and measure, with every day of the span.

    Gaps are filled inside a series by stretching each day up to the next one, without a
    join to a list of days. ``placed`` says that the sums already lie by product and stay. With
    ``volume`` units, the amounts are units sold and the mean price of one.
    """
    first_day, last_day = ship_days(sums)
    by_day = Window.partitionBy(*PLACEMENT).orderBy("date")
    start = F.when(F.lag("date").over(by_day).isNull(), first_day).otherwise(F.col("date"))
    stop = F.coalesce(F.date_sub(F.lead("date").over(by_day), 1), last_day)
    here = sums.select("date", *PLACEMENT, F.col(volume).alias("sold"), "revenue")
    stretched = (
        (here if placed else here.repartition(*PLACEMENT))
        .withColumns({"start": start, "stop": stop})
        .withColumn("day", F.explode(F.sequence("start", "stop")))
    )
    today = F.col("day") == F.col("date")
    measures = F.array(
        F.struct(
            F.lit(100).alias("amount_type"),
            F.when(today, F.try_divide("revenue", "sold")).alias("raw_amount"),
        ),
        F.struct(
            F.lit(103).alias("amount_type"),
            F.when(today, F.col("sold")).alias("raw_amount"),
        ),
    )
    return stretched.select(
        F.col("day").alias("date"), *PLACEMENT, F.inline(measures)
    ).select(*schema.FACT.fieldNames())


def daily_fact(lineitem: DataFrame, product_split: int = 1, volume: str = LINES) -> DataFrame:
    """The fact straight from the lines, without a stored stage between."""
    return fact_of(day_sums(lineitem, product_split), volume)


def spine(sums: DataFrame) -> DataFrame:
    days = sums.select(F.min("date").alias("a"), F.max("date").alias("b"))
    return days.select(F.explode(F.sequence("a", "b")).alias("date"))


def campaigns(sums: DataFrame, orders: DataFrame) -> DataFrame:
    """Campaign days with their type and, where orders exist, their volume."""
    placed = orders.groupBy(F.to_date("o_orderdate").alias("date")).agg(
        F.count(F.lit(1)).alias("orders")
    )
    return (
        spine(sums)
        .filter(F.dayofyear("date") % 11 == 3)
        .join(placed, "date", "left")
        .select(
            "date",
            (F.lit(1) + F.month("date") % 2).alias("edm_type"),
            (F.lit(1000.0) * F.col("orders")).alias("amount_sent"),
        )
    )


def calendar(sums: DataFrame) -> DataFrame:
    """Factor levels of every day, one row per day of the span."""
    day = F.col("date")
    in_holiday = (F.dayofmonth(day) <= 14) & F.month(day).isin(1, 4, 7, 10)
    holiday = F.concat(F.lit("Q"), F.quarter(day).cast("string"), F.lit(" holiday"))
    month_day = F.date_format(day, "MM-dd")
    influential = (
        F.when((month_day >= "12-24") | (month_day <= "01-02"), "Christmas")
        .when(month_day == "01-26", "Jan 26")
        .when(month_day == "04-25", "Apr 25")
        .otherwise("None")
    )
    sent = F.dayofyear(day) % 11 == 3
    kind = F.lit(1) + F.month(day) % 2
    # A calendar has one row per day, so this one ordered window stays small
    # however many sales the days hold.
    until_today = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    last_sent = F.last(F.when(sent, day), ignorenulls=True).over(until_today)
    since = F.datediff(day, F.col("last_sent"))
    return (
        spine(sums)
        .select(
            "date",
            F.month(day).alias("month_no"),
            F.dayofweek(day).alias("day_no_week"),
            F.when(in_holiday, holiday).otherwise("None").alias("school_holiday"),
            influential.alias("influential_date"),
            F.when(sent, kind).otherwise(0).alias("edm_type"),
            sent.cast("int").alias("edm_flag"),
            F.last(F.when(sent, kind), ignorenulls=True).over(until_today).alias("prior_edm_type"),
            last_sent.alias("last_sent"),
        )
        .withColumn("edm_lagged_flag", F.coalesce(since.between(1, 3), F.lit(False)))
        .withColumn("days_from_edm_start", since)
        .drop("last_sent")
    )


def dim_stay(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM {STAYS}")


def sums_of(spark: SparkSession, folder: str, product_split: int = 1) -> DataFrame:
    return day_sums(spark.read.parquet(f"{folder}/lineitem.parquet"), product_split)


def inputs(
    spark: SparkSession,
    folder: str,
    product_split: int = 1,
    volume: str = LINES,
    sums: DataFrame | None = None,
) -> Inputs:
    """The inputs over the order tables; ``sums`` are the day sums where they are stored."""
    placed = sums is not None
    sums = sums if placed else sums_of(spark, folder, product_split)
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    return Inputs(
        daily_fact=fact_of(sums, volume, placed),
        calendar=calendar(sums),
        campaigns=campaigns(sums, orders),
        dim_stay=dim_stay(spark),
    )


def priority_stays(orders: DataFrame) -> DataFrame:
    """A stay dimension of the order priorities that occur, ranked by name."""
    names = orders.select(F.col("o_orderpriority").alias("stay_name")).filter("stay_name is not null").distinct()
    rank = F.row_number().over(Window.orderBy("stay_name"))
    return names.select(rank.alias("stay_key"), "stay_name", rank.alias("stay_rank"))
