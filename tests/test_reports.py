from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from ebbline.functions.measures import clip_unit, strict_mean, week_of_year
from ebbline.operators.hierarchy import MODEL_PARTS, NAMES
from ebbline.plans import accuracy as acc
from ebbline.plans import studies


def scored(spark, rows):
    """Scored rows of one series from (day, amount, trend part, month part)."""
    df = spark.createDataFrame(
        [("Train", date(2020, 1, d), 1, s, 103, float(a), float(t), float(m)) for d, s, a, t, m in rows],
        "data string, date date, product_key int, stay_key int, amount_type int, Amount double, "
        "Predict_TrendLong double, Predict_SeasonalMonth double",
    )
    zero = {p: F.lit(0.0) for p in MODEL_PARTS[2:]}
    return df.withColumns(zero).withColumn(
        "Residual", F.expr("Amount - Predict_TrendLong - Predict_SeasonalMonth")
    )


def test_days_without_sales_count_for_the_root_mean_square_only(spark):
    df = scored(spark, [(1, 1, 10, 8, 0), (2, 1, 0, 3, 0), (3, 1, 4, 5, 0)])
    r = acc.accuracy(df, acc.FULL).first()
    assert r.RMSE == pytest.approx(((4 + 9 + 1) / 3) ** 0.5)
    assert r.ActualMean == pytest.approx(14 / 3)
    assert (r.MAE, r.MBE, r.Total) == pytest.approx((1.5, 0.5, 14))
    assert r.MAEPerc == pytest.approx((0.2 + 0.25) / 2)
    assert r.MBEPerc == pytest.approx((0.2 - 0.25) / 2)


def test_coarser_grains_sum_before_they_measure(spark):
    df = scored(spark, [(1, 1, 10, 8, 0), (1, 2, 10, 12, 0)])
    assert acc.accuracy(df, acc.FULL).agg(F.min("RMSE")).first()[0] == 2
    assert acc.accuracy(df, acc.PRODUCT).first().RMSE == 0


def test_all_grains_agree_with_each_grain(spark, orders):
    rows = {
        (r.grain, r.data, r.product_key, r.stay_key): r.RMSE
        for r in acc.accuracy_all_grains(orders.scored_in_place).collect()
    }
    for grain, keys in (("full", acc.FULL), ("product", acc.PRODUCT), ("high", acc.HIGH)):
        for r in acc.accuracy(orders.scored_in_place, keys).collect():
            d = r.asDict()
            assert rows[grain, r.data, d.get("product_key"), d.get("stay_key")] == pytest.approx(r.RMSE)
    assert {k[0] for k in rows} == {"full", "product", "high"}


def test_steps_run_up_in_display_order(spark):
    df = scored(spark, [(1, 1, 10, 6, 2), (2, 1, 10, 6, 4)])
    steps = {r.decomposition_name: r for r in acc.error_steps(df, acc.HIGH).collect()}
    assert steps["Predict_TrendLong"].RMSE == 4
    assert steps["Predict_TrendLong"].RMSEChange is None
    assert steps["Predict_SeasonalMonth"].RMSE == pytest.approx(2**0.5)
    assert steps["Predict_SeasonalMonth"].RMSEChange == pytest.approx(2**0.5 / 4 - 1)
    assert len(steps) == 13


def test_stays_with_one_name_are_refused(spark):
    dim = spark.sql("SELECT * FROM VALUES (1, 'x', 1), (2, 'x', 2) AS t(stay_key, stay_name, stay_rank)")
    df = scored(spark, [(1, 1, 10, 8, 0)])
    with pytest.raises(Exception, match="not unique"):
        acc.accuracy_by_stay_name(df, dim).collect()


def test_clip_and_strict_mean(spark):
    df = spark.createDataFrame([(0.4,), (-3.0,), (1.0,), (None,)], "x double")
    assert [r[0] for r in df.select(clip_unit(F.col("x"))).collect()] == [0.4, -1.0, 1.0, None]
    assert df.agg(strict_mean(F.col("x"))).first()[0] is None
    assert df.filter("x > 0").agg(strict_mean(F.col("x"))).first()[0] == pytest.approx(0.7)


def test_weeks_are_blocks_of_seven_days(spark):
    days = spark.createDataFrame([(date(2019, 1, 7),), (date(2019, 1, 8),), (date(2020, 12, 31),)], "d date")
    assert [r[0] for r in days.select(week_of_year(F.col("d"))).collect()] == [1, 2, 53]


def test_histogram_covers_every_row(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (0, 1, 2, 9, 10)] + [("b", 5.0)] * 3, "g string, v double")
    rows = {(r.g, r.bin_no): r.n_rows for r in studies.histogram(df, ["g"], "v", 5).collect()}
    assert rows == {("a", 1): 2, ("a", 2): 1, ("a", 5): 2, ("b", 1): 3}


def test_heat_rows_can_be_limited_to_years_and_stays(spark, orders):
    args = (orders.campaign_training, orders.dim_stay, orders.settings)
    heat = studies.residual_heat(*args, (1999, 1999), ("short",))
    got = heat.agg(F.min("date"), F.max("date"), F.max("stay_name"), F.max(F.abs("perc_var"))).first()
    assert got[0] >= date(1999, 1, 1) and got[1] <= date(1999, 12, 31)
    assert got[2] == "long" and got[3] <= 1
    assert heat.filter("start_of_week > date").count() == 0


def test_label_breaks_keep_every_other_name(spark):
    dim = spark.sql(
        "SELECT * FROM VALUES (1, 'a', 1), (2, 'b', 2), (3, 'c', 3), (4, 'd', 5) AS t(stay_key, stay_name, stay_rank)"
    )
    names = {r[0] for r in studies.stay_label_breaks(dim, ("c",)).collect()}
    assert names == {"a", "d"}


def test_points_multiply_rows_of_days_with_two_campaigns(spark, orders):
    twice = orders.campaigns.union(orders.campaigns)
    one = studies.volume_points(orders.parts, orders.campaigns, "EDMMajorMonthRgr").count()
    assert studies.volume_points(orders.parts, twice, "EDMMajorMonthRgr").count() == 2 * one > 0




def test_a_part_without_any_value_does_not_occur(spark, orders):
    held = orders.scored_in_place.withColumn("Predict_EDMMajorDOW", F.lit(None).cast("double"))
    names = {r.decomposition_name for r in studies.hierarchy_table(held).collect()}
    assert names == {*NAMES} - {"Predict_EDMMajorDOW"}
    assert {r.decomposition_name for r in studies.factor_listing(held).collect()} == {*MODEL_PARTS} - {"Predict_EDMMajorDOW"}
    assert studies.hierarchy_table(held.limit(0)).count() == 0


def test_every_other_of_many_stay_names(spark):
    dim = spark.createDataFrame([(i, f"s{i}", i) for i in range(1, 8)], "stay_key int, stay_name string, stay_rank int")
    assert {r[0] for r in studies.stay_label_breaks(dim).collect()} == {"s1", "s3", "s5", "s7"}
    assert {r[0] for r in studies.stay_label_breaks(dim, ("s3", "s4")).collect()} == {"s1", "s5", "s7"}
