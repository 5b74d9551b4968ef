from __future__ import annotations

from datetime import timedelta

import pytest
from tests.helpers import DAY0, settings, trended_rows
from pyspark.sql import functions as F

from ebbline.operators import factors, hierarchy, packed, score
from ebbline.operators.factors import BY_NAME, FACTORS, RATIO_FACTORS
from ebbline.operators.packed import VOLUME_TERM
from ebbline.settings import SERIES


def ratios(df, name):
    return [r[0] for r in df.orderBy("date").select(BY_NAME[name].ratio).collect()]


def test_month_ratio_is_the_mean_relative_residual(spark):
    df = factors.fit_chain(
        trended_rows(
            spark,
            [
                {"residual_trend": 2, "month_no": 1},
                {"residual_trend": 4, "month_no": 1},
                {"residual_trend": -5, "month_no": 2},
            ],
        )
    )
    assert ratios(df, "SeasonalMonth") == pytest.approx([0.3, 0.3, -0.5])


def test_zero_trend_spoils_its_group_only(spark):
    df = factors.fit_chain(
        trended_rows(
            spark,
            [
                {"residual_trend": 2, "month_no": 1},
                {"residual_trend": 0, "trend": 0.0, "month_no": 1},
                {"residual_trend": 5, "month_no": 2},
            ],
        )
    )
    assert ratios(df, "SeasonalMonth") == [0.0, 0.0, 0.5]


def test_missing_levels_form_their_own_group(spark):
    rows = [
        {"residual_trend": 2, "prior_edm_type": None, "month_no": 1},
        {"residual_trend": 4, "prior_edm_type": 1, "month_no": 1},
    ]
    fitted = factors.fit_chain(trended_rows(spark, rows))
    table = score.ratio_table(fitted, BY_NAME["EDMMajorLaggedAvg"]).collect()
    assert len(table) == 2
    assert {r.prior_edm_type for r in table} == {None, 1}
    assert fitted.count() == 2


def test_test_rows_get_the_training_ratio_and_do_not_shape_it(spark):
    rows = [
        {"residual_trend": 2, "month_no": 1},
        {"residual_trend": 9, "month_no": 1, "is_test": True},
        {"residual_trend": 9, "month_no": 7, "is_test": True},
    ]
    df = factors.fit_chain(trended_rows(spark, rows))
    assert ratios(df, "SeasonalMonth") == [pytest.approx(0.2), pytest.approx(0.2), None]
    parts = factors.with_parts(df).orderBy("date").collect()
    assert parts[2].Predict_SeasonalMonth == 0.0


def test_lagged_factors_touch_lagged_rows_only(spark):
    lagged = {"edm_lagged_flag": True, "prior_edm_type": 1}
    rows = [
        {"residual_trend": 1, "day_no_week": 1},
        {"residual_trend": 5, "days_from_edm_start": 1, "day_no_week": 2, **lagged},
        {"residual_trend": 7, "days_from_edm_start": 2, "day_no_week": 3, **lagged},
    ]
    df = factors.fit_chain(trended_rows(spark, rows))
    got = ratios(df, "EDMMajorLaggedDays")
    assert got[0] is None and got[1] is not None


def campaign(x, **more):
    return {"edm_flag": 1, "sent": (1, float(x), 0.0, float(x), float(x)), **more}


def fit_one(spark, rows):
    df = trended_rows(spark, rows).withColumn("left", F.col("residual_trend"))
    return factors.fit_volume(df, BY_NAME["EDMMajorMonthRgr"]).orderBy("date")


def test_volume_regression_recovers_a_line(spark):
    rows = [campaign(x, residual_trend=10 * (0.1 + 0.02 * x)) for x in (1, 2, 5)]
    df = fit_one(spark, rows + [{"residual_trend": 3}])
    got = [r[0] for r in df.select("Ratio_EDMMajorMonthRgr").collect()]
    assert got == [pytest.approx(0.12), pytest.approx(0.14), pytest.approx(0.2), None]


def coefficients(spark, points):
    rows = [
        campaign(x, residual_trend=y, day=i) for i, (x, y) in enumerate(points)
    ]
    fitted = factors.fit_chain(trended_rows(spark, rows))
    # the ratio factors leave nothing to regress, so blank them out
    blank = fitted.withColumns({f.ratio: F.lit(0.0) for f in RATIO_FACTORS})
    sent = spark.createDataFrame(
        [(DAY0 + timedelta(days=i), float(x)) for i, (x, _) in enumerate(points)],
        "date date, amount_sent double",
    )
    table = score.coefficient_table(blank, sent, BY_NAME["EDMMajorMonthRgr"])
    return {r.coefficient_name: r for r in table.collect()}


def test_flat_volume_explains_nothing(spark):
    points = [(3, 1), (3, 2), (3, 6)]
    df = fit_one(spark, [campaign(x, residual_trend=y) for x, y in points])
    assert [r[0] for r in df.select("Ratio_EDMMajorMonthRgr").collect()] == [None] * 3
    table = coefficients(spark, points)
    assert table["AmountTotalCampaignSent"].coefficient_value is None
    assert table["Intercept"].coefficient_value == pytest.approx(0.3)


def test_two_points_fit_exactly_without_error(spark):
    for r in coefficients(spark, [(1, 1), (3, 5)]).values():
        assert r.coefficient_value is not None
        assert r.std_error is None and r.p_value is None


def test_two_campaigns_on_a_day_weigh_twice_and_add_up(spark):
    sent = spark.createDataFrame(
        [(DAY0, 1.0), (DAY0, 5.0), (DAY0 + timedelta(days=1), 4.0), (DAY0 + timedelta(days=2), 2.0)],
        "date date, amount_sent double",
    )
    days = {r.date: r.sent for r in score.campaign_days(sent).collect()}
    y = [3.0, 1.0, 2.0]
    rows = [
        {"edm_flag": 1, "residual_trend": y[i], "sent": tuple(days[DAY0 + timedelta(days=i)])}
        for i in range(3)
    ]
    got = [r[0] for r in fit_one(spark, rows).select("Ratio_EDMMajorMonthRgr").collect()]
    xs, ys = [1.0, 5.0, 4.0, 2.0], [0.3, 0.3, 0.1, 0.2]
    mx, my = sum(xs) / 4, sum(ys) / 4
    slope = sum((a - mx) * (b - my) for a, b in zip(xs, ys)) / sum((a - mx) ** 2 for a in xs)
    line = lambda x: my + slope * (x - mx)
    assert got == pytest.approx([line(1) + line(5), line(4), line(2)])


def test_checks_vanish_after_each_factor(orders):
    from ebbline.plans.studies import factor_check

    zero_trend = orders.parts.filter("trend = 0").select(*SERIES).distinct()
    sound = orders.parts.join(F.broadcast(zero_trend), SERIES, "left_anti")
    assert sound.count() > 0
    for factor in RATIO_FACTORS:
        worst = factor_check(sound, factor.name).agg(F.max(F.abs("mean_after"))).first()[0]
        assert worst < 1e-9, factor.name


def test_parts_and_residual_add_up(orders):
    wide = orders.scored_in_place
    gap = F.abs(F.col("Amount") - sum((F.col(p) for p in hierarchy.MODEL_PARTS), F.col("Residual")))
    assert wide.agg(F.max(gap)).first()[0] < 1e-6


def test_stored_model_scores_like_the_fit(orders):
    ids = ["date", *SERIES]
    a = orders.scored.toPandas().sort_values(ids).reset_index(drop=True)
    b = orders.scored_in_place.toPandas().sort_values(ids).reset_index(drop=True)
    assert len(a) == len(b) > 10_000
    for name in hierarchy.NAMES:
        assert (a[name] - b[name]).abs().max() < 1e-6, name


def test_model_survives_saving(spark, orders, tmp_path):
    orders.model.save(str(tmp_path))
    loaded = score.Model.load(spark, str(tmp_path))
    assert set(loaded.tables) == {f.name for f in FACTORS}
    assert loaded.packed.schema == orders.model.packed.schema
    rows = orders.fitted.filter("product_key = 1")
    args = (orders.campaigns, loaded, orders.settings)
    assert score.score(rows, *args).count() == score.score(rows, orders.campaigns, orders.model, orders.settings).count()


def test_packed_maps_hold_every_row_of_the_tables(orders):
    packed_rows = {tuple(r[k] for k in SERIES): r for r in orders.model.packed.collect()}
    for factor in FACTORS:
        rows = orders.model.tables[factor.name].collect()
        assert rows
        seen = 0
        for r in rows:
            texts = ["missing" if r[c] is None else str(r[c]).lower() if isinstance(r[c], bool) else str(r[c]) for c in factor.levels]
            key = "|".join(t if t == "missing" else f"{len(t)}:{t}" for t in texts)
            one = packed_rows[tuple(r[k] for k in SERIES)]
            name = factor.ratio if "trend_ratio" in r else ("Slope_" if r.coefficient_name == VOLUME_TERM else "Intercept_") + factor.name
            assert one[name][key] == (r.trend_ratio if "trend_ratio" in r else r.coefficient_value)
            seen += 1
        maps = [factor.ratio] if factor in RATIO_FACTORS else [f"Slope_{factor.name}", f"Intercept_{factor.name}"]
        assert seen == sum(len(one[m]) for one in packed_rows.values() for m in maps)


def test_missing_levels_are_levels_of_their_own(spark, orders):
    """A missing prior campaign neither matches a level nor the other way round."""
    table = orders.model.tables["EDMMajorLaggedAvg"]
    odd = table.withColumn("prior_edm_type", F.lit(None).cast("int")).filter("not edm_lagged_flag").dropDuplicates(SERIES)
    tables = {**orders.model.tables, "EDMMajorLaggedAvg": odd}
    model = score.Model(tables, packed.pack(tables))
    early = orders.fitted.withColumn("prior_edm_type", F.lit(None).cast("int")).withColumn("edm_lagged_flag", F.lit(False))
    got = score.score(early, orders.campaigns, model, orders.settings)
    want = {tuple(r[k] for k in SERIES): r.trend_ratio for r in odd.collect()}
    for r in got.filter("Predict_TrendLong <> 0").limit(200).collect():
        assert r.Predict_EDMMajorLaggedAvg == pytest.approx(want[tuple(r[k] for k in SERIES)] * r.Predict_TrendLong)


def test_unseen_levels_contribute_nothing(spark, orders):
    strange = orders.fitted.withColumns(
        {"school_holiday": F.lit("never seen"), "influential_date": F.lit("never seen")}
    )
    scored = score.score(strange, orders.campaigns, orders.model, orders.settings)
    top = scored.agg(
        F.max(F.abs("Predict_SeasonalSchoolHoliday")), F.max(F.abs("Predict_SeasonalInfluentialDate"))
    ).first()
    assert tuple(top) == (0.0, 0.0)


def test_score_starts_at_the_first_campaign_and_keeps_volume_rows(orders):
    first = orders.campaigns.agg(F.min("date")).first()[0]
    got = orders.scored.agg(F.min("date"), F.min("amount_type"), F.max("amount_type")).first()
    assert got[0] >= first and got[1] == got[2] == 103


def test_long_form_has_fifteen_parts_in_both_groups(orders):
    long = hierarchy.decompose_long(orders.scored_in_place)
    assert long.count() == 15 * orders.scored_in_place.count()
    kinds = {r[0]: r[1] for r in long.groupBy("decomposition_l1").agg(F.countDistinct("decomposition_name")).collect()}
    assert kinds == {"Actual Results": 1, "Model Results": 13, "Residual": 1}


def test_unknown_names_fall_into_other(spark):
    df = hierarchy.with_hierarchy(spark.sql("SELECT 'Something' AS decomposition_name"))
    assert (df.first().decomposition_l1, df.first().decomposition_l2) == ("Other", "Other")


def test_settings_choose_the_scored_measure(spark, orders):
    conf = settings()
    assert conf.volume_measure == 103 and conf.price_measure == 100
