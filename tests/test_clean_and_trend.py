from __future__ import annotations

from datetime import timedelta

import pytest
from tests.helpers import DAY0, column, fact, settings
from hypothesis import HealthCheck, given
from hypothesis import settings as budget
from hypothesis import strategies as st

from ebbline.operators import clean, trend
from ebbline.plans import stages
from ebbline.settings import CAR_PARK, Regime


def cleaned(spark, amounts, amount_type, **more):
    return stages.cleaned(fact(spark, amounts, amount_type, **more), settings())


@pytest.mark.parametrize(
    "raw, want",
    [
        ([5, None, 0, float("inf"), 7], [5, 5, 5, 5, 7]),
        ([None, 0, 4], [0, 0, 4]),
        ([3, float("nan"), float("-inf"), 2], [3, 3, 3, 2]),
    ],
)
def test_price_carries_last_sound_value(spark, raw, want):
    assert column(cleaned(spark, raw, 100), "amount") == want


@pytest.mark.parametrize(
    "raw, want",
    [([3, 0, 2], [3, 0, 2]), ([None, 4, None], [0, 4, 0]), ([float("inf"), 1], [0, 1])],
)
def test_volume_gaps_become_zero(spark, raw, want):
    assert column(cleaned(spark, raw, 103), "amount") == want


def test_price_is_not_carried_across_series(spark):
    both = fact(spark, [5, None], 100).union(fact(spark, [None, 9], 100, product=2))
    rows = stages.cleaned(both, settings()).filter("product_key = 2")
    assert column(rows, "amount") == [0, 9]


def test_width_grows_to_the_cap(spark):
    df = clean.growing_width(clean.tag_regime(fact(spark, [1] * 6), settings()), settings(cap=4))
    assert column(df, "width") == [1, 2, 3, 4, 4, 4]


def test_width_counts_calendar_days(spark):
    df = clean.tag_regime(fact(spark, [1, 1, 1], offsets=[0, 3, 10]), settings())
    assert column(clean.growing_width(df, settings(cap=9)), "width") == [1, 4, 9]


def test_regimes_of_the_car_park_study(spark):
    from datetime import date

    days = [date(2020, 3, 12), date(2020, 3, 13), date(2020, 3, 26), date(2020, 3, 27)]
    df = fact(spark, [1] * 4, offsets=[(d - DAY0).days for d in days])
    assert column(clean.tag_regime(df, CAR_PARK), "regime") == [
        "Pre-COVID",
        "Transition-COVID",
        "Transition-COVID",
        "Recovery-COVID",
    ]


def brute_trend(values, widths):
    out = []
    for i, w in enumerate(widths):
        lo, hi = max(0, i - (w - 1) // 2), min(len(values), i + w // 2 + 1)
        out.append(sum(values[lo:hi]) / (hi - lo))
    return out


def run_trend(spark, amounts, conf, offsets=None):
    return trend.centred_trend(
        stages.cleaned(fact(spark, amounts, offsets=offsets), conf)
    )


def test_even_width_reaches_one_row_further_ahead(spark):
    got = column(run_trend(spark, [1, 2, 4, 8, 16, 32], settings(cap=4)), "trend")
    assert got == pytest.approx(brute_trend([1, 2, 4, 8, 16, 32], [1, 2, 3, 4, 4, 4]))
    assert got[3] == pytest.approx((4 + 8 + 16 + 32) / 4)


def test_trend_restarts_in_every_regime(spark):
    conf = settings(
        cap=5, regimes=(Regime("a", DAY0 + timedelta(days=4)), Regime("b", None))
    )
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 100.0, 200.0, 300.0]
    got = column(run_trend(spark, values, conf), "trend")
    want = brute_trend(values[:5], [1, 2, 3, 4, 5]) + brute_trend(values[5:], [1, 2, 3])
    assert got == pytest.approx(want)


@budget(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.tuples(st.integers(0, 3), st.floats(-1e4, 1e4)), min_size=1, max_size=40
    ),
    st.integers(1, 12),
)
def test_running_sums_match_the_definition(spark, steps, cap):
    offsets, day = [], -1
    for gap, _ in steps:
        day += 1 + gap
        offsets.append(day)
    values = [v for _, v in steps]
    conf = settings(cap=cap)
    rows = run_trend(spark, values, conf, offsets).orderBy("date").collect()
    want = brute_trend([r.amount for r in rows], [r.width for r in rows])
    assert [r.trend for r in rows] == pytest.approx(want, abs=1e-7)
    frames = trend.centred_trend_by_frames(
        stages.cleaned(fact(spark, values, offsets=offsets), conf), conf
    )
    assert column(frames, "trend") == pytest.approx(want, abs=1e-7)


def test_trend_filter_keeps_the_width_of_the_whole_fact(spark):
    conf = settings()
    early = fact(spark, [1] * 5, offsets=range(-3, 2))
    rows = stages.trended(early, conf).orderBy("date").collect()
    assert [r.date for r in rows] == [DAY0, DAY0 + timedelta(days=1)]
    assert [r.width for r in rows] == [4, 5]


def test_price_change_is_shared_by_the_measures_of_a_day(spark):
    both = fact(spark, [10, 15, 12], 100).union(fact(spark, [1, 2, 3], 103))
    rows = stages.trended(both, settings()).filter("amount_type = 103")
    assert column(rows, "price_change_prior") == [None, pytest.approx(0.5), pytest.approx(-0.2)]


def test_price_change_from_zero_is_missing(spark):
    rows = stages.trended(fact(spark, [None, 4, 6], 100), settings())
    assert column(rows, "price_change_prior") == [None, None, pytest.approx(0.5)]
