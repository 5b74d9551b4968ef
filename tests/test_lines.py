"""Lines from monthly sums against lines through the days themselves."""

from __future__ import annotations

import random
from datetime import date, timedelta

import pytest

from ebbline.operators import lines

START = date(2021, 1, 1)
EPOCH = date(1970, 1, 1)


def rows(n=500, series=2):
    rng = random.Random(4)
    out = []
    for s in range(series):
        for i in range(n):
            if rng.random() < 0.8:
                out.append((START + timedelta(days=i), s, 5.0 + 0.1 * i + rng.gauss(0, 3)))
    return out + [(START + timedelta(days=3), 0, None)]


def by_hand(points):
    n = len(points)
    mx, my = sum(x for x, _ in points) / n, sum(y for _, y in points) / n
    sxx = sum((x - mx) ** 2 for x, _ in points)
    if not sxx:
        return n, None, None
    slope = sum((x - mx) * (y - my) for x, y in points) / sxx
    return n, slope, my - slope * mx


def frames(spark):
    df = spark.createDataFrame(rows(), "date date, k int, y double")
    return df, lines.month_sums(df, ["k"], "y")


WINDOWS = [
    (date(2021, 2, 1), date(2021, 8, 31)),
    (date(2021, 2, 1), date(2021, 2, 28)),
    (date(2021, 1, 20), date(2021, 5, 9)),
    (date(2021, 3, 4), date(2021, 3, 22)),
    (date(2021, 12, 17), date(2022, 1, 31)),
    (date(2021, 3, 1), date(2021, 4, 2)),
]


@pytest.mark.parametrize("first, last", WINDOWS)
def test_any_stretch_of_days(spark, first, last):
    df, months = frames(spark)
    got = {r.k: r for r in lines.window_lines(months, df, ["k"], "y", first, last).collect()}
    for k in (0, 1):
        points = [((d - EPOCH).days, y) for d, s, y in rows() if s == k and y is not None and first <= d <= last]
        n, slope, intercept = by_hand(points)
        assert got[k].n_points == n
        assert got[k].slope == pytest.approx(slope, rel=1e-9)
        assert got[k].epoch_intercept == pytest.approx(intercept, rel=1e-9)


def test_lines_through_monthly_means(spark):
    first, last = date(2021, 2, 1), date(2021, 12, 31)
    _, months = frames(spark)
    got = {r.k: r for r in lines.monthly_mean_lines(months, ["k"], first, last).collect()}
    for k in (0, 1):
        days = [(d, y) for d, s, y in rows() if s == k and y is not None and first <= d <= last]
        means = {}
        for d, y in days:
            means.setdefault(d.month, []).append(y)
        points = [((d - EPOCH).days, sum(means[d.month]) / len(means[d.month])) for d, _ in days]
        n, slope, _ = by_hand(points)
        assert (got[k].n_points, got[k].slope) == (n, pytest.approx(slope, rel=1e-9))
    with pytest.raises(ValueError, match="whole months"):
        lines.monthly_mean_lines(months, ["k"], date(2021, 2, 2), last)


def test_one_day_has_no_line(spark):
    df = spark.createDataFrame([(START, 1, 4.0)], "date date, k int, y double")
    got = lines.window_lines(lines.month_sums(df, ["k"], "y"), df, ["k"], "y", START, date(2021, 1, 31)).first()
    assert (got.n_points, got.slope, got.epoch_intercept) == (1, None, None)
