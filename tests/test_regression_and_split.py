from __future__ import annotations

import math
import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from tests.helpers import DAY0

from ebbline.functions.student import t_pvalue
from ebbline.operators import regression, split
from ebbline.settings import SERIES

# Two-sided 5 percent points of Student's t.
CRITICAL = {1: 12.7062, 2: 4.30265, 3: 3.18245, 4: 2.77645, 5: 2.57058, 10: 2.22814, 30: 2.04227,
            60: 2.00030, 120: 1.97993, 500: 1.96472, 1000: 1.96234}


def pvalues(spark, pairs):
    rows = spark.createDataFrame(pairs, "t double, df long")
    return [r[0] for r in rows.select(t_pvalue(F.col("t"), F.col("df"))).collect()]


def test_p_values_at_textbook_points(spark):
    got = pvalues(spark, [(t, df) for df, t in CRITICAL.items()])
    assert got == pytest.approx([0.05] * len(CRITICAL), abs=2e-6)


def test_p_value_edges(spark):
    assert pvalues(spark, [(0.0, 7), (0.0, 5000)]) == pytest.approx([1.0, 1.0])
    assert pvalues(spark, [(None, 7), (2.0, 0)]) == [None, None]
    assert pvalues(spark, [(-2.22814, 10)]) == pytest.approx([0.05], abs=1e-6)
    assert pvalues(spark, [(40.0, 300), (40.0, 100_000)]) == pytest.approx([0, 0], abs=1e-12)


def test_p_values_in_closed_form(spark):
    """Exact for one, two and four degrees of freedom, normal for very many."""
    ts = [0.3, 1.3, 4.0, 40.0, 1000.0]
    one = [1 - 2 / math.pi * math.atan(t) for t in ts]
    two = [1 - t / math.sqrt(2 + t * t) for t in ts]
    four = [1 - (t / math.sqrt(4 + t * t)) * (1 + 2 / (4 + t * t)) for t in ts]
    got = pvalues(spark, [(t, df) for df in (1, 2, 4) for t in ts])
    assert got == pytest.approx([*one, *two, *four], rel=1e-7, abs=1e-12)
    many = pvalues(spark, [(t, 10**9) for t in (0.5, 1.5, 6.0, 9.0)])
    assert many == pytest.approx([math.erfc(t / math.sqrt(2)) for t in (0.5, 1.5, 6.0, 9.0)], rel=1e-6)


def test_far_tails_keep_their_digits(spark):
    """Three degrees of freedom have a closed form; its tail is a series where it cancels."""
    import numpy as np

    def three(t):
        angle = math.atan(math.sqrt(3) / t)
        return 2 / math.pi * (angle - math.sin(angle) * math.cos(angle))

    got = pvalues(spark, [(t, 3) for t in (0.2, 1.7, 9.0, 60.0)])
    assert got == pytest.approx([three(t) for t in (0.2, 1.7, 9.0, 60.0)], rel=1e-9)
    # leading term of the tail: p -> 2 c t^-df df^((df+1)/2) / df, down to 1e-200
    for df, t in ((1, 1e199), (2, 1e100), (10, 1e20), (40, 1e6)):
        c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
        want = math.log(2 * c) + (df + 1) / 2 * math.log(df) - math.log(df) - df * math.log(t)
        assert math.log(pvalues(spark, [(t, df)])[0]) == pytest.approx(want, abs=1e-8)
    # many degrees of freedom: against a fine quadrature of the density in the tail
    for df, t in ((100, 30.0), (10**4, 30.5), (10**9, 30.5), (37, 2.0), (999, 1.73), (999, 1.74)):
        u = t + np.linspace(0, 60 / t * (1 + t * t / df) + 8, 400_001)
        log = -(df + 1) / 2 * np.log1p(u * u / df)
        # the constant by the recurrence, as logarithms of gammas cancel for many degrees
        k = df / 2 + 1000
        ratio = math.exp(np.log1p(-0.5 / (df / 2 + np.arange(1000) + 0.5)).sum()) * math.sqrt(k - 0.25) * (1 + 1 / 64 / (k - 0.25) ** 2)
        body = np.exp(log - log[0])
        area = (body[0] + body[-1] + 4 * body[1::2].sum() + 2 * body[2:-1:2].sum()) * (u[1] - u[0]) / 3
        want = math.log(2 * ratio / math.sqrt(df * math.pi) * area) + log[0]
        assert math.log(pvalues(spark, [(t, df)])[0]) == pytest.approx(want, abs=1e-7), (df, t)


def test_p_values_fall_with_the_degrees_of_freedom(spark):
    ps = pvalues(spark, [(8.0, df) for df in (3, 30, 399, 400, 401, 500, 10_000)])
    assert ps == sorted(ps, reverse=True) and ps[2] == pytest.approx(ps[4], rel=0.05)


def test_ols_terms_by_hand(spark):
    xs, ys = [1.0, 2.0, 3.0, 4.0, 6.0], [1.1, 1.9, 3.2, 3.9, 6.3]
    df = spark.createDataFrame([("a", x, y) for x, y in zip(xs, ys)] + [("a", None, 1.0), ("b", 2.0, 5.0)],
                               "g string, x double, y double")
    terms = {(r.g, r.coefficient_name): r for r in regression.ols_by_group(df, ["g"], "y", "x").collect()}
    n, mx, my = 5, sum(xs) / 5, sum(ys) / 5
    sxx = sum((x - mx) ** 2 for x in xs)
    slope = sum((x - mx) * (y - my) for x, y in zip(xs, ys)) / sxx
    rss = sum((y - my - slope * (x - mx)) ** 2 for x, y in zip(xs, ys))
    got = terms["a", "x"]
    assert got.coefficient_value == pytest.approx(slope)
    assert got.std_error == pytest.approx(math.sqrt(rss / (n - 2) / sxx))
    assert got.statistic == pytest.approx(slope / math.sqrt(rss / (n - 2) / sxx))
    start = terms["a", "Intercept"]
    assert start.coefficient_value == pytest.approx(my - slope * mx)
    assert start.std_error == pytest.approx(math.sqrt(rss / (n - 2) * (1 / n + mx * mx / sxx)))
    assert terms["b", "x"].coefficient_value is None


def amounts(spark, values):
    rows = [(DAY0 + timedelta(days=i), i % 3, 1, 103, float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(
        rows, "date date, product_key int, stay_key int, amount_type int, amount double"
    )
    return split.with_row_hash(df)


@pytest.mark.parametrize(
    "values",
    [
        [random.Random(1).random() for _ in range(997)],
        [0] * 600 + [5] * 100 + list(range(57)),
        [4] * 20,
    ],
)
def test_every_stratum_gives_its_share(spark, values):
    for r in split.split_balance(split.split(amounts(spark, values), 0.2)).collect():
        assert r.n_test == math.ceil(r.n_rows * 0.2)


def test_test_rows_have_the_smallest_hashes(spark):
    df = amounts(spark, [random.Random(2).random() for _ in range(500)])
    flags = {(r.date): r for r in split.split(df, 0.3).join(df.select("date", "row_hash"), "date").collect()}
    for stratum in {r.stratum for r in flags.values()}:
        rows = sorted((r.row_hash, r.is_test) for r in flags.values() if r.stratum == stratum)
        want = math.ceil(0.3 * len(rows))
        assert [f for _, f in rows] == [True] * want + [False] * (len(rows) - want)


def test_split_does_not_depend_on_partitions(spark):
    df = amounts(spark, range(300))
    one = {r.date for r in split.split(df.coalesce(1), 0.2).filter("is_test").collect()}
    many = {r.date for r in split.split(df.repartition(17), 0.2).filter("is_test").collect()}
    assert one == many and len(one) == 60


def test_split_within_series_takes_the_share_of_every_series(spark):
    rows = split.split_within_series(amounts(spark, range(300)), 0.2)
    for r in split.split_balance(rows, *SERIES).collect():
        assert r.n_test == math.ceil(0.2 * r.n_rows)
    assert rows.select("product_key", "stratum").distinct().count() == 12
