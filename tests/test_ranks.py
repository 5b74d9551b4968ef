"""Order statistics against sorting."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F
from tests.helpers import DAY0

from ebbline.operators import ranks as ranks_module
from ebbline.operators import split
from ebbline.operators.ranks import order_statistics, sortable, unsortable

VALUES = {
    "even": [random.Random(1).random() for _ in range(20_000)],
    "few": [float(random.Random(i).randrange(5)) for i in range(3000)],
    "wide": [math.copysign(10.0 ** random.Random(i).randrange(-300, 300), i % 3 - 1) for i in range(3000)],
    "edges": [5e-324, 0.0, -5e-324, 1.7e308, -1.7e308, 1.0, math.nextafter(1.0, 2.0)] * 3,
    "one": [2.5],
}


@pytest.mark.parametrize("name", VALUES)
def test_doubles(spark, name):
    values = sorted(VALUES[name])
    df = spark.createDataFrame([(v, 7) for v in VALUES[name]], "v double, g int").repartition(3)
    ranks = sorted({1, len(values), max(1, len(values) // 2), math.ceil(len(values) * 0.77)})
    found = order_statistics(df, "v", "g", [(7, r) for r in ranks])
    assert found == {(7, r): values[r - 1] for r in ranks}


def test_codes_sort_like_their_doubles(spark):
    rng = random.Random(3)
    values = [0.0, -0.0, 5e-324, 2.0**-1022, math.nextafter(2.0**-1022, 0), 1.0, 1.7976931348623157e308, 2.0**1023]
    values += [2.0**e for e in range(-1074, 1024, 7)] + [math.nextafter(2.0**e, 0) for e in range(-1070, 1024, 7)]
    values += [math.nextafter(2.0**e, 9e307) for e in range(-1070, 1000, 7)] + [rng.uniform(-1, 1) * 10.0 ** rng.randrange(-320, 308) for _ in range(2000)]
    values += [-v for v in values]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", sortable(F.col("v")).alias("c"))
    rows = df.collect()
    assert all(unsortable(r.c) == r.v for r in rows)
    by_code = [r.v for r in sorted(rows, key=lambda r: r.c)]
    assert by_code == sorted(values)


def test_values_of_all_magnitudes_need_six_passes(spark, monkeypatch):
    """From 1e-300 to 1e300, with the values of the wanted ranks next to each other."""
    values = [math.copysign(10.0 ** (i % 601 - 300), i % 2 - 0.5) * (1 + i / 1e6) for i in range(4000)]
    x = 1.0
    for _ in range(200):
        x = math.nextafter(x, 2.0)
        values.append(x)
    df = spark.createDataFrame([(v, 0) for v in values], "v double, g int").repartition(4)
    ordered = sorted(values)
    at = ordered.index(x)
    ranks = [1, 1000, at - 150, at - 3, at + 1, len(values)]
    passes, plain = [], ranks_module._counted
    monkeypatch.setattr(ranks_module, "_counted", lambda *given: passes.append(given) or plain(*given))
    found = order_statistics(df, "v", "g", [(0, r) for r in ranks])
    assert found == {(0, r): ordered[r - 1] for r in ranks}
    assert 2 < len(passes) <= 6


def test_ranks_may_follow_from_the_counts(spark):
    df = spark.createDataFrame([(float(i), i % 3) for i in range(100)], "v double, g int")
    found = order_statistics(df, "v", "g", lambda sizes: [(g, n) for g, n in sizes.items()])
    assert found == {(0, 34): 99.0, (1, 33): 97.0, (2, 33): 98.0}
    assert order_statistics(df.limit(0), "v", "g", lambda sizes: list(sizes.items())) == {}


def test_integers_by_group(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(1 << 60), g) for g in range(4) for _ in range(500 * g + 1)]
    df = spark.createDataFrame(rows, "v long, g int")
    wanted = [(g, math.ceil(0.2 * (500 * g + 1))) for g in range(4)]
    by_group = {g: sorted(v for v, h in rows if h == g) for g in range(4)}
    assert order_statistics(df, "v", "g", wanted) == {(g, r): by_group[g][r - 1] for g, r in wanted}
    assert order_statistics(df, "v", "g", []) == {}


def test_strata_are_exact_beyond_a_hundred_thousand_rows(spark):
    n = 150_000
    amount = F.round(F.pow(F.rand(3), 4) * 1e6, 3)
    df = spark.range(n).select(
        F.date_add(F.lit(DAY0), (F.col("id") % 5000).cast("int")).alias("date"),
        (F.col("id") / 5000).cast("int").alias("product_key"),
        F.lit(1).alias("stay_key"),
        F.lit(103).alias("amount_type"),
        amount.alias("amount"),
    )
    df = split.with_row_hash(df)
    values = sorted(r.amount for r in df.select("amount").collect())
    cuts = [values[math.ceil(n * q) - 1] for q in (0.25, 0.5, 0.75)]
    done = split.split(df, 0.2)
    for r in done.groupBy("stratum").agg(F.min("amount").alias("low"), F.max("amount").alias("high")).collect():
        assert r.stratum == 0 or r.low > cuts[r.stratum - 1]
        assert r.stratum == 3 or r.high <= cuts[r.stratum]
    for r in split.split_balance(done).collect():
        assert r.n_test == math.ceil(0.2 * r.n_rows)
