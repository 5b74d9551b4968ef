from __future__ import annotations

from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from tests import helpers
from tests.helpers import DAY0

from ebbline.plans.stages import Decomposition
from ebbline.sources import schema, tables
from ebbline.sources.tables import StageStore, read_inputs, shared_folder, write_table


def test_inputs_are_read_back_from_parquet(spark, orders, tmp_path):
    for name in schema.TABLES:
        write_table(getattr(orders.inputs, name), f"{tmp_path}/{name}")
    inputs = read_inputs(spark, str(tmp_path))
    assert inputs.daily_fact.schema.fieldNames() == schema.FACT.fieldNames()
    again = Decomposition(inputs, orders.settings, orders.store, "test/inputs")
    assert again.main.count() == orders.main.count()
    sums = [F.count(F.lit(1)), F.sum("Residual"), F.sum("Predict_EDMMajorMonthRgr")]
    a, b = (tuple(d.scored_in_place.agg(*sums).first()) for d in (again, orders))
    assert a == pytest.approx(b, abs=1e-6)


def test_a_wrong_schema_is_refused(spark):
    bad = spark.sql("SELECT 1 AS product_key, 'x' AS stay_key")
    with pytest.raises(ValueError, match="date: want date, found nothing.*stay_key: want int, found string"):
        schema.conform(bad, schema.FACT)


def test_every_day_of_every_series_is_present(orders):
    fact = orders.inputs.daily_fact
    assert fact.count() == fact.select("date", "product_key", "stay_key", "amount_type").distinct().count()
    assert fact.count() == 12 * orders.calendar.count()


def test_stages_go_to_the_shared_folder(spark, tmp_path, monkeypatch):
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.conf.get("spark.sql.warehouse.dir")
    assert shared_folder(spark) == named.rstrip("/")
    monkeypatch.setattr(tables, "shared_folder", lambda _: f"file:{tmp_path}")
    store = StageStore(spark)
    assert store.stage("x", lambda: spark.range(3)).count() == 3
    assert list(tmp_path.rglob("*.parquet"))
    store.close()
    assert not list(tmp_path.rglob("*.parquet"))


def small_inputs(spark, folder, amounts):
    fact = spark.createDataFrame(
        [(DAY0 + timedelta(days=i), 1, 1, 103, float(a)) for i, a in enumerate(amounts) if a], schema.FACT
    )
    fact.coalesce(1).write.mode("append").parquet(f"{folder}/daily_fact")
    for name, want in schema.TABLES.items():
        if name != "daily_fact":
            spark.createDataFrame([], want).write.mode("overwrite").parquet(f"{folder}/{name}")
    return read_inputs(spark, str(folder))


def test_stages_follow_inputs_and_settings_not_labels(spark, tmp_path):
    store = StageStore(spark)
    one = small_inputs(spark, tmp_path / "a_b", [1, 2, 3])
    other = small_inputs(spark, tmp_path / "a" / "b", [7, 8, 9])
    total = lambda inputs, how: Decomposition(inputs, how, store, "same").main.agg(F.sum("amount")).first()[0]
    plain = helpers.settings()
    assert total(one, plain) == 6 and total(other, plain) == 24
    labels = {Decomposition(one, how, store, "same").label for how in (plain, helpers.settings(cap=2))}
    assert len(labels) == 2
    more = small_inputs(spark, tmp_path / "a_b", [0, 0, 0, 50])
    assert total(more, plain) != 6
    store.close()


def test_a_stage_is_built_once(spark):
    store, calls = StageStore(spark), []

    def build():
        calls.append(1)
        return spark.range(5)

    assert store.stage("once", build).count() == store.stage("once", build).count() == 5
    assert len(calls) == 1
