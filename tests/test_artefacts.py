"""Saved models: what makes them whole, and what load refuses."""

from __future__ import annotations

import json
import shutil

import pytest
from pyspark.sql import functions as F
from tests.helpers import settings

from ebbline.operators.score import Model
from ebbline.plans import results
from ebbline.sources import artefacts, tables


@pytest.fixture
def saved(spark, tmp_path):
    """Two small tables saved as one artefact."""
    frames = {"a": spark.range(5), "b": spark.range(3).select(F.col("id").cast("string").alias("s"))}
    artefacts.save(str(tmp_path / "m"), frames, "here")
    return tmp_path / "m"


def told(folder) -> dict:
    (part,) = (folder / "manifest").glob("part-*")
    return json.loads(part.read_text())


def rewrite(folder, value: str) -> None:
    (part,) = (folder / "manifest").glob("part-*")
    part.write_text(value)
    for crc in (folder / "manifest").glob(".*.crc"):
        crc.unlink()


def test_a_whole_artefact_is_read_with_its_schema(spark, saved):
    frames = artefacts.load(spark, str(saved), ["a", "b"], "here")
    assert frames["a"].count() == 5 and frames["b"].dtypes == [("s", "string")]
    manifest = told(saved)
    assert manifest["format"] == artefacts.FORMAT and manifest["settings"] == "here"
    for name, table in manifest["tables"].items():
        files = {p.name: p.stat().st_size for p in (saved / name).glob("*.parquet")}
        assert {f: n for f, n, _ in table["files"]} == files


def test_a_half_written_model_is_refused(spark, saved):
    shutil.move(saved / "manifest", saved / "gone")
    with pytest.raises(ValueError, match="not written to its end"):
        artefacts.load(spark, str(saved), ["a"])


def test_an_unreadable_manifest_is_refused(spark, saved):
    for text in ("", "{", '{"format": 1}'):
        rewrite(saved, text)
        with pytest.raises(ValueError, match="cannot be read"):
            artefacts.load(spark, str(saved), ["a"])


def test_another_format_version_is_refused(spark, saved):
    rewrite(saved, json.dumps(told(saved) | {"format": 99}))
    with pytest.raises(ValueError, match="format 99"):
        artefacts.load(spark, str(saved), ["a"])


def test_other_settings_and_absent_tables_are_refused(spark, saved):
    with pytest.raises(ValueError, match="other settings"):
        artefacts.load(spark, str(saved), ["a"], "there")
    with pytest.raises(ValueError, match="lacks c"):
        artefacts.load(spark, str(saved), ["a", "c"])


def test_a_table_written_again_is_refused(spark, saved):
    spark.range(50).write.mode("overwrite").parquet(str(saved / "a"))
    with pytest.raises(ValueError, match="changed after it was saved: a"):
        artefacts.load(spark, str(saved), ["a", "b"])
    assert artefacts.load(spark, str(saved), ["b"])["b"].count() == 3


def test_a_file_overwritten_in_place_is_refused(spark, saved, tmp_path):
    spark.range(7, 12).coalesce(1).write.parquet(str(tmp_path / "other"))
    (new,) = (tmp_path / "other").glob("*.parquet")
    old = max((saved / "a").glob("*.parquet"), key=lambda p: p.stat().st_size)
    shutil.copyfile(new, old)
    (old.parent / f".{old.name}.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match="changed"):
        artefacts.load(spark, str(saved), ["a"])


def test_a_missing_table_is_refused(spark, saved):
    shutil.move(saved / "b", saved / "away")
    with pytest.raises(ValueError, match="lacks a table"):
        artefacts.load(spark, str(saved), ["a", "b"])


def test_an_input_overwritten_in_place_is_another_input(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).coalesce(1).write.parquet(path)
    (file,) = (tmp_path / "t").glob("*.parquet")
    first = tables.fingerprint(spark.read.parquet(path))
    assert tables.fingerprint(spark.read.parquet(path)) == first
    spark.range(100, 110).coalesce(1).write.parquet(str(tmp_path / "new"))
    (new,) = (tmp_path / "new").glob("*.parquet")
    shutil.copyfile(new, file)
    (tmp_path / "t" / f".{file.name}.crc").unlink(missing_ok=True)
    spark.catalog.refreshByPath(path)
    assert tables.fingerprint(spark.read.parquet(path)) != first


def test_plans_and_settings_are_told_apart(spark):
    one = spark.range(5)
    prints = [
        tables.fingerprint(one, settings()),
        tables.fingerprint(one.filter("id > 1"), settings()),
        tables.fingerprint(one.filter("id > 2"), settings()),
        tables.fingerprint(one, settings(cap=2)),
    ]
    assert len(set(prints)) == 4


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Conf:
        def __init__(self, held):
            self.held = held

        def get(self, key, default=None):
            return self.held.get(key, default)

    class Session:
        def __init__(self, **held):
            self.conf = Conf(held)

    local = {"spark.sql.warehouse.dir": "file:/x/warehouse"}
    assert tables.shared_folder(Session(**local, **{"spark.master": "local[4]"})) == "file:/x/warehouse"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.shared_folder(Session(**local, **{"spark.master": "yarn"}))
    named = {**local, "spark.master": "yarn", "spark.checkpoint.dir": "hdfs://x/shared/"}
    assert tables.shared_folder(Session(**named)) == "hdfs://x/shared"
    remote = {"spark.master": "yarn", "spark.sql.warehouse.dir": "hdfs://x/warehouse"}
    assert tables.shared_folder(Session(**remote)) == "hdfs://x/warehouse"


def test_a_loaded_model_scores_its_own_frame_like_the_fit(spark, orders, tmp_path):
    orders.model.save(str(tmp_path), orders.settings)
    model = Model.load(spark, str(tmp_path), orders.settings)
    with pytest.raises(ValueError, match="other settings"):
        Model.load(spark, str(tmp_path), settings())
    found = results.apply_model(orders.inputs, model, orders.settings, orders.store, "test/own", placed=True)
    sums = [F.count(F.lit(1)), F.sum("Amount"), F.sum(F.abs("Residual")), F.sum("Predict_EDMMajorDOWRgr")]
    got, want = found.scored.agg(*sums).first(), orders.scored.agg(*sums).first()
    assert tuple(got) == pytest.approx(tuple(want), rel=1e-9)
    assert found.long.count() == 15 * got[0]
    high = found.accuracy_high.first()
    assert high.data == "New" and found.steps_high.count() == 13
    assert found.steps_high.orderBy(F.desc("step_rank")).first().RMSE == pytest.approx(high.RMSE)
    assert found.accuracy_full.count() == 6 and found.accuracy_product.count() == 3
    assert found.steps_full.count() == 6 * 13 and found.steps_product.count() == 3 * 13
    assert {r[0] for r in found.series.select("decomposition_l1").distinct().collect()} == {
        "Actual Results", "Model Results", "Residual"
    }


def test_a_series_the_model_has_not_seen_keeps_its_trend_only(spark, orders):
    fact = orders.inputs.daily_fact.withColumn("product_key", F.col("product_key") + 100)
    inputs = tables.Inputs(fact, orders.inputs.calendar, orders.inputs.campaigns, orders.inputs.dim_stay)
    found = results.apply_model(inputs, orders.model, orders.settings, orders.store, "test/strange")
    parts = [F.max(F.abs(c)) for c in found.scored.columns if c.startswith("Predict_") and c != "Predict_TrendLong"]
    assert set(found.scored.agg(*parts).first()) == {0.0} and found.scored.count() > 0
