"""The shape of the physical plans."""

from __future__ import annotations

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from ebbline.operators import factors, hierarchy, packed, score
from ebbline.plans import accuracy as acc
from ebbline.plans import registry, stages, studies
from ebbline.settings import PLACEMENT
from ebbline.sources import orders as order_tables
from tests.conftest import SMALL


def plan(df, mode: str = "simple") -> str:
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain(mode)
    return text.getvalue()


def exchanges(text: str, kind: str = "hashpartitioning") -> list[str]:
    return re.findall(rf"Exchange {kind}\([^)]*\)", text)


def test_trend_needs_no_placement_beyond_that_of_the_daily_sums(orders):
    text = plan(stages.trended(orders.inputs.daily_fact, orders.settings, placed=True))
    assert not exchanges(text)


def test_lines_are_read_once(spark, orders):
    """Whatever starts from the lines starts from the stored sums per day."""
    inputs = orders.inputs
    for frame in (inputs.daily_fact, inputs.calendar, inputs.campaigns, stages.cleaned(inputs.daily_fact, orders.settings)):
        assert "lineitem" not in plan(frame)
    raw = plan(order_tables.sums_of(spark, SMALL))
    assert len(re.findall(r"FileScan parquet", raw)) == 1 and "l_extendedprice" in raw


def test_grains_multiply_no_rows(orders):
    text = plan(acc.accuracy_all_grains(orders.scored_in_place))
    assert "Expand" not in text


def test_a_series_of_a_model_is_one_bucket(spark, orders):
    key = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
    old = spark.conf.get(key)
    try:
        # the plan names the buckets only where it may not split them
        spark.conf.set(key, "false")
        text = plan(orders.model_sample("SeasonalMonth", 1, 1, 103), "formatted")
    finally:
        spark.conf.set(key, old)
    assert re.search(r"SelectedBucketsCount: 1 out of \d\d?", text)
    assert orders.model_sample("SeasonalMonth", 1, 1, 103).rdd.getNumPartitions() == 1
    rows = orders.model_sample("SeasonalMonth", 1, 1, 103).collect()
    whole = orders.model_table("SeasonalMonth").filter("product_key = 1 and stay_key = 1 and amount_type = 103")
    assert sorted(map(tuple, rows)) == sorted(map(tuple, whole.collect())) and len(rows) == 12


def test_names_come_from_all_rows(orders):
    text = plan(studies.hierarchy_table(orders.scored_in_place))
    assert "Limit" not in text and "HashAggregate" in text


def without_subqueries(text: str) -> str:
    """The main plan: lines of subquery plans are drawn one level deeper, behind a bar."""
    kept, depth = [], None
    for line in text.splitlines():
        indent = len(line) - len(line.lstrip(" :+-|"))
        if depth is not None and indent > depth:
            continue
        depth = indent if "Subquery" in line[indent:][:20] else None
        if depth is None:
            kept.append(line)
    return "\n".join(kept)


def test_fit_chain_runs_in_place_on_a_placed_stage(orders):
    rows = orders.store.stage("test/divided", lambda: orders.divided, placed=True)
    text = plan(factors.fit_chain(rows))
    assert "Exchange" not in text
    # shared local sorts: ten ratio factors and two regressions need ten sorts
    assert len(re.findall(r"\bSort \[", text)) == 10


def test_split_keeps_the_placement(orders):
    text = without_subqueries(plan(factors.fit_chain(orders.divided)))
    assert "Window" in text and "Exchange" not in text


def test_tables_of_single_series_need_no_shuffle(orders):
    for table in (
        score.ratio_table(orders.fitted, factors.BY_NAME["EDMMajorDOW"]),
        acc.accuracy(orders.scored_in_place, acc.FULL),
        acc.error_steps(orders.scored_in_place, acc.FULL),
    ):
        assert "hashpartitioning" not in without_subqueries(plan(table))


def test_no_python_and_no_nested_loops_in_any_table(spark, orders):
    for name, table in registry.tables().items():
        text = plan(table(orders))
        for bad in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin", "MapInArrow"):
            assert bad not in text, (name, bad)


def test_scan_reads_only_what_a_table_needs(spark, orders):
    text = plan(order_tables.daily_fact(spark.read.parquet(f"{SMALL}/lineitem.parquet")))
    read = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert any("l_extendedprice" in r for r in read)
    assert not any("l_tax" in r or "l_orderkey" in r for r in read)
    wide = plan(acc.accuracy(orders.scored_in_place, acc.HIGH), "formatted")
    assert "EqualTo(amount_type,103)" in wide
    assert "price_change_prior" not in "".join(re.findall(r"ReadSchema: (struct<.*)", wide))


def joins(text: str) -> list[str]:
    return re.findall(r"\b(?:BroadcastHash|SortMerge|ShuffledHash|BroadcastNestedLoop)Join\b|CartesianProduct", text)


def test_a_small_model_is_one_broadcast_join(orders):
    assert joins(without_subqueries(plan(orders.scored))) == ["BroadcastHashJoin"]


def test_a_large_model_is_one_join_in_place(spark, orders):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        df = score.score(orders.fitted, orders.campaigns, orders.model, orders.settings)
        text = without_subqueries(plan(df))
        assert joins(text) == ["SortMergeJoin"]
        assert len(exchanges(text)) <= 2
        a = df.agg(F.sum("Residual")).first()[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert a == pytest.approx(orders.scored.agg(F.sum("Residual")).first()[0], abs=1e-6)


def test_a_model_is_packed_with_one_placement(orders):
    tables = {f.name: orders.model_table(f.name) for f in factors.FACTORS}
    text = plan(packed.pack(tables))
    assert len(exchanges(text)) == 1 and not joins(text)


def test_steps_multiply_no_rows_before_the_aggregation(orders):
    text = plan(acc.error_steps(orders.scored_in_place, acc.HIGH))
    body = text[text.rindex("Generate inline") :]
    assert "Expand" not in body and "Generate" not in body.replace("Generate inline", "", 1)
    assert "Window" not in text


def test_long_form_is_one_expand(orders):
    assert "Expand" in plan(hierarchy.decompose_long(orders.scored_in_place))


@pytest.mark.parametrize("partitions", [1, 50])
def test_results_do_not_depend_on_shuffle_partitions(spark, orders, partitions):
    want = {r.decomposition_name: r.RMSE_Test for r in acc.overall_steps(orders.scored_in_place).collect()}
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        fresh = stages.Decomposition(
            orders.inputs, orders.settings, orders.store, f"test/p{partitions}", placed=True
        )
        got = {r.decomposition_name: r.RMSE_Test for r in acc.overall_steps(fresh.scored_in_place).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == pytest.approx(want)


def test_a_hot_product_is_summed_before_it_is_placed(spark):
    """One product holds nearly all lines; its rows shrink to days ahead of the shuffle."""
    lines = spark.range(200_000).select(
        F.expr("timestamp_ntz '1995-01-02' + make_interval(0, 0, 0, CAST(id % 400 AS INT))")
        .cast("timestamp")
        .alias("l_shipdate"),
        F.when(F.col("id") % 1000 == 0, "N").otherwise("A").alias("l_returnflag"),
        F.lit("F").alias("l_linestatus"),
        F.lit(10.0).alias("l_extendedprice"),
        F.col("id").alias("l_suppkey"),
    )
    fact = order_tables.daily_fact(lines)
    text = plan(fact)
    first = text.rindex("Exchange hashpartitioning(date")
    assert "HashAggregate" in text[first:]
    assert fact.filter("amount_type = 103").agg(F.sum("raw_amount")).first()[0] == 200_000
    assert fact.count() == 2 * 2 * 400
