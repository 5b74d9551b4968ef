"""Mined negatives against scores of all pairs; bounds and curve on their own."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbline.llm import negatives
from tests.llm.test_topk import SCHEMA, dot, drawn, odd_rows, order, whole


def brute(rows, every=50):
    known = []
    for r in rows:
        label = r[2]
        if label is not None and r[0] is not None and r[0] % 7 == 0:
            label = (label + 1) % 10
        if label is not None and whole(r) is not None:
            known.append((r, whole(r), label))
    out = []
    for i, (a, v, label) in enumerate(known):
        if a[0] is None or a[0] % every:
            continue
        scored = [(r, dot(v, w), of) for j, (r, w, of) in enumerate(known) if j != i]
        positives = sorted(((r, s) for r, s, of in scored if of == label), key=order)[:5]
        others = sorted(((r, s) for r, s, of in scored if of != label), key=order)
        for p, ps in positives:
            fits = [(r, s) for r, s in others if 50 * ps <= 100 * s <= 95 * ps][:3]
            out += [(a[0], p[0], n + 1, r[0], ps, s) for n, (r, s) in enumerate(fits)]
    return sorted(out, key=str)


def result(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    return sorted(map(tuple, negatives.mine(df, **more).collect()), key=str)


@pytest.mark.parametrize("dims", [1, 6, 20])
def test_equal_to_all_pairs(spark, dims):
    rng = random.Random(dims)
    rows = drawn(rng, 300, dims) + odd_rows()
    rows += [(1000 + i, [0.5] * dims, i % 2) for i in range(150)]
    rows += [(2000 + 50 * i, [0.0] * dims, i % 3) for i in range(4)]
    want = brute(rows)
    assert want and result(spark, rows) == want


def test_cells_of_any_size_agree(spark, monkeypatch):
    rng = random.Random(2)
    centres = [[rng.gauss(0, 4) for _ in range(8)] for _ in range(12)]
    rows = [(i, [x + rng.gauss(0, 0.3) for x in centres[i % 12]], (i % 12) // 3) for i in range(600)]
    want = brute(rows, 5)
    for name, value in (("BLOCK_VALUES", 8 * 16), ("GROUP_VALUES", 8 * 20), ("ZONE_VALUES", 8 * 5), ("OPEN_BLOCKS", 3)):
        monkeypatch.setattr(negatives, name, value)
        assert result(spark, rows, every=5) == want


def test_zone_maps_leave_blocks_unread(spark, monkeypatch):
    """Clustered vectors: most blocks are never opened for most anchors."""
    rng = random.Random(4)
    centres = [[rng.gauss(0, 4) for _ in range(8)] for _ in range(16)]
    rows = [(i, [x + rng.gauss(0, 0.1) for x in centres[i % 16]], i % 4) for i in range(1600)]
    monkeypatch.setattr(negatives, "BLOCK_VALUES", 8 * 32)
    opened = []
    plain = negatives.Search._opened

    def counted(self, anchors, needed, k, same):
        bits = F.aggregate(
            F.sequence(F.lit(1), F.length("wanted")), F.lit(0),
            lambda n, i: n + F.bit_count(F.conv(F.hex(F.substring("wanted", i, F.lit(1))), 16, 10).cast("int")),
        )
        opened.append((needed.select(F.sum(bits)).first()[0], self.blocks.count(), anchors.count()))
        return plain(self, anchors, needed, k, same)

    monkeypatch.setattr(negatives.Search, "_opened", counted)
    assert result(spark, rows, every=25) == brute(rows, 25)
    (_, blocks, anchors), (positives, *_), _, (negative, *_) = opened
    assert positives < 0.3 * blocks * anchors and negative < 0.5 * blocks * anchors


def test_curve_visits_neighbours():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = negatives.hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(side**dims))
        steps = np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1)
        assert (steps == 1).all()


def test_bounds_hold_every_product():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    values = rng.integers(-300, 300, (40, 9))
    block = rng.integers(-300, 300, (25, 9))
    zones = pa.table(
        {"low": [block.min(0).tolist()], "high": [block.max(0).tolist()], "label_low": [1], "label_high": [1]}
    )
    got = values @ block.T
    anchors = object.__new__(negatives._Anchors)
    anchors.values, anchors.label = values, np.full(40, 1)
    anchors.no = np.zeros((40, 1), np.int64)
    anchors.low, anchors.high = got.max(1)[:, None], got.max(1)[:, None]
    assert negatives._bounds(anchors, zones, True).all()
    assert not negatives._bounds(anchors, zones, False).any()


def test_empty_tables_and_other_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert negatives.mine(empty).count() == 0
    assert negatives.mine(spark.createDataFrame([(1, [1.0], 0)], SCHEMA)).count() == 0
    assert negatives.mine(spark.createDataFrame([(50, [1.0], 0)], SCHEMA)).count() == 0
    odd = spark.createDataFrame(
        [(50, [1.0], 1, 1, 1), (3, [1.0], 1, 1, 1), (4, [0.8], 2, 1, 1)],
        "vec_id long, embedding array<double>, label int, rank int, g int",
    )
    assert [tuple(r) for r in negatives.mine(odd).collect()] == [(50, 3, 1, 4, 65536, 256 * 204)]
