"""Exact search against scores of all pairs."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from ebbline.llm import topk, vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def whole(row):
    v = row[1]
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    v = [math.floor(256 * float(np.float32(x))) for x in v]
    return v if sum(x * x for x in v) < 2**62 else None


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def order(row_and_score):
    row, score = row_and_score
    return (-score, row[0] is None, row[0] or 0)


def brute(rows, k=5, every=50):
    known = [(r, whole(r)) for r in rows if whole(r) is not None]
    out = []
    for i, (q, v) in enumerate(known):
        if q[0] is None or q[0] % every:
            continue
        scored = sorted(((r, dot(v, w)) for j, (r, w) in enumerate(known) if i != j), key=order)
        out += [(q[0], n + 1, r[0], s) for n, (r, s) in enumerate(scored[:k])]
    return sorted(out, key=str)


def drawn(rng, n, dims, spread=1.0):
    return [(i, [rng.gauss(0, spread) for _ in range(dims)], rng.randrange(4)) for i in range(n)]


def odd_rows():
    """Rows that take no part, and some that do with defined results."""
    return [
        (50, None, 1),
        (100, [None, 1.0, 2.0], 1),
        (150, [float("nan")] * 3, 1),
        (200, [float("inf"), 0.0, 0.0], 1),
        (250, [1e30, 0.0, 0.0], 1),
        (300, [], 1),
        (350, [0.5, 0.25], 1),
        (None, [0.9] * 7, 1),
        (None, [0.9] * 7, 2),
        (400, [0.9] * 7, None),
        (400, [0.9] * 7, 3),
        (-50, [0.9] * 7, 3),
    ]


def result(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    return sorted(map(tuple, topk.search(df, **more).collect()), key=str)


@pytest.mark.parametrize("dims", [1, 7, 40])
def test_equal_to_all_pairs(spark, dims):
    rng = random.Random(dims)
    rows = drawn(rng, 320, dims) + odd_rows()
    # a vector that a third of the rows share, so that ids alone decide
    rows += [(1000 + i, [0.5] * dims, 0) for i in range(160)]
    assert result(spark, rows) == brute(rows)
    assert result(spark, rows, k=1, every=7) == brute(rows, 1, 7)


def test_cells_of_any_size_agree(spark, monkeypatch):
    rows = drawn(random.Random(3), 400, 24)
    want = brute(rows, every=3)
    for name, value in (("BLOCK_VALUES", 24 * 16), ("GROUP_VALUES", 24 * 30), ("CHUNK_VALUES", 24 * 50)):
        monkeypatch.setattr(topk, name, value)
        assert result(spark, rows, every=3) == want


def test_large_components_stay_exact(spark):
    rng = random.Random(9)
    rows = [(i, [rng.uniform(-2e6, 2e6) for _ in range(6)], 0) for i in range(120)]
    assert result(spark, rows, every=10) == brute(rows, every=10)


def test_bounds_drop_candidates(spark):
    """A block far from every query is left after its first dimensions."""
    rng = np.random.default_rng(1)
    queries = rng.integers(90, 110, (8, 64))
    near, far = rng.integers(90, 110, (64, 64)), rng.integers(-3, 3, (64, 500))
    best = topk._Best(8, 5)
    nobody = np.full(8, -1)
    topk._branch_and_bound(queries, nobody, near, best, np.arange(64), np.zeros(64, bool))
    held = best.score.copy()
    topk._branch_and_bound(queries, nobody, far, best, np.arange(500), np.zeros(500, bool))
    assert (best.score == held).all() and len(held) == 40


def test_empty_tables_and_other_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert topk.search(empty).count() == 0
    none = spark.createDataFrame([(1, [1.0], 0), (2, [1.0], 0)], SCHEMA)
    assert topk.search(none).count() == 0
    alone = spark.createDataFrame([(50, [1.0], 0)], SCHEMA)
    assert topk.search(alone).count() == 0
    odd = spark.createDataFrame([(50, [1.0], 7, 1), (3, [2.0], 7, 2)], "vec_id long, embedding array<double>, score int, block int")
    assert [tuple(r) for r in topk.search(odd).collect()] == [(50, 1, 3, 256 * 512)]


def test_vectors_that_take_no_part(spark):
    df = spark.createDataFrame(odd_rows(), SCHEMA)
    kept = {r.vec_id for r in vectors.usable(df, "vec_id", "embedding").collect()}
    assert kept == {300, 350, None, 400, -50}
