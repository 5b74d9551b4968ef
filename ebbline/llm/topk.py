"""Exact top-k search by columnar branch-and-bound.

Candidates lie in blocks in vertical layout: one run of values per dimension. A block is
scored against a batch of queries some dimensions at a time. What the remaining dimensions can
still add is at most the product of the remaining lengths of both vectors, so candidates that
cannot reach any query's k-th best score leave the block, which is compacted before the next
dimensions are read. Integer scores are exact; the bounds carry a margin for rounding.

Queries grow with the data, so neither side is broadcast: groups of queries meet chunks of
blocks in the cells of a grid, each of bounded size, and the best of each cell are merged.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbline.llm.common import stored
from ebbline.llm.vectors import EXACT, first_per_row, ids_of, in_runs, matrix, products, usable

#: Values of one block, of the queries of a group and of the blocks of a chunk; tasks hold one cell.
BLOCK_VALUES = 1 << 16
GROUP_VALUES = 1 << 20
CHUNK_VALUES = 1 << 22
#: Dimensions that are added between two looks at the bounds.
STRIDE = 16
#: Queries that share a pass over a block.
BATCH = 256

BLOCK = "n int, dims int, ids array<bigint>, columns binary"
FOUND = "q_block bigint, q_place int, query_id bigint, vec_id bigint, score bigint"


def _pack(rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_runs(batches, rows):
            values = matrix(part.column("parts"))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part.num_rows], pa.int32()),
                    pa.array([values.shape[1]], pa.int32()),
                    pa.array([part.column("vec_id").to_pylist()], pa.list_(pa.int64())),
                    pa.array([np.ascontiguousarray(values.T).tobytes()], pa.binary()),
                ],
                names=["n", "dims", "ids", "columns"],
            )

    return run


def vertical_blocks(rows: DataFrame, dims: int) -> DataFrame:
    """One row per block: block, n, dims, ids and ``columns``, the components by dimension."""
    size = max(16, BLOCK_VALUES // max(dims, 1))
    packed = rows.select("vec_id", "parts").mapInArrow(_pack(size), BLOCK)
    return stored(packed.select(F.monotonically_increasing_id().alias("block"), "*"), "topk-blocks")


def _block_values(columns: bytes, n: int, dims: int) -> np.ndarray:
    """dims x n integers."""
    return np.frombuffer(columns, np.int32).reshape(dims, n)


def _queries_of(every: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                place = [p for p, i in enumerate(row["ids"]) if i is not None and i % every == 0]
                if not place:
                    continue
                values = _block_values(row["columns"], row["n"], row["dims"])[:, place].T
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["block"]] * len(place), pa.int64()),
                        pa.array(place, pa.int32()),
                        pa.array([row["ids"][p] for p in place], pa.int64()),
                        pa.array(values.tolist(), pa.list_(pa.int32())),
                    ],
                    names=["q_block", "q_place", "query_id", "parts"],
                )

    return run


class _Best:
    """The best k candidates so far of each query of a batch."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.row = np.zeros(0, np.int64)
        self.score = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int64)
        self.missing = np.zeros(0, bool)
        self.least = np.full(n, -np.inf)

    def add(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        row, score = np.r_[self.row, row], np.r_[self.score, score]
        ids, missing = np.r_[self.ids, ids], np.r_[self.missing, missing]
        keep = first_per_row(row, score, ids, missing, self.k)
        self.row, self.score, self.ids, self.missing = row[keep], score[keep], ids[keep], missing[keep]
        full = np.bincount(self.row, minlength=len(self.least)) == self.k
        low = np.full(len(self.least), np.inf)
        np.minimum.at(low, self.row, self.score.astype(np.float64))
        self.least = np.where(full, low, -np.inf)


def _branch_and_bound(queries: np.ndarray, own: np.ndarray, block: np.ndarray, best: _Best, ids, missing) -> None:
    """Adds the candidates of a block (dims x n) that may be among the best of a query.

    ``own`` is each query's place in the block, -1 where it lies in another.
    """
    dims = max(queries.shape[1], block.shape[0])
    q = np.zeros((len(queries), dims))
    q[:, : queries.shape[1]] = queries
    x = np.zeros((dims, block.shape[1]))
    x[: block.shape[0]] = block
    # dimensions with most of the queries' mass come first, so that little remains early
    order = np.argsort(-(q * q).sum(0), kind="stable")
    q, x = q[:, order], x[order]
    q_left, x_left = (q * q).sum(1), (x * x).sum(0)
    largest = np.sqrt(q_left.max(initial=0.0)) * np.sqrt(x_left.max(initial=0.0))
    margin = 1e-9 * largest + 1.0
    rows, at = np.arange(len(q)), np.arange(block.shape[1])
    so_far = np.zeros((len(q), len(at)))
    alive = np.ones((len(q), len(at)), bool)
    inside = np.flatnonzero(own >= 0)
    alive[inside, own[inside]] = False
    for low in range(0, dims, STRIDE):
        part = slice(low, low + STRIDE)
        so_far += q[rows, part] @ x[part][:, at]
        q_left[rows] -= (q[rows, part] ** 2).sum(1)
        x_left[at] -= (x[part][:, at] ** 2).sum(0)
        reach = np.sqrt(np.maximum(q_left[rows], 0.0))[:, None] * np.sqrt(np.maximum(x_left[at], 0.0))[None, :]
        alive &= so_far + reach + margin >= best.least[rows][:, None]
        some_rows, some = alive.any(1), alive.any(0)
        if not some.all() or not some_rows.all():
            so_far, alive = so_far[some_rows][:, some], alive[some_rows][:, some]
            rows, at = rows[some_rows], at[some]
        if not len(at):
            return
    if len(at) > best.k:
        # no candidate below the k-th best of this block alone can stay; ties do
        shown = np.where(alive, so_far, -np.inf)
        level = -np.partition(-shown, best.k - 1, axis=1)[:, best.k - 1]
        alive &= shown + margin >= level[:, None]
    r, c = np.nonzero(alive)
    if largest < EXACT:  # so is every partial sum
        score = so_far[r, c].astype(np.int64)
    else:
        score = np.concatenate(
            [np.zeros(0, np.int64)]
            + [products(queries[[i]], _like(block, queries)[:, at[c[r == j]]].T)[0] for j, i in enumerate(rows)]
        )
    best.add(rows[r], score, ids[at[c]], missing[at[c]])


def _like(block: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """The block with as many dimensions as the queries; more of either meet zeros."""
    short = queries.shape[1] - block.shape[0]
    return np.pad(block, ((0, short), (0, 0))) if short > 0 else block[: queries.shape[1]]


def _cell(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(queries: pa.Table, blocks: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = []
        values = matrix(queries.column("parts"))
        q_block, q_place, q_id = (queries.column(c).to_numpy() for c in ("q_block", "q_place", "query_id"))
        opened = [
            (b["block"], _block_values(b["columns"], b["n"], b["dims"]), *ids_of(pa.array(b["ids"], pa.int64())))
            for b in blocks.select(["block", "n", "dims", "ids", "columns"]).to_pylist()
        ]
        for low in range(0, len(values), BATCH):
            some = slice(low, low + BATCH)
            best = _Best(len(values[some]), k)
            for number, block, ids, missing in opened:
                own = np.where(q_block[some] == number, q_place[some], -1)
                _branch_and_bound(values[some], own, block, best, ids, missing)
            at = best.row + low
            out.append([q_block[at], q_place[at], q_id[at], best.ids, best.score, best.missing])
        merged = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 6
        return pa.table(
            {
                "q_block": pa.array(merged[0], pa.int64()),
                "q_place": pa.array(merged[1], pa.int32()),
                "query_id": pa.array(merged[2], pa.int64()),
                "vec_id": pa.array(merged[3], pa.int64(), mask=merged[5].astype(bool)),
                "score": pa.array(merged[4], pa.int64()),
            }
        )

    return run


def _numbers(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def search(
    embeddings: DataFrame,
    k: int = 5,
    every: int = 50,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows with the highest inner product to each query.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows but the
    query's own, compared as integers (see ``vectors``, which also says what takes no part). Ties
    go to the smaller id. Rows without an id are candidates, last among equals, and no queries.
    Rows that share an id are rows of their own: each is a query, and a candidate to the other.
    Fewer than ``k`` other rows give fewer ranks; an empty table, or one without queries, gives an
    empty one. Other columns are not carried.
    """
    rows = usable(embeddings, id_col, vector_col)
    spark = embeddings.sparkSession
    dims = rows.agg(F.max(F.size("parts"))).first()[0] or 0
    blocks = vertical_blocks(rows, dims)
    queries = stored(
        blocks.mapInArrow(_queries_of(every), "q_block bigint, q_place int, query_id bigint, parts array<int>"),
        "topk-queries",
    )
    held = blocks.agg(F.count(F.lit(1)), F.sum("n")).first()
    asked = queries.count()
    groups = max(1, math.ceil(asked * max(dims, 1) / GROUP_VALUES))
    spread = max(1, 2 * spark.sparkContext.defaultParallelism // groups)
    chunks = max(1, math.ceil((held[1] or 0) * max(dims, 1) / CHUNK_VALUES), min(held[0], spread))
    place = lambda c, n, other: F.pmod(F.xxhash64(c), F.lit(n)).cast("int").alias(other)
    left = queries.select("*", place("q_block", groups, "g"), _numbers(chunks).alias("c"))
    right = blocks.select("*", place("block", chunks, "c"), _numbers(groups).alias("g"))
    found = left.groupBy("g", "c").cogroup(right.groupBy("g", "c")).applyInArrow(_cell(k), FOUND)
    by_query = Window.partitionBy("q_block", "q_place").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return (
        found.withColumn("rank", F.row_number().over(by_query))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
