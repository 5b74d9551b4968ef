"""Integer vectors and blocks of them, which the searches over embeddings share.

A component x counts as floor(256 * x). A vector takes no part where it is null, where a
component is null, NaN or infinite, or where its squared length reaches 2^62, beyond which a
product of two vectors may not fit a long. Shorter vectors count as followed by zeros.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEPS = 256.0
#: Squared lengths below this keep every product within a long and every component within an int.
LONGEST = float(2**62)
#: Sums of products below this are exact in a double, whatever their order.
EXACT = float(2**53)


def _scaled(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.lit(STEPS) * x.cast("double"))


def whole_numbers(vector: Column) -> Column:
    """The components as integers, or NULL where the vector takes no part."""
    scaled = _scaled(vector)
    sound = F.forall(scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    length = F.aggregate(scaled, F.lit(0.0), lambda total, x: total + F.floor(x).cast("double") * F.floor(x))
    return F.when(sound & (length < F.lit(LONGEST)), F.transform(scaled, lambda x: F.floor(x).cast("int")))


def usable(df: DataFrame, id_col: str, vector_col: str, **more: str) -> DataFrame:
    """vec_id, ``more`` under their new names and ``parts`` (array<int>) of the rows that take part."""
    rows = df.select(
        F.col(id_col).cast("bigint").alias("vec_id"),
        *[F.col(c).alias(name) for name, c in more.items()],
        whole_numbers(F.col(vector_col)).alias("parts"),
    )
    return rows.filter(F.col("parts").isNotNull())


def matrix(parts: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column as a matrix with one row per vector, zeros behind short ones."""
    if isinstance(parts, pa.ChunkedArray):
        parts = parts.combine_chunks()
    sizes = np.diff(parts.offsets.to_numpy())
    flat = parts.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
    width = int(sizes.max(initial=0))
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int32)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def ids_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Ids with 0 for missing ones, and which ones are missing."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    missing = column.is_null().to_numpy(zero_copy_only=False)
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), missing


def widened(m: np.ndarray, width: int) -> np.ndarray:
    """The rows of ``m`` with zeros up to ``width``."""
    return m if m.shape[1] == width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices of one width."""
    most = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * left.shape[1]
    if most < EXACT:
        return (left.astype(np.float64) @ right.T.astype(np.float64)).astype(np.int64)
    return left.astype(np.int64) @ right.T.astype(np.int64)


def first_per_row(
    row: np.ndarray, score: np.ndarray, ids: np.ndarray, missing: np.ndarray, k: int
) -> np.ndarray:
    """Indices of the first ``k`` entries of each row: higher scores, then smaller ids, missing last."""
    order = np.lexsort((ids, missing, -score, row))
    at = row[order]
    start = np.r_[True, at[1:] != at[:-1]] if len(at) else np.zeros(0, bool)
    place = np.arange(len(at)) - np.flatnonzero(start)[np.cumsum(start) - 1] if len(at) else at
    return order[place < k]


def in_runs(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The rows of a task in runs of ``rows``, the last one shorter."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, rows - n)
            held.append(part)
            n += part.num_rows
            batch = batch.slice(part.num_rows)
            if n == rows:
                yield _joined(held)
                held, n = [], 0
    if n:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
