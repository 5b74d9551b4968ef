"""Exact order statistics without sorting: a radix select over order-preserving bits."""

from __future__ import annotations

import math
import struct
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bits that a pass decides. A pass brings at most 2^12 counts per wanted rank to the driver,
# whatever the number of rows, and 64 bits need six passes for any distribution.
DIGIT = 12
BITS = 64

Wanted = tuple[object, int]
#: The ranks to find, from the number of values of each group.
Ranks = Callable[[dict], list[Wanted]]


def sortable(x: Column) -> Column:
    """A finite double as a long that sorts like it; equal doubles, both zeros too, give one long.

    Exponent and fraction are taken apart by powers of two, which is exact: the fraction of a
    number of exponent e is x / 2^e - 1, and numbers below the least normal one are multiples
    of 2^-1074.
    """
    size = F.abs(x)
    near = F.floor(F.log2(F.greatest(size, F.lit(2.0**-1022)))).cast("int")
    power = lambda e: F.pow(F.lit(2.0), e)
    # the logarithm may be off by one next to a power of two, and 2^1024 is no double
    low = F.when(size < power(near), near - 1).otherwise(F.least(near, F.lit(1023)))
    exponent = F.when((low < 1023) & (size >= power(F.least(low + 1, F.lit(1023)))), low + 1).otherwise(low)
    fraction = (size * power(-exponent) - 1) * 2.0**52
    normal = (exponent + 1023).cast("bigint") * (1 << 52) + fraction.cast("bigint")
    tiny = (size * 2.0**537 * 2.0**537).cast("bigint")
    code = F.when(size < 2.0**-1022, tiny).otherwise(normal)
    return F.when(x < 0, -code).otherwise(code)


def unsortable(code: int) -> float:
    """The double of a code."""
    (size,) = struct.unpack("<d", struct.pack("<q", abs(code)))
    return math.copysign(size, code) if code else 0.0


def order_statistics(
    df: DataFrame, value: str, group: str, wanted: Ranks | list[Wanted], bits: int = BITS
) -> dict[Wanted, float | int]:
    """For each (group, rank) the rank-th smallest value of the group, counted from 1.

    The first pass counts all values by their highest bits and so tells how many each group has,
    from which ``wanted`` may choose its ranks. Every further pass counts the next bits of the
    values that share the bits found so far, for all ranks at once, with partial sums before the
    shuffle. A rank is found when its count holds one value only, after six passes at the latest.
    Values are finite numbers without nulls; integers below 2^``bits`` - with a smaller number
    than 64, none negative - need fewer passes.
    """
    whole = isinstance(df.schema[value].dataType, T.IntegralType)
    code = F.col(value).cast("bigint") if whole else sortable(F.col(value))
    # the codes are worked out once; lost ones are worked out again
    rows = df.select(F.col(group).alias("g"), code.alias("code")).persist()
    try:
        return _select(rows, wanted, bits - DIGIT, (lambda c: c) if whole else unsortable)
    finally:
        rows.unpersist()


def _select(rows: DataFrame, wanted: Ranks | list[Wanted], shift: int, back: Callable) -> dict[Wanted, float | int]:
    counts: dict[tuple, list] = {}
    for r in _counted(rows.withColumn("prefix", F.lit(0)), shift).collect():
        counts.setdefault((r.g, 0), []).append((r.digit, r.n, r.low, r.high))
    sizes = {g: sum(n for _, n, _, _ in of) for (g, _), of in counts.items()}
    open_ = {w: (w[1], 0) for w in (wanted(sizes) if callable(wanted) else wanted)}
    found: dict[Wanted, float | int] = {}
    while open_:
        for w, (rank, prefix) in list(open_.items()):
            for digit, n, low, high in sorted(counts[w[0], prefix]):
                if rank <= n:
                    break
                rank -= n
            open_[w] = (rank, digit)
            if low == high:
                found[w] = back(low)
                del open_[w]
        if not open_:
            break
        # digits count from the highest bit on, so a digit is the prefix of the next ones
        prefixes = sorted({(w[0], prefix) for w, (_, prefix) in open_.items()}, key=repr)
        inside = F.lit(False)
        for g, prefix in prefixes:
            inside = inside | (F.col("g").eqNullSafe(F.lit(g)) & (F.col("prefix") == F.lit(prefix)))
        below, shift = shift, max(0, shift - DIGIT)
        some = rows.withColumn("prefix", F.shiftright("code", below)).filter(inside)
        counts = {}
        for r in _counted(some, shift).collect():
            counts.setdefault((r.g, r.prefix), []).append((r.digit, r.n, r.low, r.high))
    return found


def _counted(rows: DataFrame, shift: int) -> DataFrame:
    return rows.groupBy("g", "prefix", F.shiftright("code", shift).alias("digit")).agg(
        F.count(F.lit(1)).alias("n"), F.min("code").alias("low"), F.max("code").alias("high")
    )
