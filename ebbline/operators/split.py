"""Deterministic stratified split into test and training rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbline.operators.ranks import order_statistics
from ebbline.settings import SERIES

# Bits of the number that stands for a row.
HASH_BITS = 60


def with_row_hash(df: DataFrame) -> DataFrame:
    """Add ``row_hash``, a 60-bit number from the identity of a row."""
    key = F.concat_ws("|", F.col("date").cast("string"), *[F.col(k) for k in SERIES])
    return df.withColumn(
        "row_hash", F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint")
    )


def _above(cuts: Column) -> Column:
    """How many cut points an amount lies above; equal cut points act as one."""
    return sum((F.col("amount") > cuts[i]).cast("int") for i in range(3))


def stratum(df: DataFrame) -> DataFrame:
    """Cut all rows at the quartiles of the amount: the smallest amounts with a quarter, half
    and three quarters of the rows at or below them, exact at every size."""
    known = df.filter(F.col("amount").isNotNull()).select("amount", F.lit(0).alias("all"))
    ranks: list[int] = []

    def quartiles(sizes: dict) -> list:
        ranks.extend(max(1, math.ceil(sizes.get(0, 0) * q)) for q in (0.25, 0.5, 0.75))
        return [(0, r) for r in ranks] if sizes else []

    found = order_statistics(known, "amount", "all", quartiles)
    cuts = F.array(*[F.lit(found.get((0, r))).cast("double") for r in ranks])
    return df.withColumn("stratum", _above(cuts))


def split(df: DataFrame, share: float) -> DataFrame:
    """Add ``stratum`` and ``is_test``; the ``ceil(share * n)`` rows of each stratum with the
    smallest ``row_hash`` are test data.

    ``df`` is read a few times for counts, so it should be a stored table. The cuts and the four
    thresholds enter as constants, which leaves the placement of the rows alone.
    """
    layered = stratum(df)

    def tested(sizes: dict) -> list:
        return [(s, math.ceil(n * share)) for s, n in sizes.items() if s is not None and n * share > 0]

    found = order_statistics(layered, "row_hash", "stratum", tested, HASH_BITS)
    is_test = F.lit(None).cast("boolean")
    for (s, _), threshold in found.items():
        is_test = F.when(F.col("stratum") == s, F.col("row_hash") <= threshold).otherwise(is_test)
    return layered.withColumn("is_test", is_test).drop("row_hash")


def split_within_series(df: DataFrame, share: float) -> DataFrame:
    """Like :func:`split`, with quartile strata taken inside every series."""
    cuts = F.percentile("amount", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    whole = Window.partitionBy(*SERIES)
    layer = Window.partitionBy(*SERIES, "stratum")
    return (
        df.withColumn("cuts", cuts.over(whole))
        .withColumn("stratum", _above(F.col("cuts")))
        .drop("cuts")
        .withColumn("place", F.row_number().over(layer.orderBy("row_hash")))
        .withColumn(
            "is_test", F.col("place") <= F.ceil(F.count(F.lit(1)).over(layer) * F.lit(share))
        )
        .drop("row_hash", "place")
    )


def split_balance(df: DataFrame, *keys: str) -> DataFrame:
    test_rows = F.sum(F.col("is_test").cast("bigint"))
    rows = F.count(F.lit(1))
    return df.groupBy(*keys, "stratum").agg(
        rows.alias("n_rows"), test_rows.alias("n_test"), (test_rows / rows).alias("test_share")
    )
