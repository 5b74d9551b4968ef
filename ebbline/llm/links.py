"""Connected components of links between ids, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbline.llm.common import stored


def _mark(edges: DataFrame) -> tuple:
    return edges.agg(
        F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))
    ).first()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node moves to the smallest node around it."""
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every neighbour below a node, and the node, moves to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """(id, root) for every id that a link (a, b) names: root is the smallest id it reaches.

    Links may repeat and point either way; links with a null or to itself count as none. A node
    with very many links is a large group of a partial minimum and of a splittable join only.
    Every round is written, so lineage stays short.
    """
    edges = stored(links.select("a", "b").filter("a <> b").distinct(), "links")
    seen = _mark(edges)
    while True:
        edges = stored(_small_star(_large_star(edges).filter("a <> b").distinct()).distinct(), "links")
        now = _mark(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()
    )
