"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from defectflow.session import write_and_reread


def components(links: DataFrame) -> DataFrame:
    """``node, component_id``: the smallest node reachable, for every node of a link ``a, b``.

    Every round points nodes at the smallest of their neighbours (large star,
    then small star), which keeps components and ends in stars, after a number of
    rounds that grows with the logarithm of the size. Each half round is one
    minimum per node with partial aggregates and one plain join of written tables,
    so that a node with very many links is split by adaptive execution. Nothing
    but two sums for the test of the end reaches the driver.
    """
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = write_and_reread(pairs, "links")
    state = _state(pairs)
    while state[0]:
        pairs = _star(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))), large=True)
        pairs = _star(pairs, large=False)
        before, state = state, _state(pairs)
        if state == before:
            break
    stars = pairs.select(F.col("u").alias("node"), F.col("v").alias("component_id"))
    return stars.unionByName(stars.select(F.col("component_id").alias("node"), "component_id").distinct())


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """Point the larger (all lower) neighbours of every node, and itself, at the smallest of them."""
    least = write_and_reread(
        pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "links-least"
    )
    met = pairs.join(least, "u")
    if large:
        moved = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = met.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(
            least.select("u", F.col("m").alias("v")).where("u <> v")
        )
    return write_and_reread(moved.distinct(), "links")


def _state(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
