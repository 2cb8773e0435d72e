"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievekit.llm.common import forget, join_spread, save


def _nearest(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("__n"))


def _with_nearest(pairs: DataFrame, near: DataFrame, total: int) -> DataFrame:
    """u, v, m for each pair; the many pairs of a star's centre are spread over tasks."""
    return join_spread(pairs, near.select("u", "m"), near.select("u", "__n"), ["u"], ["v"], total)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Each node's larger neighbours go to the smallest of its neighbours and itself."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = _nearest(both).withColumn("m", F.least("m", "u"))
    return _with_nearest(both.filter("v > u"), near, 2 * total).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Each node's smaller neighbours and itself go to the smallest."""
    near = _nearest(edges)
    moved = _with_nearest(edges, near, total).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(near.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected(edges: DataFrame, name: str = "links") -> DataFrame:
    """node, component: for every node of the edges (u, v), the smallest node it is connected with.

    Edges may repeat and may stand in either direction; those from a node to itself and those with a null count
    for nothing, so a node that has no others is not in the result.  A round costs a few shuffles of the edges;
    their number grows with the logarithm of the nodes; the edges of a node that has very many are spread over tasks.  Each round is written to the shared folder, and only its
    row count and checksum come to the driver.
    """
    now = save(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    state = _state(now)
    while state[0]:
        after = save(_small_star(_large_star(now, state[0]), state[0]), name)
        before, state = state, _state(after)
        forget(now)
        now = after
        if state == before:
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
