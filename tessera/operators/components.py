"""Connected components by alternating large-star and small-star, for any orderable node type."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Workspace


def _lows(edges: DataFrame) -> DataFrame:
    """(u, m): the least neighbour of each node, combined before it is shuffled, however many neighbours a hub has."""
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = edges.select("u", "v").filter("v > u").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")).filter("v > u"))
    return low.join(_lows(both), "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lows = _lows(low)
    linked = low.join(lows, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lows.select("u", F.col("m").alias("v")))
    return linked.filter("u > v").distinct()


def components(edges: DataFrame, workspace: Workspace, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) for every node of an edge but the roots; a root is its component's least node.

    Self loops, repeated edges and either direction are fine; null ends are dropped. Each round is
    written to the shared folder, so lineage stays short and a lost executor costs no earlier round.
    The rounds end when an alternation leaves the edge set as it was (count and two hash sums).
    """
    run = f"edges-{uuid.uuid4().hex[:8]}"
    now = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).filter("u <> v")
    now = workspace.keep(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{run}-0")
    mark, step = None, 0
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1000003), F.sum(F.hash("v", "u").cast("bigint"))).first()
        if seen == mark or seen[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark, step = seen, step + 1
        now = workspace.keep(_small_star(_large_star(now)), f"{run}-{step}")
        workspace.drop(f"{run}-{step - 1}")
