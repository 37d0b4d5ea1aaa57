"""Connected components of an edge table by alternating large and small stars; nothing is collected but row counts and sums of hashes.

A node with very many neighbours would be one key of a join. Where a table has edges
enough for that, such hot nodes are counted out first, and what is joined to them is sent to all tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

ROUNDS = 60
#: A node is hot from so many neighbours on, or from as many as leave at most 2 x ``SENT_NODES`` hot nodes. Fewer than ``LOOKED_AT`` edges are not searched for hot nodes.
HOT, SENT_NODES, LOOKED_AT = 1000, 100_000, 20_000


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _hot(around: DataFrame, edges: int) -> DataFrame | None:
    """Nodes (a) with so many rows that they are joined apart; None if there are none."""
    if edges < LOOKED_AT:
        return None
    hot = materialize(around.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > max(HOT, edges // SENT_NODES)).select("a"), "hot")
    return None if hot.isEmpty() else hot


def _beside(around: DataFrame, least: DataFrame, hot: DataFrame | None) -> DataFrame:
    """around joined to least on a; rows of hot nodes stay where they are."""
    if hot is None:
        return around.join(least, "a")
    hot = F.broadcast(hot)  # 2 x SENT_NODES rows at most
    cold = around.join(hot, "a", "left_anti").join(least.join(hot, "a", "left_anti"), "a")
    return cold.unionByName(around.join(F.broadcast(least.join(hot, "a", "left_semi")), "a"))  # one row a hot node


def _star(edges: DataFrame, large: bool, hot: DataFrame | None = None) -> DataFrame:
    """One star step over edges with a > b. Large: the larger neighbours of a node are tied to the smallest of its neighbourhood. Small: the others."""
    around = _both(edges) if large else edges
    least = around.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    joined = _beside(around, least, hot)
    if large:
        return joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
    return joined.select("b", "m").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a > b").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.shiftright(F.xxhash64("a", "b"), 20))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) edges of any comparable ids, in any order and with repeats, to (node, root): root is the smallest node reachable. Nodes without an edge are left out; loops count as no edge."""
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")
    mark = _mark(now)
    for _ in range(ROUNDS):
        if not mark[0]:
            break
        before, middle = now, _star(now, True, _hot(_both(now), mark[0]))
        if mark[0] >= LOOKED_AT:
            middle = materialize(middle, "stars")
        now = materialize(_star(middle, False, _hot(middle, mark[0])), "edges")
        discard(before)
        was, mark = mark, _mark(now)
        if was == mark:
            break
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
