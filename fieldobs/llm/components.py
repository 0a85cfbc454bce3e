"""Connected components of an edge table by alternating large and small stars.

Every round joins each edge with the smallest neighbour of one end and hangs neighbours on it;
after a logarithmic number of rounds every node hangs on the smallest node of its component.
Both stars turn one edge into one edge, so nothing has to be made distinct on the way. Minima
are pre-aggregated per task, and the joins split hot nodes at run time. Rounds are staged in the
shared folder, so a lost executor repeats one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from fieldobs.llm.common import staged


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a node move to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
    up = edges.select(F.greatest("a", "b").alias("far"), F.least("a", "b").alias("near"))
    return up.join(least, F.col("near") == F.col("node")).select(F.col("far").alias("a"), F.least("near", "low").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node of edges (a, b) with a > b and its smaller neighbours move to the least of these."""
    least = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
    return edges.join(least, F.col("a") == F.col("node")).select(
        F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("low").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """(a, b) to (node, component): the least node reachable, for every node that has an edge to another."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()

    def step(df: DataFrame) -> tuple[DataFrame, tuple]:
        seen = Observation()
        made = staged(df.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")), "edges")
        return made, (seen.get["n"], seen.get["h"])

    now, after = step(down)
    before = None
    while before != after and after[0]:
        before = after
        now, after = step(_small_star(_large_star(now)))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots).distinct()


def joined(first: DataFrame, more: DataFrame) -> DataFrame:
    """Components (node, component) after further edges (a, b), which are first brought to component level."""
    if more.isEmpty():
        return first

    def lift(df: DataFrame, end: str) -> DataFrame:
        known = first.select(F.col("node").alias("of"), F.col("component").alias("up"))
        return df.join(known, F.col(end) == F.col("of"), "left").withColumn(end, F.coalesce("up", end)).drop("of", "up")

    above = components(lift(lift(more, "a"), "b")).select(F.col("node").alias("of"), F.col("component").alias("top"))
    moved = first.join(above, F.col("component") == F.col("of"), "left").select("node", F.coalesce("top", "component").alias("component"))
    # Nodes that the further edges bring in.
    fresh = above.join(first.select("node"), F.col("of") == F.col("node"), "left_anti").select(
        F.col("of").alias("node"), F.col("top").alias("component"))
    return moved.unionByName(fresh).distinct()
