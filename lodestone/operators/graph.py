"""Relations between files: verified edges and bounded expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def call_verified(edges: DataFrame, calls: DataFrame, defs: DataFrame) -> DataFrame:
    """edges(src, dst) where src calls a name that dst defines. calls(path, name), defs(path, name)."""
    c = calls.select(F.col("path").alias("src"), "name").distinct()
    d = defs.select(F.col("path").alias("dst"), "name").distinct()
    named = edges.select("src", "dst").distinct().join(c, "src")
    return named.join(d, ["dst", "name"], "left_semi").select("src", "dst").distinct()


def bounded_bfs(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(node, depth) of the nodes within `depth` undirected steps of start(node)."""
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("dst", "src")).distinct()
    seen = start.select("node").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for d in range(1, depth + 1):
        step = frontier.select(F.col("node").alias("a")).join(both, "a").select(F.col("b").alias("node")).distinct()
        frontier = step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(d))
        seen = seen.union(frontier)
    return seen
