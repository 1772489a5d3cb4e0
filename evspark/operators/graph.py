"""Graph walks over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evspark.session import written


def reach(edges: DataFrame, roots: DataFrame, src: str = "src", dst: str = "dst", directed: bool = False) -> DataFrame:
    """node and depth of all that can be reached from the roots, breadth first.

    Each step joins the frontier, which only holds nodes not met before, with the edges; what has been
    met is written, so lineage doesn't grow with depth."""
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b"))
    e = written((e if directed else e.union(e.select("b", "a"))).distinct(), "edges")
    met = written(roots.select(F.col(roots.columns[0]).alias("node")).distinct().withColumn("depth", F.lit(0)), "met")
    frontier, depth = met, 0
    while True:
        depth += 1
        found = e.join(frontier.select(F.col("node").alias("a")), "a").select(F.col("b").alias("node")).distinct().join(met, "node", "left_anti")
        frontier = written(found.withColumn("depth", F.lit(depth)), "frontier")
        if not frontier.limit(1).count():
            return met
        met = written(met.unionByName(frontier), "met")


def parents(paths: DataFrame, path: str) -> DataFrame:
    """Each path with the nearest ancestor that is a path of the table, or null."""
    own = paths.select(F.col(path).alias("child")).distinct()
    parts = F.split("child", "/")
    up = own.select("child", F.explode(F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1))).alias("n")).select("child", F.array_join(F.slice(F.split("child", "/"), F.lit(1), F.col("n")), "/").alias("parent"), "n")
    found = up.join(own.select(F.col("child").alias("parent")), "parent").groupBy("child").agg(F.max_by("parent", "n").alias("parent"))
    return own.join(found, "child", "left")
