"""Connected components of a graph whose edges stay distributed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, shared_path, written


def components(edges: DataFrame, folder: str | None = None) -> DataFrame:
    """node, root (the smallest node of its component) for each node of edges(a, b); loops alone are no nodes.

    Rounds of large stars and small stars: each node tells its larger, then its smaller neighbours of the smallest
    that it knows, until the edges are stars, whatever the number of rounds (it grows with the logarithm of the nodes). The
    edge list never grows beyond its first length plus the nodes, and each round is written to the shared
    folder, so no lineage builds up; the last round stays below `folder`, for the caller to remove. An empty table gives an
    empty result.
    """
    spark = edges.sparkSession
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    path, folder = None, folder or shared_path(spark, "components")
    # Each round has at most as many edges as the first plus its nodes, of which each edge has two.
    most_rows = 3 * edges.count()
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u and v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(least.filter("u <> m").select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(lower.select("a", F.col("m").alias("b"))).distinct()
        there = f"{folder}/stars-{uuid.uuid4().hex}"
        now = written(small, there, most_rows=most_rows)
        if path:
            remove(spark, path)
        path = there
        # Stars: no node has two centres, and no centre has one.
        seen = now.select(F.col("a").alias("node"), F.lit(1).alias("centres"), F.lit(0).alias("is_centre"))
        seen = seen.unionByName(now.select(F.col("b").alias("node"), F.lit(0).alias("centres"), F.lit(1).alias("is_centre")))
        seen = seen.groupBy("node").agg(F.sum("centres").alias("centres"), F.max("is_centre").alias("is_centre"))
        if seen.filter("centres > 1 or centres = 1 and is_centre = 1").isEmpty():
            break
    roots = now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
