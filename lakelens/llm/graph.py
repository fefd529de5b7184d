"""Connected components of large graphs by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import drop_path, materialize, new_path


def connected_components(edges: DataFrame, tag: str = "components", by: list[str] | None = None) -> DataFrame:
    """node, component (its least node) for every node of edges (a, b). by: columns that tell several graphs apart, which are
    solved together and come back with the result.

    Each step is an aggregation, combined before its shuffle, and a join of edges with their nodes' least neighbours. That
    side is a written table each time, so both sides of the join come straight from a shuffle, and adaptive execution splits the
    partition of a hub, a node of many edges, over several tasks. Edge sets are written after each round. The number of
    rounds grows with the logarithm of the graph.
    """
    spark = edges.sparkSession
    by = by or []
    path = new_path(spark, tag)
    now = materialize(edges.where("a <> b").select(*by, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "", path)
    of = [F.col(c).alias(f"of_{c}") for c in by]
    at = reduce(lambda x, y: x & y, [F.col("u") == F.col("k"), *[F.col(c) == F.col(f"of_{c}") for c in by]])
    counts = [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*by, "u", "v").cast("decimal(38,0)")).alias("h")]
    before, stats = None, now.agg(*counts).first().asDict()
    while stats != before and stats["n"]:
        before = stats
        both = now.unionByName(now.select(*by, F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = new_path(spark, f"{tag}-least")
        least = materialize(both.groupBy(*by, "u").agg(F.min("v").alias("m")).select(*of, F.col("u").alias("k"), F.least("u", "m").alias("m")), "", lowest)
        large = both.where("v > u").join(least.hint("merge"), at).select(*by, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Every edge now goes from a node to a smaller one.
        lower = new_path(spark, f"{tag}-lower")
        low = materialize(large.groupBy(*by, "u").agg(F.min("v").alias("m")).select(*of, F.col("u").alias("k"), "m"), "", lower)
        small = large.join(low.hint("merge"), at)
        pairs = F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        star = small.select(*by, F.explode(pairs).alias("e")).select(*by, "e.u", "e.v").where("u <> v").distinct()
        following = new_path(spark, tag)
        told = Observation()  # counted as it is written
        now = materialize(star.observe(told, *counts), "", following)
        stats = dict(told.get)
        drop_path(spark, path)
        drop_path(spark, lowest)
        drop_path(spark, lower)
        path = following
    leaves, roots = F.col("u").alias("node"), F.col("v").alias("node")
    return now.select(*by, leaves, F.col("v").alias("component")).unionByName(now.select(*by, roots, F.col("v").alias("component")).distinct())
