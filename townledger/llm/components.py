"""Connected components of links, by alternating star contraction on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townledger.llm.common import shared_dir, stored


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: each node's (larger or smaller) neighbours are hung on the least of its neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    hung = both.join(least, "u")
    if large:
        out = hung.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root for every node with a link (u, v): root is the least node of its component.

    Each step groups with partial sums and joins on nodes, so a node with any number of links is split by the
    adaptive join; each round is written, so a lost executor costs one round. Rounds grow with the logarithm
    of the longest path, and end as soon as all links are stars: each node hangs on one root, which hangs on none.
    """
    spark = links.sparkSession
    folder = shared_dir(spark)
    edges = stored(links.select("u", "v").filter(F.col("u") != F.col("v")).distinct(), f"{folder}/0")
    for i in range(1, max_rounds + 1):
        edges = stored(_stars(_stars(edges, True), False), f"{folder}/{i}")
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("hung"), F.lit(0).alias("root")).union(edges.select("v", F.lit(0), F.lit(1)))
        if not ends.groupBy("node").agg(F.sum("hung").alias("hung"), F.max("root").alias("root")).filter("hung > 1 OR hung = 1 AND root = 1").limit(1).count():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    raise RuntimeError("components have not settled")


def merged(parts: DataFrame, links: DataFrame, path: str) -> DataFrame:
    """parts (node, root) after links (u, v) between nodes, of which some may be in no part yet: only roots are linked anew."""
    roots = parts.select("node", "root")
    for end in "uv":
        links = links.join(roots.withColumnsRenamed({"node": end, "root": f"_{end}"}), end, "left").withColumn(end, F.coalesce(f"_{end}", end)).drop(f"_{end}")
    new = components(links).select(F.col("node").alias("old"), F.col("root").alias("to"))
    moved = parts.join(new, F.col("root") == F.col("old"), "left").select("node", F.coalesce("to", "root").alias("root"))
    fresh = new.join(parts, F.col("old") == F.col("node"), "left_anti").select(F.col("old").alias("node"), F.col("to").alias("root"))
    return stored(moved.union(fresh), path)
