"""Connected components of an edge table in a logarithmic number of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root``: for every node of an edge the smallest node that it reaches. Nodes are integers.

    Large and small stars alternate: every node hands its larger neighbours, then its smaller ones, to its smallest
    neighbour, until each component is a star. A node's neighbours are only ever reduced to a minimum and joined to
    it, never gathered, so a hub may hold any share of the edges. Each round is written to shared storage.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    pairs = written(pairs, "edges")
    while True:
        both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = written(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        small = written(small, "edges")
        # Stars: no root hangs on another, and every leaf hangs on one root; one pass over both roles of each node tells.
        roles = small.select(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(
            small.select(F.col("v").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds"))
        )
        mixed = roles.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).filter("hangs > 1 OR hangs + holds > 1")
        if mixed.isEmpty():
            roots = small.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
            return small.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
        pairs = small
