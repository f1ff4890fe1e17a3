"""Connected components of an edge list by alternating large-star and small-star rounds, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.session import Stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of the edges (u, v: bigint); a component is named by its least node.

    Each round is written to the shared folder, so lineage stays short; rounds grow with the logarithm of the
    longest path. Loops and repeated edges do no harm; no edges give no rows.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()
    kept, state = Stored(e), None
    while True:
        e = kept.df
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # minima are aggregates that start before the exchange, joined to the edges: a node of any degree is no task of its own
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u != v").distinct()
        small = large.join(_least(large), "u")
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u != v").distinct()
        old, kept = kept, Stored(small)
        old.drop()
    stars = kept.df
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))
