"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scratch


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Component of every node that has an edge, as (node, component); component is its smallest node.

    Alternating large-star and small-star rounds. Every round shuffles the
    edges twice on a node, takes minima with map-side combining and joins
    them back, so a node that touches a third of all edges is split by the
    skew join instead of being gathered; rounds grow with the logarithm of
    the longest chain. Edges stay distributed and each round is written to
    the shared folder, so lineage stays short.

    Null ends and self-loops are ignored, repeated edges count once, an
    empty edge table gives an empty result.
    """
    e = (
        edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
        .where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    e = scratch.keep(e, "edges")
    before, seen = scratch.path_of(), None
    while True:
        # large star: hang every larger neighbour of u on the least of u and its neighbours
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: hang u and its smaller neighbours on the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = small.union(low.select("u", F.col("m").alias("v"))).distinct()
        e = scratch.keep(out, "edges")
        scratch.forget([before])
        before = scratch.path_of()
        state = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
