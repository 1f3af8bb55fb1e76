"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _with_least(edges: DataFrame) -> DataFrame:
    """edges (u, v) plus m, the least of u and its neighbours; hubs are combined on the map side and split by AQE."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def connected_components(links: DataFrame) -> DataFrame:
    """node, root of every node of links (a, b): root is the least node of its component.

    Rounds grow with the logarithm of the longest chain. Each is written to the shared
    scratch space. Null ends and self-links are ignored; repeated links change nothing.
    """
    a, b = links.columns[:2]
    pairs = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = materialize(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "component-edges")
    seen = None
    while True:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        joined = _with_least(large)
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(joined.select("u", F.col("m").alias("v"))).distinct()
        before, edges = edges, materialize(small, "component-edges")
        discard(before)
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen:
            break
        seen = state
    members = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return members.unionAll(members.select(F.col("root").alias("node"), "root").distinct())
