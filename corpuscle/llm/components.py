"""Connected components of link tables that no machine could hold: alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stage


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """links (a, b: long) -> (node, root): root is the smallest node reachable; nodes that are their own root are left out.

    Self links, repeated links and nulls are allowed (a null end links nothing). Both half steps join the
    edges with one row per node, read from a stage table, so that adaptive execution can split hot nodes.
    """
    edges = stage(
        links.where("a != b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "links"
    )
    state = _state(edges)
    while state[0]:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
        mins = stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "mins")
        large = stage(
            both.join(mins, "u").where("v > u and v != m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct(),
            "large",
        )
        lows = stage(large.groupBy("hi").agg(F.min("lo").alias("m")), "lows")
        joined = large.join(lows, "hi")
        small = joined.where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        step = stage(small.union(lows.select("hi", "m")).distinct(), "small")
        for old in (edges, mins, large, lows):
            release(old)
        edges, before = step, state
        state = _state(edges)
        if state == before:
            break
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
