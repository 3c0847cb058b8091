"""Connected components of an edge table, by DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import cut, drop, spread_join


def _to_least(edges: DataFrame) -> DataFrame:
    """For each u of (u, v), the least of u and all v beside it, as (u, m): sums up before the shuffle, so that no
    neighbourhood is ever gathered."""
    return edges.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("m"))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of the edges; component is the least node that can be reached.

    Alternates large-star and small-star rounds (each linear in the edges, both of them keeping the components), until
    the edges form stars. Each round is written to the shared checkpoint folder, which cuts the lineage, and drops the one before. Nulls and loops
    are ignored; an empty table gives an empty one.
    """
    pair = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    now = cut(pair.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        last = now
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = spread_join(both, _to_least(both), ["u"], "v").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = _to_least(large)
        small = spread_join(large, least, ["u"], "v").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        drop(last)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
