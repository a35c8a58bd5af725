"""Connected components of a graph that is a table of edges, by alternating large-star and small-star steps.

(Kiveris, Lattanzi, Mirrokni, Rastogi, Vassilvitskii: Connected Components in MapReduce and Beyond, 2014.) Each step is
an aggregation of the smallest neighbour and a join; nothing is collected but the number of edges and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectio.llm.common import written

ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum((F.xxhash64("u", "v") % 1_000_000_007).cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable) for each node of edges (u, v), smallest nodes themselves included."""
    edges = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = written(edges, "edges")
    state = _state(edges)
    for _ in range(ROUNDS):
        if not state[0]:
            break
        # large star: every neighbour above u is tied to u's smallest neighbour (or u)
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: u (> v) and its smaller neighbours are tied to the smallest of them
        large = written(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("v", "m").union(least.select(F.col("u").alias("v"), "m")).filter("v <> m")
        edges = written(small.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        state, before = _state(edges), state
        if state == before:
            break
    else:
        raise RuntimeError(f"not connected within {ROUNDS} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
