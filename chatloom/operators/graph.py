"""Undirected graphs: connected components labelled by their smallest member."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.session import checkpointed


def _smallest(pairs: DataFrame) -> DataFrame:
    """For each node u: the smallest of u and its neighbours v. Map-side combined, then cut."""
    return checkpointed(pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))


def connected_components(edges: DataFrame, left: str, right: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Alternates two star contractions: every larger neighbour is linked to the
    smallest node of the neighbourhood, then every smaller one. Rounds grow with the
    logarithm of the longest path. Each round joins on freshly exchanged keys, so
    adaptive execution can split a hub. Self loops keep their node; null ends are
    dropped. Raises if max_rounds pass without a fixed point.
    """
    pairs = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).filter("u is not null and v is not null")
    nodes = pairs.select("u").union(pairs.select("v")).groupBy("u").agg(F.lit(1).alias("one")).select("u")
    stars = checkpointed(pairs.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).groupBy("u", "v").agg(F.lit(1).alias("one")).select("u", "v"))
    before = None
    for _ in range(max_rounds):
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_smallest(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = checkpointed(large.filter("u <> v").groupBy("u", "v").agg(F.lit(1).alias("one")).select("u", "v"))
        small = large.join(_smallest(large), "u")
        links = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        stars = checkpointed(links.filter("u <> v").groupBy("u", "v").agg(F.lit(1).alias("one")).select("u", "v"))
        now = stars.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if before == now:
            break
        before = now
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return nodes.join(stars, "u", "left").select(F.col("u").alias("node"), F.coalesce("v", "u").alias("component"))
