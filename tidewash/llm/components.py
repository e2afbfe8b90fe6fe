"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _with_least(pairs: DataFrame) -> DataFrame:
    """``u, v, m``: m is the least of u and its neighbours. A hub's rows are only streamed past
    its single minimum, so the join can be split however many neighbours it has."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    linked = _with_least(down)
    return linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(linked.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``u, v`` edges other than the least of its component.

    Alternates the large-star and small-star steps until nothing changes, about log(diameter)
    rounds; each round's edges are written to the shared folder. Loops are ignored.
    """
    edges, last = staged(edges.where("u <> v").distinct()), None
    while True:
        seen = edges.agg(F.count("*"), F.bit_xor(F.xxhash64(F.greatest("u", "v"), F.least("u", "v")))).first()
        if seen == last or seen[0] == 0:
            return edges.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("root"))
        last, edges = seen, staged(_small_star(_large_star(edges)))
