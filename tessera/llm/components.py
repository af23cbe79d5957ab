"""Connected components of a link table: large-star / small-star rounds over DataFrames.

Every round is two grouped joins whose rows are at most twice the links; a node
with very many links is no problem, because a round only needs each node's
smallest neighbour, which partial aggregation finds before the shuffle.  Rounds
are cut in the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut


def connected_components(links: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b) but the roots; root is the smallest node reachable."""
    e = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = cut(e)
    for _ in range(rounds):
        # large star: every larger neighbour of a node is linked to the node's smallest neighbour (itself included)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every smaller-or-equal neighbour is linked to the smallest one
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        new = cut(small.where("u <> v").distinct())
        # done when the links are stars: no root has a parent, and no node has two
        moving = new.select("v").distinct().join(new.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
        double = new.groupBy("u").agg(F.count("*").alias("n")).where("n > 1")
        e = new
        if moving.isEmpty() and double.isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
