"""Connected components of a link table, by alternating large and small stars over stored edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


#: Joins run on ids XOR this: Spark then deals out both sides anew, and can split the rows of a hub that many nodes link to, which
#: it can't where one side comes straight from an aggregate.
_KEY = 0x5A5A5A5A5A5A5A5A


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    key = F.col("u").bitwiseXOR(F.lit(_KEY)).alias("_key")
    return edges.select("u", "v", key).join(least.select(key, "m"), "_key")


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours go to the smallest of it and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return _with_least(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours go to the smallest of those; edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = _with_least(edges, least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """All edges lead from a node that has no other to one that is no edge's beginning."""
    return edges.groupBy("u").count().where("count > 1").isEmpty() and edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()


def connected_components(links: DataFrame, folder: str, most_rounds: int = 60) -> DataFrame:
    """id and component, its smallest id, for each end of links(a, b). Each round is stored below folder.

    Stars of stars take logarithmically many rounds; the loop ends when all components are stars.
    """
    edges = common.stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{folder}-0")
    for step in range(1, most_rounds + 1):
        if _settled(edges):
            break
        edges = common.stored(_small_star(_large_star(edges)), f"{folder}-{step}")
    else:
        raise RuntimeError(f"components did not settle within {most_rounds} rounds")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
