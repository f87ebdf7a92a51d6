"""Distributed connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether every node with an edge (u, v), v < u, has only that one and v has none: then v is its component."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("below")), F.struct(F.col("v").alias("node"), F.lit(0).alias("below"))))
    nodes = edges.select(ends.alias("e")).groupBy("e.node").agg(F.sum("e.below").alias("below"), F.min("e.below").alias("least"))
    return nodes.where("below > 1 or (below > 0 and least = 0)").agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows (node, component) for every node of ``edges`` (u, v); component is the smallest node reached.

    Each round is one job of joins and partial aggregates, written to the shared checkpoint folder; a node with
    very many neighbours only meets its own minimum, so its rows can be split by a skew join.  The loop ends when
    the edges are a forest of stars.  Null ends and loops are ignored; repeated edges count once.
    """
    cur = stage(edges.where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
                .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    for _ in range(max_rounds):
        if _is_star_forest(cur):
            break
        both = cur.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        above = cur.select(F.col("v").alias("u"), F.col("u").alias("v"))
        large = above.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        # the row of the minimum itself links the node, the others link their ends
        small = large.join(low, "u").select(F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"))
        cur = stage(small.distinct(), "cc")
    else:
        if not _is_star_forest(cur):
            raise RuntimeError("components did not settle")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
