"""Connected components of links, by alternating large-star and small-star steps.

Links stay distributed: a step is a partial aggregate of each node's smallest
neighbour and an equi-join, and its result is checkpointed in partitions that follow the links' number. Up to EDGE_ROWS links
fill one partition, where windows take the place of both and nothing is shuffled: shuffles of few rows in
many partitions burden the driver with tasks that have nothing to do, and TOGETHER rounds of them are one job. The steps halve the
depth of every tree, so that the number of rounds grows with its logarithm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import blocks_for, checkpoint

#: Links that a partition holds, about: few links make few files.
EDGE_ROWS = 50_000
#: Rounds of few links that one job takes.
TOGETHER = 3


def as_one(df: DataFrame) -> DataFrame:
    """A table of few rows as one partition, which is grouped without a shuffle and joined without a broadcast."""
    return df.coalesce(1).hint("merge")


def checkpoint_parts(df: DataFrame, parts: int) -> DataFrame:
    """A checkpoint of so many partitions at most, which by itself would forget that it is one."""
    kept = checkpoint(df, parts)
    return as_one(kept) if parts == 1 else kept


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large(edges: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the least of its neighbours and itself."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node hands its smaller neighbours, and itself, to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _both_together(edges: DataFrame) -> DataFrame:
    """A large and a small step of few edges, in one task."""
    least = F.min("v").over(Window.partitionBy("u"))
    ends = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
    large = edges.select(ends.alias("e")).select("e.u", "e.v").withColumn("m", F.least(least, "u"))
    large = large.where("v > u AND v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    moved = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))
    return large.withColumn("m", least).select(moved.alias("e")).select("e.u", "e.v").where("u > v").distinct()


def components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """links(a, b) to (id, root): every node of a link with the least node that it reaches."""
    few = blocks_for(links.count(), EDGE_ROWS)
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v")
    edges = checkpoint_parts((edges.coalesce(1) if few == 1 else edges).distinct(), few)
    state = _state(edges)
    for _ in range(max_rounds):
        if few == 1:
            for _ in range(TOGETHER):
                edges = _both_together(edges)
            edges = checkpoint_parts(edges, few)
        else:
            edges = checkpoint_parts(_small(_large(edges)), few)
        found = _state(edges)
        if found == state:
            roots = edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
            roots = roots.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
            return as_one(roots) if few == 1 else roots
        state = found
    raise RuntimeError("components did not settle")
