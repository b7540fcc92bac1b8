"""Connected components of a graph given by its edges, distributed over both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.llm.common import cut, release


def _stars(edges: DataFrame) -> DataFrame:
    """One round: every node's larger neighbours move to its smallest one (large star),
    then its smaller neighbours do (small star). Edges are (u, v) with u > v.

    The smallest neighbour of a node is found among its smaller ones, so a root with very
    many leaves is a hot key of a join only, never of a group. Every edge gives one edge.
    """
    least = edges.groupBy(F.col("u").alias("of")).agg(F.min("v").alias("m"))
    large = edges.join(least, F.col("v") == F.col("of"), "left").select(
        "u", F.coalesce("m", "v").alias("v")
    )
    root = large.groupBy(F.col("u").alias("of")).agg(F.min("v").alias("m"))
    small = large.join(root, F.col("u") == F.col("of"))
    is_least = F.col("v") == F.col("m")
    return small.select(F.when(is_least, F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))


def components(edges: DataFrame) -> DataFrame:
    """``id`` and ``component``, the smallest id it is connected to, for every node with an
    edge in ``edges`` (columns ``a`` and ``b``; loops and repeated edges are fine).

    Alternates the two star operations until nothing changes, which takes a number of
    rounds that grows with the logarithm of the graph; each round is written to the
    checkpoint folder. Only two numbers a round reach the driver.
    """
    current = cut(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    before = None
    while True:
        sums = current.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v") % (1 << 40)).alias("s")
        ).first()
        if before == (sums["n"], sums["s"]) or not sums["n"]:
            break
        before = (sums["n"], sums["s"])
        current = cut(_stars(current))
    # What the edges were made from may be far larger than they are. Asked for here and not
    # at once, as listeners still hold a plan that has just run.
    release(current.sparkSession)
    ends = F.array("u", "v")
    return current.select(F.explode(ends).alias("id"), F.col("v").alias("component")).distinct()
