"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.plans import scratch


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of (u, v); root is one node of its component, the same for all of it.

    Each round, every node takes its least neighbour as parent, parents are
    followed twice, edges are redrawn between what their ends became, and those
    within one node go. The rounds grow with the logarithm of the longest path,
    and each is a table in the shared folder. Sums and minima are combined before
    the shuffle, so the centre of a star is not a hot key.
    """
    left = scratch.keep(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    labels = None
    while left.limit(1).count():
        ways = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = ways.groupBy("u").agg(F.min("v").alias("p")).select("u", F.least("u", "p").alias("p"))
        up = scratch.keep(_follow(_follow(scratch.keep(up, "parents"), "p"), "p"), "parents")
        labels = up.select(F.col("u").alias("node"), F.col("p").alias("root")) if labels is None else _move(labels, "root", up)
        labels = scratch.keep(labels, "labels")
        left = scratch.keep(_move(_move(left, "u", up), "v", up).where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    if labels is None:
        return left.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return labels


def _move(df: DataFrame, col: str, up: DataFrame) -> DataFrame:
    """df with the parents of what it has in col."""
    to = up.select(F.col("u").alias("_u"), F.col("p").alias("_p"))
    return df.join(to, df[col] == to["_u"], "left").withColumn(col, F.coalesce("_p", col)).drop("_u", "_p")


def _follow(up: DataFrame, col: str) -> DataFrame:
    return _move(up, col, up)
