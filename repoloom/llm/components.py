"""Connected components of a table of links, by hooking to the least neighbour and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _jump(parents: DataFrame) -> DataFrame:
    """(node, parent) with every parent a root: the distance to the root halves in each round."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        parents = stored(parents.join(up, "parent", "left").select(
            "node", F.coalesce("above", "parent").alias("parent"), (F.col("above") < F.col("parent")).alias("moved")))
        if parents.where("moved").isEmpty():
            return parents.select("node", "parent")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links(a, b): root is the least node that can be reached.

    Each round hooks every node to its least neighbour, flattens the trees and
    contracts them to their roots; only links between different roots go on,
    so the links shrink at least by half of the nodes each round.  All state
    is in tables of the shared folder.  Self links only name a node; null ends
    are left out; no links give no rows.
    """
    links = links.select("a", "b").where("a is not null and b is not null")
    roots = None
    while True:
        both = links.union(links.select("b", "a"))
        parents = _jump(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("parent")))
        if roots is None:
            roots = parents.select("node", F.col("parent").alias("root"))
        else:
            roots = stored(roots.join(parents.withColumnRenamed("node", "root"), "root", "left").select(
                "node", F.coalesce("parent", "root").alias("root")))
        ends = parents.select("node", "parent")
        links = stored(
            links.join(ends.toDF("a", "pa"), "a").join(ends.toDF("b", "pb"), "b")
            .where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        if links.isEmpty():
            return roots
