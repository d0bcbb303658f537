"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qiyas.llm.scratch import Scratch

#: Rounds tried; stars need about the square of the logarithm of the longest path, far less than this.
MOST_ROUNDS = 200


def _both(links: DataFrame) -> DataFrame:
    return links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large(links: DataFrame) -> DataFrame:
    """Every node's larger neighbours are linked to the least of the node and its neighbours."""
    both = _both(links)
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(links: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the least of them. Links go from the larger node (a) to the smaller."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node and component (the least node of its component) of every node of links(a, b) but the least ones themselves.

    Each round is a written table, so a lost executor costs one round at most. Nodes that many links share
    are aggregated before they move, and their joins can be split.
    """
    now = scratch.table(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}0")
    before = None
    for k in range(1, MOST_ROUNDS):
        now_large = scratch.table(_large(now), f"{name}{k}large")
        after = scratch.table(_small(now_large), f"{name}{k}")
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(f"{name}{k}large", f"{name}{k - 1}")
        now = after
        if mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = mark
    raise RuntimeError("the components didn't settle")
