"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueweave.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """`node`, `root` (smallest node of its component) for every node of `edges` (`a`, `b`).

    Every round links nodes to smaller ones and halves the depth of the trees;
    the edges of a round are a stored table, so lineage does not grow. Only
    minima are aggregated: no neighbourhood is collected, whatever its size.
    An edge of a node with itself makes the node known.
    """
    own = edges.where("a = b").select(F.col("a").alias("node")).union(
        edges.select("a")).union(edges.select("b")).distinct()
    links = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = _mark(links)
    while True:
        # Large star: all greater neighbours of a node move to its least neighbour.
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("n")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # Small star: a node and its smaller neighbours move to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        small = large.join(least, F.col("a") == F.col("n"))
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(
            least.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct()
        links, before = stored(small, "links"), mark
        mark = _mark(links)
        if mark == before:
            break
    return own.join(links.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select(
        "node", F.coalesce("root", "node").alias("root"))


def _mark(links: DataFrame) -> tuple:
    """Number and checksum of the links: equal ones mean that a round moved nothing."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
