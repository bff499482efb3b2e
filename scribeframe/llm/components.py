"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step is an aggregation and a join on the node; links pass through tables in the shared folder, never through the
driver. Nodes are 64-bit integers; a component's label is its least node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import written


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("m", "a").alias("m"))


def labels(links: DataFrame) -> DataFrame:
    """(node, label) for all nodes of ``links`` (columns a, b: a > b); nulls and loops are left out by the caller. Runs
    until the links repeat, which they do once every node is linked to its component's least node alone."""
    links = written(links.distinct(), "links")
    seen = _state(links)
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = _least(both)
        large = both.where("b > a").join(low, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        low = _least(large)
        small = large.join(low, F.col("a") == F.col("n"))
        kept = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select(F.col("n").alias("a"), F.col("m").alias("b")))
        links = written(kept.where("a > b").distinct(), "links")
        now = _state(links)
        if now == seen:
            break
        seen = now
    roots = links.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).union(roots).groupBy("node").agg(F.min("label").alias("label"))
