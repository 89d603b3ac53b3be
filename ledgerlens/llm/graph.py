"""Connected components of links that stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.files import stored


def _content(links: DataFrame):
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """node, label for every node of `links` (a, b) that is not its component's least; label is the least. Large and small stars in
    turn: each step links neighbours to a lesser node, and ends when all are linked to the least."""
    links = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _content(links)
    while True:
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
        large = (both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct())
        lesser = large.groupBy("a").agg(F.min("b").alias("least"))
        small = (large.join(lesser, "a").filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
                 .union(lesser.select("a", F.col("least").alias("b"))).distinct())
        links = stored(small)
        now = _content(links)
        if now == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("label"))
        before = now
