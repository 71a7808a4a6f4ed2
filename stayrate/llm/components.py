"""Connected components of a graph given as links, without gathering them anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayrate.llm.native import stored


def components(links: DataFrame) -> DataFrame:
    """``id`` and ``root`` (the smallest id it reaches) for all ids of ``links`` (a, b).

    Each round links every id's larger neighbours to its smallest one (which merges stars),
    then every id to its smallest neighbour; a chain of n ids is done after about log n rounds.
    Every sum is per id with partial aggregation, and the rounds pass stored tables on.
    """
    both = links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    edges = stored(both, "links")
    mark = _mark(edges)
    while True:
        either = edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = either.groupBy(F.col("hi").alias("me")).agg(F.min("lo").alias("low"))
        least = least.select("me", F.least("me", "low").alias("low"))
        # Larger neighbours of each id go to the smallest id around it.
        large = either.where("lo > hi").select(F.col("lo").alias("far"), F.col("hi").alias("me")).join(least, "me")
        stars = large.where("far <> low").select(F.col("far").alias("hi"), F.col("low").alias("lo")).distinct()
        # An id and its smaller neighbours go to the smallest of them.
        below = stars.groupBy("hi").agg(F.min("lo").alias("low"))
        small = stars.join(below, "hi").select(F.explode(F.array("hi", "lo")).alias("hi"), F.col("low").alias("lo"))
        after = stored(small.where("hi <> lo").distinct(), "links")
        before, edges, mark = mark, after, _mark(after)
        if before == mark:
            break
    return edges.select(F.col("hi").alias("id"), F.col("lo").alias("root"))


def _mark(edges: DataFrame):
    """What tells a set of links from another: their number and a sum of their hashes."""
    wide = F.xxhash64("hi", "lo").cast("decimal(38,0)")
    return edges.agg(F.count(F.lit(1)).alias("n"), F.sum(wide).alias("hashes")).first()
