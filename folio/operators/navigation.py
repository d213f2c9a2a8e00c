"""Chains of addresses: redirects and refreshes followed for a bounded number of hops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

__all__ = ["follow"]


def follow(starts: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """(start, url, hops, stopped): where each start ends after at most ``hops`` steps.

    ``starts``: (start); ``edges``: (url, target), one target per url. A step to itself or to an address
    already on the chain ends it (``loop``); a chain longer than allowed ends where the hops do (``limit``), others have no further step (``end``).
    Each hop is one equi-join of the chains still open; their number only falls.
    """
    edges = edges.where("url is not null and target is not null").groupBy("url").agg(F.min("target").alias("target"))
    chain = starts.where("start is not null").distinct().select("start", F.col("start").alias("url"), F.array("start").alias("seen"), F.lit(0).alias("hops"), F.lit(None).cast("string").alias("stopped"))
    done = chain.where(F.lit(False))
    for _ in range(hops):
        step = chain.join(edges, "url", "left")
        loop = F.array_contains("seen", F.col("target"))
        ended = step.where(F.col("target").isNull() | loop).withColumn("stopped", F.when(F.col("target").isNull(), "end").otherwise("loop"))
        done = done.unionByName(ended.drop("target"))
        chain = step.where(F.col("target").isNotNull() & ~loop).select("start", F.col("target").alias("url"), F.concat("seen", F.array("target")).alias("seen"), (F.col("hops") + 1).alias("hops"), F.lit(None).cast("string").alias("stopped"))
    last = chain.join(edges, "url", "left").withColumn("stopped", F.when(F.col("target").isNull(), "end").otherwise("limit")).drop("target")
    return done.unionByName(last).select("start", "url", "hops", "stopped")
