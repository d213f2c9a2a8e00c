"""Analytics of read attempts: classes, error shapes, latencies, deliveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import error_signature

__all__ = ["class_counts", "classify", "dedup_deliveries", "error_counts", "latency", "run_medians", "top_failures"]

#: A page with less visible text than this counts as empty.
EMPTY = 400


def classify(text: Column, browser_text: Column, failed: Column) -> Column:
    """How a read compares with a browser's: refused, both empty, only here, empty, partial (under 60 %) or reads."""
    return (
        F.when(failed, "refused")
        .when((browser_text < EMPTY) & (text < EMPTY), "both empty")
        .when(browser_text < EMPTY, "browser empty, engine has text")
        .when(text < 0.1 * browser_text, "empty")
        .when(text < 0.6 * browser_text, "partial")
        .otherwise("reads")
    )


def dedup_deliveries(reads: DataFrame) -> DataFrame:
    """One row per read, the first to arrive; rows without an id are kept as they are.

    Rows of one read agree but for their arrival, so an aggregate that combines before the shuffle serves; no window.
    """
    others = [c for c in reads.columns if c != "read_id"]
    first = reads.where("read_id is not null").groupBy("read_id").agg(F.min_by(F.struct(*others), "arrived_at").alias("r"))
    return first.select("read_id", "r.*").select(*reads.columns).unionByName(reads.where("read_id is null"))


def class_counts(reads: DataFrame) -> DataFrame:
    """(class, reads, share) of all reads."""
    text, browser = F.coalesce("text", F.lit(0)), F.coalesce("chrome_text", F.lit(0))
    by = reads.groupBy(classify(text, browser, F.col("failure").isNotNull()).alias("class")).agg(F.count("*").alias("reads"))
    return by.withColumn("share", F.round(100.0 * F.col("reads") / F.sum("reads").over(Window.partitionBy()), 1))  # a window over six rows


def error_counts(reads: DataFrame, most: int = 15) -> DataFrame:
    """(signature, reads): shapes of errors by the reads that show them; a report of the ``most`` frequent."""
    shapes = F.array_distinct(F.transform("errors", error_signature))
    return reads.select(F.explode(shapes).alias("signature")).groupBy("signature").agg(F.count("*").alias("reads")).orderBy(F.desc("reads"), "signature").limit(most)


def top_failures(reads: DataFrame, most: int = 8) -> DataFrame:
    """(failure, reads): reasons of refusals, cut at 60 characters; a report of the ``most`` frequent."""
    return reads.where("failure is not null").groupBy(F.substring("failure", 1, 60).alias("failure")).agg(F.count("*").alias("reads")).orderBy(F.desc("reads"), "failure").limit(most)


def latency(reads: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, reads, median_ms, p90_ms) of successful reads: the middle, and the value that stands 90 % of the way up.

    Counts of equal times are aggregated first, so that a group with a third of all rows is ranked by its distinct times.
    """
    times = reads.where("status = 200 and ms is not null and ms > 0").groupBy(*keys, "ms").agg(F.count("*").alias("n"))
    by = Window.partitionBy(*keys).orderBy("ms")
    ranked = times.withColumn("upto", F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))

    def at(rank: Column) -> Column:  # the time of the row with this rank, from 0
        return F.min(F.when(F.col("upto") > rank, F.col("ms")))

    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    return ranked.groupBy(*keys).agg(F.first("total").alias("reads"), ((at(low) + at(high)) / 2).alias("median_ms"), at(F.floor(F.col("total") * 9 / 10)).alias("p90_ms"))


def run_medians(runs: DataFrame, keys: list[str], order: str, value: str, warm_up: int = 1) -> DataFrame:
    """(keys, runs, median): the middle of repeated measurements, the first ``warm_up`` of each left out."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    kept = runs.where(F.col(value).isNotNull()).withColumn("_n", n).where(F.col("_n") > warm_up)
    return kept.groupBy(*keys).agg(F.count("*").alias("runs"), F.median(value).alias("median"))
