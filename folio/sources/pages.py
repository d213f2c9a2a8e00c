"""Where pages come from and where records go: address lists, raw files, canned routes, JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.session import broadcast_if_small

__all__ = ["page_list", "raw_files", "route_responses", "scrape_records", "write_records"]

_TRIM = r"^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+$"


def page_list(lines: DataFrame, column: str = "value") -> DataFrame:
    """(url) of a list with one address a line; blank lines and those that begin with ``#`` are left out."""
    url = F.regexp_replace(column, _TRIM, "")
    return lines.select(url.alias("url")).where((F.col("url") != "") & ~F.startswith("url", F.lit("#")))


def raw_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of files as they are."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def route_responses(requests: DataFrame, routes: DataFrame, max_routes: int = 10_000) -> DataFrame:
    """Canned answers: ``requests`` (url and others) with the first route whose pattern the address contains, null where none does.

    Routes (ord, pattern, status, content_type, body) are a test's own: at most ``max_routes``, gathered as one array.
    """
    found = routes.agg(F.array_sort(F.collect_list(F.struct("ord", "pattern", "status", "content_type", "body"))).alias("_routes"))
    if routes.limit(max_routes + 1).count() > max_routes:
        raise ValueError(f"more than {max_routes} routes")
    hit = F.try_element_at(F.filter("_routes", lambda r: F.contains(F.col("url"), r["pattern"])), F.lit(1))
    return requests.join(broadcast_if_small(found, 1)).select(*requests.columns, hit["status"].alias("status"), hit["content_type"].alias("content_type"), hit["body"].alias("body"))


def scrape_records(url: Column, error: Column, **fields: Column) -> Column:
    """One JSON record per address: its fields, or the error alone; every record has the address."""
    good = F.to_json(F.struct(*(c.alias(n) for n, c in sorted(fields.items())), url.alias("url")))
    return F.when(error.isNull(), good).otherwise(F.to_json(F.struct(error.alias("error"), url.alias("url"))))


def write_records(records: DataFrame, path: str) -> None:
    """Records as lines of text, in no order."""
    records.select("record").write.mode("errorifexists").text(path)
