"""Which row of a site list a page belongs to, by the host of its address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

__all__ = ["host_of", "page_sites"]


def host_of(url: Column) -> Column:
    """Host of an absolute address in lower case, without user, port and closing dot; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    host = F.regexp_replace(host, r"\.+$", "")
    return F.when(host != "", host)


def page_sites(pages: DataFrame, report: DataFrame, sites: DataFrame, max_sites: int = 100_000) -> DataFrame:
    """(page_id, site): the site of each page that has one.

    ``report`` gives ``final_url`` by page (rows delivered twice count once). A site fits when it
    is the host or what follows one of the host's dots; of several, the longest. Null and
    unmatched addresses give no row. The site list is broadcast only if it is small.
    """
    from folio.session import broadcast_if_small

    urls = report.where("page_id is not null and final_url is not null").groupBy("page_id").agg(F.min("final_url").alias("final_url"))
    urls = urls.join(pages.select("page_id").where("page_id is not null").distinct(), "page_id", "left_semi")
    parts = F.split(host_of(F.col("final_url")), r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    known = sites.select(F.lower("site").alias("_tail"), "site").where("site is not null").distinct()
    hit = urls.where(parts.isNotNull()).select("page_id", F.explode(tails).alias("_tail")).join(broadcast_if_small(known, max_sites), "_tail")
    return hit.groupBy("page_id").agg(F.max_by("site", F.length("_tail")).alias("site"))
