"""Navigation over the node table: every step is an equi-join on page and node id, or a look at a row's own path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

__all__ = ["ancestors", "attribute", "children", "closest", "contains", "descendants", "first_wins", "meta_tags", "rendered_text", "text_content"]

_ID = ["page_id", "node_id"]
#: Elements whose text is never shown (fixed values).
UNSHOWN = ("script", "style", "template", "noscript")


def attribute(name: str) -> Column:
    """Value of an attribute without a namespace; null where it is missing."""
    return F.try_element_at(F.col("attr"), F.lit(name))


def children(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """Rows of the children of the nodes in ``of`` (page_id, node_id), to be ordered by ``sib_idx``."""
    return nodes.join(of.select("page_id", F.col("node_id").alias("parent_id")).distinct(), ["page_id", "parent_id"], "left_semi").select(*nodes.columns)


def descendants(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """(ancestor_id and the node's columns) of all nodes below those in ``of``, themselves left out."""
    up = nodes.select(*nodes.columns, F.explode("path").alias("ancestor_id"))
    return up.join(of.select("page_id", F.col("node_id").alias("ancestor_id")).distinct(), ["page_id", "ancestor_id"], "left_semi")


def ancestors(nodes: DataFrame) -> DataFrame:
    """(page_id, node_id, n, ancestor_id, tag): ancestors of every row, nearest first; no join."""
    return nodes.select(*_ID, F.posexplode(F.arrays_zip("path", "path_tags")).alias("n", "a")).select(*_ID, "n", F.col("a.path").alias("ancestor_id"), F.col("a.path_tags").alias("tag"))


def closest(tags: list[str]) -> Column:
    """Id of the row itself or of its nearest ancestor with one of the tags."""
    at = F.filter(F.arrays_zip("path", "path_tags"), lambda a: a["path_tags"].isin(*tags))
    return F.when(F.col("tag").isin(*tags), F.col("node_id")).otherwise(F.try_element_at(at, F.lit(1))["path"])


def contains(a: str = "a", b: str = "b") -> Column:
    """Whether node ``a`` is node ``b`` or above it, by their intervals (of one page)."""
    return (F.col(f"{a}.pre") <= F.col(f"{b}.pre")) & (F.col(f"{b}.post") <= F.col(f"{a}.post"))


def _joined() -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pre", "text"))), lambda x: x["text"]), "")


def text_content(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """(page_id, node_id, text): text below each node in ``of``, pieces in order and not separated; empty where there is none."""
    texts = descendants(nodes.where("node_type = 3"), of).groupBy("page_id", F.col("ancestor_id").alias("node_id")).agg(_joined().alias("text"))
    return of.select(*_ID).distinct().join(texts, _ID, "left").withColumn("text", F.coalesce("text", F.lit("")))


def rendered_text(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """The same without scripts, styles, templates and noscript."""
    shown = nodes.where(~F.arrays_overlap("path_tags", F.array(*map(F.lit, UNSHOWN))))
    return text_content(shown, of)


def first_wins(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """(keys, value): the first value of each key."""
    return rows.groupBy(*keys).agg(F.min_by(value, order).alias(value))


def meta_tags(nodes: DataFrame) -> DataFrame:
    """(page_id, key, content): what meta elements declare under property, name or itemprop; the first that is not blank counts."""
    from folio.functions.text import ascii_lower

    meta = nodes.where("node_type = 1 and tag = 'meta' and fragment_of is null").withColumn("content", attribute("content"))
    meta = meta.where(F.regexp_replace("content", r"[\s\x{85}\p{Z}]+", "") != "")
    keys = F.array_compact(F.array(attribute("property"), attribute("name"), attribute("itemprop")))
    return first_wins(meta.select("page_id", "pre", "content", F.explode(keys).alias("key")).withColumn("key", ascii_lower(F.col("key"))), ["page_id", "key"], "pre", "content")
