"""Queries of the training-data operators; ``__spark_entry__`` adds them if this package is there."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import contamination, garbled, mainbody, near_duplicates, packing, repeated_lines, residue, subjects
from folio.llm.oracles import oracle_sql
from folio.operators.sites import page_sites
from folio.session import broadcast_if_small, prepare, stage, table

__all__ = ["oracle_sql", "queries"]


def _page_sites(spark: SparkSession, d: str) -> DataFrame:
    return page_sites(table(spark, d, "pages"), table(spark, d, "render_report"), table(spark, d, "sites"))


def _p1(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    prepare(spark)
    own = repeated_lines.with_sources(repeated_lines.line_table(table(spark, d, "pages")), _page_sites(spark, d))
    return own, repeated_lines.excessive_chunks(own)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines that return on too many pages of their site."""
    return repeated_lines.repeated_lines(*_p1(spark, d)).select("page_id", F.col("head").alias("line_head")).distinct()


def p1_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Each page's visible text without the chunks that are repeated on too many pages of its site."""
    return repeated_lines.cut_repeated(table(spark, d, "pages"), *_p1(spark, d))


def p1_documents(spark: SparkSession, d: str) -> DataFrame:
    """The same for the lines of documents and their sources."""
    prepare(spark)
    documents = table(spark, d, "documents").select(F.col("doc_id").cast("bigint").alias("page_id"), "text", F.col("source").alias("site"))
    own = repeated_lines.with_sources(repeated_lines.line_table(documents, markup=False, text_col="text"), documents.select("page_id", "site"))
    return repeated_lines.repeated_lines(own, repeated_lines.excessive_chunks(own)).select(F.col("page_id").alias("doc_id"), F.col("head").alias("line_head")).distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Visible lines of each page's main body; pages of p6_found have none."""
    prepare(spark)
    heads = lambda lines: (list(dict.fromkeys(x[:60] for x in lines)),) if lines else None
    evidence = stage(residue.evidence_table(table(spark, d, "pages"), ("heads array<string>", [pa.list_(pa.string())], heads)), "bodies")
    lines = evidence.where("heads is not null").select("page_id", F.explode("heads").alias("line_head"))
    return lines.join(broadcast_if_small(residue.residue_pages(evidence), 1_000_000), "page_id", "left_anti").distinct()


def p2_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Each page's main body as laid-out text."""
    prepare(spark)
    return mainbody.main_bodies(table(spark, d, "pages"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Responses with a passage that was decoded with a wrong charset."""
    prepare(spark)
    return garbled.find_garbled(table(spark, d, "responses"))


def p4_restored(spark: SparkSession, d: str) -> DataFrame:
    """Those responses with their text as far as it can be restored."""
    prepare(spark)
    return garbled.restore_text(table(spark, d, "responses")).distinct()


def _p5(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    prepare(spark)
    sql, types, values = near_duplicates.shingle_columns(3)
    evidence = stage(residue.evidence_table(table(spark, d, "pages"), (sql, types, values)), "sets")
    sets = evidence.where("tokens is not null").select(F.col("page_id").alias("id"), "n", "whole", "tokens")
    whole = sets.join(broadcast_if_small(residue.residue_pages(evidence).withColumnRenamed("page_id", "id"), 1_000_000), "id", "left_anti")
    return near_duplicates.similar_pairs(whole, 0.6, folded=True)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of pages whose main bodies share at least 0.6 of their runs of three words."""
    pairs, members = _p5(spark, d)
    return near_duplicates.expand_pairs(pairs, members).distinct()


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each page's class of equal main bodies (the least page of it) and the number of other classes that are similar to it."""
    pairs, members = _p5(spark, d)
    return near_duplicates.classes(pairs, members).select(F.col("id").alias("page_id"), "rep", "links").distinct()


def p5_documents(spark: SparkSession, d: str) -> DataFrame:
    """Each document's class of equal texts and its links at a similarity of 0.8 of runs of five words (whole texts, line by line)."""
    prepare(spark)
    documents = table(spark, d, "documents").select(F.col("doc_id").cast("bigint"), "text")
    sets = near_duplicates.shingle_table(documents, lambda text: (text or "").split("\n"), 5)
    pairs, members = near_duplicates.similar_pairs(sets, 0.8)
    return near_duplicates.classes(pairs, members).select(F.col("id").alias("doc_id"), "rep", "links").distinct()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Pages that show residue, filler, errors or calls for scripts instead of an article."""
    prepare(spark)
    return residue.find_residue(table(spark, d, "pages"))


def p6_messages(spark: SparkSession, d: str) -> DataFrame:
    """Masked messages by kind, with the number of pages and sources that show them."""
    prepare(spark)
    found = residue.residue_messages(residue.evidence_table(table(spark, d, "pages")))
    return found.where("kind is not null or recurring").select(F.col("text").alias("message"), "kind", "pages", "sources", "recurring")


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of every document with its container, for each capacity."""
    prepare(spark)
    kinds = [(r.container_kind, r.capacity) for r in table(spark, d, "containers").select("container_kind", "capacity").orderBy("capacity").collect()]  # three rows
    return packing.pack(packing.count_tokens(table(spark, d, "documents")), kinds)


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers and share of their room that is used, for each capacity."""
    packed = p7_packed(spark, d)
    by = packed.groupBy("container_kind", "capacity", "container").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("pieces"))
    return by.groupBy("container_kind", "capacity").agg(F.count("*").alias("containers"), F.sum("pieces").alias("pieces"), F.round(F.sum("used") / (F.count("*") * F.first("capacity")), 6).alias("filled"), F.max("used").alias("most_used"))


def _p8(spark: SparkSession, d: str) -> DataFrame:
    prepare(spark)
    return contamination.leaks(contamination.leak_windows(table(spark, d, "documents"), table(spark, d, "benchmark")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that share 13 successive words with a test item."""
    return _p8(spark, d).where("literal > 0").select("doc_id", "item_id")


def p8_templates(spark: SparkSession, d: str) -> DataFrame:
    """Documents with literal or re-parameterised windows of a test item, or the whole of a short one."""
    return _p8(spark, d).where("literal > 0 or changed > 0 or short > 0").select("doc_id", "item_id", "literal", "changed", "short")


def _p9(spark: SparkSession, d: str):
    prepare(spark)
    documents = table(spark, d, "documents")
    names = [r.subject for r in table(spark, d, "subjects").select("subject").where("subject is not null").distinct().collect()]  # a fixed list
    return documents, subjects.fit(subjects.fit_sample(documents, table(spark, d, "labels")), names)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """The subject areas of each document."""
    documents, model = _p9(spark, d)
    return subjects.assign(documents, model).select("doc_id", "subject").distinct()


def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents and share of the corpus by subject."""
    documents, model = _p9(spark, d)
    by = subjects.assign(documents, model).groupBy("subject").agg(F.countDistinct("doc_id").alias("documents"), F.round(F.sum("share"), 2).alias("whole_documents"))
    return by


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_cleaned, p1_documents, p2_found, p2_bodies, p4_found, p4_restored, p5_found, p5_classes, p5_documents, p6_found, p6_messages, p7_packed, p7_fill, p8_found, p8_templates, p9_found, p9_composition)}
