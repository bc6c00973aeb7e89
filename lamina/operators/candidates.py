"""From ranked documents to candidate passages, and what is known about them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def expand_to_passages(documents: DataFrame, passages: DataFrame, groups: Sequence[str] = ("query_id",)) -> DataFrame:
    """groups..., item_id (passage), doc_id, doc_rank, pos: the passages of ranked documents.

    Documents without passages vanish; a document ranked twice counts once, at its best rank. Rankings
    outgrow the passages with the queries, so neither side is repeated over salts: adaptive execution
    splits the tasks of documents with most passages or queries."""
    best = documents.groupBy(*groups, F.col("item_id").alias("doc_id")).agg(F.min("rank").alias("doc_rank"))
    own = passages.select("doc_id", F.col("passage_id").alias("item_id"), "pos")
    return own.join(best, "doc_id").select(*groups, "item_id", "doc_id", "doc_rank", "pos")


def candidate_order(candidates: DataFrame, groups: Sequence[str] = ("query_id",), by_document: bool = True) -> DataFrame:
    """Adds ``place``: by document rank, then position; or by position alone."""
    by = [F.col("doc_rank"), F.col("pos")] if by_document else [F.col("pos")]
    return candidates.withColumn("place", F.row_number().over(Window.partitionBy(*groups).orderBy(*by, "item_id")))


def restrict(items: DataFrame, candidates: DataFrame, item: str = "item_id") -> DataFrame:
    """Items that are candidates of any query (semi-join, each once)."""
    return items.join(candidates.select(item).distinct(), item, "left_semi")


def candidate_union(candidates: DataFrame) -> DataFrame:
    """Distinct candidate items of all queries and methods."""
    return candidates.select("item_id").distinct()


def candidate_audit(candidates: DataFrame, n_passages: DataFrame, by: str = "document_method") -> DataFrame:
    """One row a method and one (``all``) for the union: distinct documents, distinct passages and
    the share of all passages (``n_passages``: one row and column) that need not be read, in %."""
    each = candidates.select(by, "doc_id", "item_id")
    both = each.unionByName(each.withColumn(by, F.lit("all")))
    counts = both.groupBy(by).agg(F.countDistinct("doc_id").alias("candidate_documents"), F.countDistinct("item_id").alias("candidate_passages"))
    total = F.greatest(F.lit(1), n_passages.scalar().cast("bigint")).cast("double")
    return counts.withColumn("reduction_percent", F.lit(100.0) * (1 - F.col("candidate_passages") / total))
