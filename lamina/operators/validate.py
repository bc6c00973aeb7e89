"""Validation and summary of a dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows of ``child`` whose ``key`` has no parent (null keys included)."""
    return child.join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def orphan_counts(documents: DataFrame, passages: DataFrame, queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """relation, n_orphans: rows that refer to an absent document, query or passage."""
    checks = (
        ("passages.doc_id", passages, "doc_id", documents, "doc_id"),
        ("qrels.query_id", qrels, "query_id", queries, "query_id"),
        ("qrels.passage_id", qrels, "passage_id", passages, "passage_id"),
    )
    out = None
    for name, child, key, parent, parent_key in checks:
        row = orphans(child.select(key), key, parent, parent_key).agg(F.count(F.lit(1)).alias("n_orphans")).select(F.lit(name).alias("relation"), "n_orphans")
        out = row if out is None else out.unionByName(row)
    return out


def missing_ids(child: DataFrame, key: str, parent: DataFrame, parent_key: str, sample: int = 3) -> list[str]:
    """The first few distinct missing ids, for messages."""
    rows = orphans(child.select(F.col(key).cast("string").alias(key)).where(F.col(key).isNotNull()), key, parent.select(F.col(parent_key).cast("string").alias(parent_key)), parent_key)
    return [r[0] for r in rows.distinct().orderBy(key).limit(sample).collect()]


def summary(documents: DataFrame, passages: DataFrame, queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """One row of counts; one pass over each table."""
    n = F.count(F.lit(1))
    return qrels.agg(
        documents.agg(n).scalar().alias("documents"),
        passages.agg(n).scalar().alias("passages"),
        queries.agg(n).scalar().alias("queries"),
        n.alias("qrels"),
        F.count_if(F.col("score") > 1).alias("graded_qrels"),
        F.countDistinct(F.when(F.col("score") > 0, F.col("query_id"))).alias("queries_with_relevant_passages"),
    )


def errors(documents: DataFrame, passages: DataFrame, queries: DataFrame, qrels: DataFrame, query_metadata: DataFrame | None = None) -> list[str]:
    """Everything that is wrong with a dataset, as messages; an empty list if nothing is."""
    found: list[str] = []
    tables = (("query", "queries", queries, "query_id"), ("passage", "passages", passages, "passage_id"), ("document", "documents", documents, "doc_id"))
    for one, many, df, key in tables:
        c = F.col(key).cast("string")
        n, distinct, blank = df.agg(F.count(F.lit(1)), F.countDistinct(c), F.count_if(F.coalesce(F.trim(c), F.lit("")) == "")).first()
        if not n:
            found.append(f"no {many}")
        if distinct < n - (blank if blank else 0) or blank > 1:
            found.append(f"duplicate {one} ids")
        if blank:
            found.append(f"empty {one} ids")
    refs = [("passages", "documents", passages, "doc_id", documents, "doc_id"), ("qrels", "queries", qrels, "query_id", queries, "query_id"), ("qrels", "passages", qrels, "passage_id", passages, "passage_id")]
    if query_metadata is not None:
        refs.append(("query metadata", "queries", query_metadata, "query_id", queries, "query_id"))
    for child, parent, *args in refs:
        if ids := missing_ids(*args):
            found.append(f"{child} refer to missing {parent}: {ids}")
    if passages.where("paragraph_no < 0").limit(1).count():
        found.append("negative paragraph numbers")
    if qrels.where("score < 0").limit(1).count():
        found.append("negative judgement scores")
    return found
