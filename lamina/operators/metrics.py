"""Retrieval metrics over rankings (groups..., item_id, rank) and judgements
(query_id, item_id, relevance), all queries at once.

``groups`` holds query_id and whatever tells runs apart. nDCG gain is 2^relevance - 1, discount
log2(rank + 1), ideal order over all judged items; 0 without a positive ideal. Recall is the
share of positively judged items among the first k; 0 without any. A query without judgements
scores 0 and counts in every mean.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _gain(relevance: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), relevance) - 1) / F.log2(rank.cast("double") + 1)


def ideal_gain(relevance: DataFrame, k: int) -> DataFrame:
    """query_id, ideal: the gain of the best possible first k."""
    w = Window.partitionBy("query_id").orderBy(F.col("relevance").desc(), "item_id")
    best = relevance.withColumn("place", F.row_number().over(w)).where(F.col("place") <= max(0, k))
    return best.groupBy("query_id").agg(F.sum(_gain(F.col("relevance"), F.col("place"))).alias("ideal"))


def _with_relevance(ranking: DataFrame, relevance: DataFrame, k: int) -> DataFrame:
    return ranking.where(F.col("rank") <= k).join(relevance.select("query_id", "item_id", "relevance"), ["query_id", "item_id"], "left")


def ndcg_at_k(ranking: DataFrame, relevance: DataFrame, k: int, runs: DataFrame, groups: Sequence[str] = ("query_id",), name: str = "ndcg") -> DataFrame:
    """groups..., name: one row for each row of ``runs``."""
    gains = _with_relevance(ranking, relevance, k).groupBy(*groups).agg(F.sum(_gain(F.coalesce("relevance", F.lit(0.0)), F.col("rank"))).alias("dcg"))
    out = runs.select(*groups).join(gains, list(groups), "left").join(ideal_gain(relevance, k), "query_id", "left")
    value = F.when(F.col("ideal") != 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).otherwise(0.0)
    return out.select(*groups, F.coalesce(value, F.lit(0.0)).alias(name))


def recall_at_k(ranking: DataFrame, relevance: DataFrame, k: int, runs: DataFrame, groups: Sequence[str] = ("query_id",), name: str = "recall") -> DataFrame:
    good = relevance.where("relevance > 0")
    all_good = good.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_good"))
    found = ranking.where(F.col("rank") <= k).join(good, ["query_id", "item_id"]).select(*groups, "item_id").distinct()
    found = found.groupBy(*groups).agg(F.count(F.lit(1)).alias("n_found"))
    out = runs.select(*groups).join(found, list(groups), "left").join(all_good, "query_id", "left")
    value = F.coalesce("n_found", F.lit(0)).cast("double") / F.col("n_good")
    return out.select(*groups, F.coalesce(value, F.lit(0.0)).alias(name))


def document_relevance(relevance: DataFrame, passage_documents: DataFrame) -> DataFrame:
    """Highest passage grade of each document, at least 0; unknown passages are skipped.

    ``passage_documents``: item_id (passage), doc_id."""
    rows = relevance.join(passage_documents, "item_id").groupBy("query_id", "doc_id").agg(F.max("relevance").alias("relevance"))
    return rows.select("query_id", F.col("doc_id").alias("item_id"), F.greatest("relevance", F.lit(0.0)).alias("relevance"))


def per_query_metrics(runs: DataFrame, passages: DataFrame, documents: DataFrame, relevance: DataFrame, passage_documents: DataFrame, ndcg_k: int = 10, recall_k: int = 100, document_k: int | None = None, groups: Sequence[str] = ("query_id",)) -> DataFrame:
    """The four metrics of each run and query; column names carry their cutoffs.

    A ``document_k`` of None or 0 means ``recall_k``."""
    groups, doc_k = list(groups), document_k or recall_k
    doc_relevance = document_relevance(relevance, passage_documents)
    parts = [
        ndcg_at_k(passages, relevance, ndcg_k, runs, groups, f"passage_ndcg@{ndcg_k}"),
        recall_at_k(passages, relevance, recall_k, runs, groups, f"passage_recall@{recall_k}"),
        ndcg_at_k(documents, doc_relevance, ndcg_k, runs, groups, f"document_ndcg@{ndcg_k}"),
        recall_at_k(documents, doc_relevance, doc_k, runs, groups, f"document_recall@{doc_k}"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, groups)
    return out


def metric_columns(per_query: DataFrame) -> list[str]:
    return [c for c in per_query.columns if "@" in c or c == "latency_ms"]


def mean_metrics(per_query: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Means over all queries of each run, and ``evaluated_queries``."""
    means = [F.avg(F.col(f"`{c}`")).alias(c) for c in metric_columns(per_query)]
    return per_query.groupBy(*groups).agg(*means, F.count(F.lit(1)).cast("double").alias("evaluated_queries"))


def grouped_metrics(per_query: DataFrame, categories: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Means and number of queries by category; ``categories``: query_id, categories (array).

    A category repeated for a query counts each time; queries without any are left out."""
    each = categories.select("query_id", F.explode("categories").alias("category")).where("category IS NOT NULL")
    rows = per_query.join(each, "query_id")
    means = [F.avg(F.col(f"`{c}`")).alias(c) for c in metric_columns(per_query)]
    return rows.groupBy(*groups, "category").agg(*means, F.count(F.lit(1)).alias("queries"))


def leaderboard(means: DataFrame, by: str, name: str = "experiment") -> DataFrame:
    """Best first, ties by name."""
    return means.orderBy(F.col(f"`{by}`").desc(), F.col(name).asc())
