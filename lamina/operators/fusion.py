"""Fusion of rankings. A ranking has query_id (or other group columns), item_id, score, rank.

Rankings are stacked, not joined: one aggregation by item whatever their number. Every order is
total (score or first place, then item_id).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import ranked


def stacked(rankings: Sequence[DataFrame]) -> DataFrame:
    """All rankings under one another, with ``source`` counting them from 0."""
    if not rankings:
        raise ValueError("no ranking to fuse")
    return reduce(DataFrame.unionByName, [r.withColumn("source", F.lit(i)) for i, r in enumerate(rankings)])


def reciprocal_rank_fusion(rankings: Sequence[DataFrame], k: int, rrf_k: int = 60, groups: Sequence[str] = ("query_id",)) -> DataFrame:
    """Score: sum of 1 / (rrf_k + rank); an item repeated inside a ranking counts each time."""
    rows = stacked(rankings).groupBy(*groups, "item_id").agg(F.sum(F.lit(1.0) / (rrf_k + F.col("rank"))).alias("score"))
    return ranked(rows, groups, k)


def deduplicate(rows: DataFrame, k: int | None = None, groups: Sequence[str] = ("query_id",), seq: str = "seq") -> DataFrame:
    """One row for each item at its first appearance by ``seq``, with its highest score; ranks
    are assigned anew. ``k`` None keeps all."""
    once = rows.groupBy(*groups, "item_id").agg(F.min(seq).alias("first"), F.max("score").alias("score"))
    out = ranked(once, groups, k if k is not None else 2**31 - 1, order=[F.col("first").asc(), F.col("item_id").asc()])
    return out.drop("first")


def interleave(rankings: Sequence[DataFrame], k: int, groups: Sequence[str] = ("query_id",)) -> DataFrame:
    """Round robin: all first places in the order of the rankings, then all second places, ..."""
    rows = stacked(rankings).withColumn("seq", (F.col("rank").cast("bigint") - 1) * len(rankings) + F.col("source"))
    return deduplicate(rows, k, groups)


def fuse(rankings: Sequence[DataFrame], method: str, k: int, rrf_k: int = 60, groups: Sequence[str] = ("query_id",)) -> DataFrame:
    if method == "rrf":
        return reciprocal_rank_fusion(rankings, k, rrf_k, groups)
    if method == "interleave":
        return interleave(rankings, k, groups)
    raise ValueError(f"unknown fusion {method!r}: rrf or interleave")
