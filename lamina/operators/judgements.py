"""Relevance judgements that arrive more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAIR = ["query_id", "passage_id"]


def upsert(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """One row a pair: the highest score and the latest metadata by ``seq`` (the store's rule)."""
    last = F.max(F.struct(F.col(seq).alias("s"), F.col("metadata").alias("m"))).getField("m")
    return rows.groupBy(*PAIR).agg(F.max("score").alias("score"), last.alias("metadata"))


def last_wins(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """One row a pair: the latest score by ``seq`` (the in-memory rule)."""
    last = F.max(F.struct(F.col(seq).alias("s"), F.col("score").alias("v"))).getField("v")
    return rows.groupBy(*PAIR).agg(last.alias("score"))
