"""Feature hashing without Python: sparse signed vectors from md5 of each word."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words
from . import dense


def hash_vectors(items: DataFrame, dimension: int = 512) -> DataFrame:
    """item_id, bucket, value of (item_id, text): non-zero entries of unit vectors.

    A word's 60-bit md5 number gives bucket (modulo dimension) and sign (minus if bit 8 is set).
    A text without words, or whose words cancel out, has no entries."""
    v = F.conv(F.substring(F.md5(F.col("word").cast("binary")), 1, 15), 16, 10).cast("bigint")
    rows = items.select("item_id", F.explode(words(F.col("text"))).alias("word")).withColumn("v", v)
    sign = F.when(F.shiftright("v", 8).bitwiseAND(F.lit(1)) == 1, -1.0).otherwise(1.0)
    entries = rows.groupBy("item_id", (F.col("v") % dimension).alias("bucket")).agg(F.sum(sign).alias("value")).where("value <> 0")
    size = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy("item_id")))
    return entries.select("item_id", "bucket", (F.col("value") / size).alias("value"))


def dense_vectors(entries: DataFrame, dimension: int = 512) -> DataFrame:
    """item_id, embedding (array<float>) of entries (item_id, bucket, value); an item has at most
    ``dimension`` of them."""
    values = entries.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "value"))).alias("m"))
    at = lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)).cast("float")
    return values.select("item_id", F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(dimension - 1).cast("bigint")), at).alias("embedding"))


def search(queries: DataFrame, items: DataFrame, k: int, dimension: int = 512) -> DataFrame:
    """query_id, item_id, score, rank: the k nearest items (item_id, text) of every query (query_id,
    text), by blocks of query vectors; texts without entries take no part."""
    asked = dense_vectors(hash_vectors(queries.select(F.col("query_id").alias("item_id"), "text"), dimension), dimension)
    return dense.search(asked.withColumnRenamed("item_id", "query_id"), dense_vectors(hash_vectors(items, dimension), dimension), k, dimension)
