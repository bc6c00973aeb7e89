"""A reproducible sample that keeps its members as data grows.

A key is assigned for good to one of ``buckets`` fine buckets by the md5 of its text. The
sample is the list of the first buckets in a fixed permutation (buckets ordered by the md5 of
seed and number); a larger sample only appends to that list. Membership therefore depends on
the key alone: not on order, partitioning, other keys or the amount of data.

Null and blank keys are no keys. Repeated rows of a key count once. Other columns, whatever
their names, play no part. An empty table gives an empty sample.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096
SEED = "sample-1"


def bucket_order(buckets: int = BUCKETS, seed: str = SEED) -> list[int]:
    """The fixed permutation of the bucket numbers (its length is ``buckets``, not the data's)."""
    return sorted(range(buckets), key=lambda b: (hashlib.md5(f"{seed}:{b}".encode()).hexdigest(), b))


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("bigint"), F.lit(buckets))


def stable_sample(df: DataFrame, key: str, fraction: float, order_by: str | None = None, buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """One row for each sampled key: key, bucket, bucket_place and the least ``order_by``.

    ``fraction`` of the buckets, rounded up, is taken: 0 takes none, 1 takes all.
    """
    if not 0 <= fraction <= 1:
        raise ValueError("fraction lies between 0 and 1")
    n = math.ceil(fraction * buckets)
    place = {b: i + 1 for i, b in enumerate(bucket_order(buckets, seed)[:n])}
    chosen = df.sparkSession.createDataFrame(list(place.items()), "bucket bigint, bucket_place bigint")
    k = F.trim(F.col(f"`{key}`").cast("string"))
    rows = df.select(k.alias("k"), *([F.col(f"`{order_by}`").alias("first_seen")] if order_by else []))
    rows = rows.where("k IS NOT NULL AND k <> ''").withColumn("bucket", bucket_of(F.col("k"), buckets))
    rows = rows.join(F.broadcast(chosen), "bucket")  # at most ``buckets`` rows
    seen = [F.min("first_seen").alias("first_seen")] if order_by else [F.count(F.lit(1)).alias("n_rows")]
    out = rows.groupBy("k", "bucket", "bucket_place").agg(*seen)
    return out.withColumnRenamed("k", key)
