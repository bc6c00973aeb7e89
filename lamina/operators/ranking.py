"""Rankings: (groups..., item_id, score) to (groups..., item_id, score, rank).

Order is score descending, rounded to ``ROUND`` digits (more below ``SMALL``, where full-text
scores of common terms lie) so that sums in another order tie alike, then item_id in byte order. Spark limits each task to k rows a group before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import kept

ROUND = 9
SMALL, SMALL_ROUND = 0.001, 15


def comparable(score: Column) -> Column:
    """The score as compared."""
    return F.when(F.abs(score) < SMALL, F.round(score, SMALL_ROUND)).otherwise(F.round(score, ROUND))


def ranked(df: DataFrame, groups: Sequence[str], k: int, order: Sequence[Column] | None = None) -> DataFrame:
    """The first ``k`` rows of each group with ``rank`` from 1; k of 0 or less keeps none."""
    by = list(order) if order else [comparable(F.col("score")).desc(), F.col("item_id").asc()]
    w = Window.partitionBy(*groups).orderBy(*by)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(0, k))


def numbered(df: DataFrame, groups: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Adds ``name``: 1, 2, ... (bigint) by ``order``, which must be total, within each group of any size.

    Rows are range-partitioned by group and order and sorted there, the only shuffle, so a hot group is
    spread over tasks. Each task numbers its rows; only the first group of a partition can have begun in
    an earlier one, so what must be added is at most one row a partition, which is broadcast. ``df`` is
    computed twice (the ranges are sampled first)."""
    part, n, before, spark = "partition of the order", "rows there", "rows before", df.sparkSession
    own = [F.col(f"`{g}`") for g in groups]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(ranges, *own, *order).sortWithinPartitions(*own, *order).withColumn(part, F.spark_partition_id())
    rows = kept(ordered.mapInArrow(_local_numbers(list(groups), name), StructType([*ordered.schema.fields, StructField(name, LongType())])))
    counts = rows.groupBy(*own, part).agg(F.max(name).alias(n))
    earlier = F.sum(n).over(Window.partitionBy(*own).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    begun = counts.withColumn(before, earlier).where(F.col(f"`{before}`") > 0).select(*[c.alias(f"{g} begun") for c, g in zip(own, groups)], F.col(f"`{part}`").alias(f"{part} begun"), before)
    same = F.col(f"`{part}`") == F.col(f"`{part} begun`")
    for c, g in zip(own, groups):
        same = same & c.eqNullSafe(F.col(f"`{g} begun`"))
    joined = rows.join(F.broadcast(begun), same, "left")
    total = F.col(f"`{name}`") + F.coalesce(F.col(f"`{before}`"), F.lit(0))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], total.cast("bigint").alias(name))


def _local_numbers(groups: Sequence[str], name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Numbers the rows of each group in a task, groups being contiguous."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            begins, ends = np.zeros(b.num_rows, bool), [tuple(b.column(g)[i].as_py() for g in groups) for i in (0, -1)]
            begins[0] = ends[0] != last
            for g in groups:
                one, two = b.column(g)[:-1], b.column(g)[1:]
                same = pc.or_(pc.fill_null(pc.equal(one, two), False), pc.and_(pc.is_null(one), pc.is_null(two)))
                begins[1:] |= ~same.to_numpy(zero_copy_only=False)
            at = np.arange(b.num_rows)
            start = np.maximum.accumulate(np.where(begins, at, -1))
            place = np.where(start >= 0, at - start + 1, at + count + 1)
            last, count = ends[1], int(place[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(place, pa.int64())], names=[*b.schema.names, name])

    return work


def pad_to_k(hits: DataFrame, groups: DataFrame, group: str, items: DataFrame, k: int) -> DataFrame:
    """``hits`` (group, item_id, positive score) and further items with score 0 in item order, for
    lists that must be k long. The k least item_ids always suffice, so the padding is bounded by
    k a group; ``hits`` is read once."""
    pool = items.select("item_id").orderBy("item_id").limit(max(0, k)).agg(F.sort_array(F.collect_list("item_id")).alias("pool"))
    extra = groups.select(group, F.explode(pool.scalar()).alias("item_id"), F.lit(0.0).alias("score"))
    return hits.select(group, "item_id", "score").unionByName(extra).groupBy(group, "item_id").agg(F.max("score").alias("score"))
