"""Top N items of every group, by a mergeable bounded heap.

Each task keeps at most N distinct items of a group (``BoundedHeaps``) while it reads its rows and
hands on only these, so at most N rows a group and task are shuffled, however many rows a group
has. After the one shuffle, by group, the partial heaps are merged: items that several tasks kept
count once, and the first N are numbered. The merge is exact: an item of the final N is among the N
best distinct items of every task that has it with its highest score.

Order: score descending, then identifier ascending in byte order. Rows with a null in the group,
identifier or score, or a NaN score, do not take part. An identifier listed more than once in a
group counts once with its highest score. N must be positive. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that wait in a task until they are merged into its heaps.
WAITING_ROWS = 200_000
#: Entries of all heaps of a task; beyond it they are handed on and begun anew (they merge later).
HEAP_ENTRIES = 1_000_000


class BoundedHeaps:
    """For each group (all columns but the last two) the ``n`` best distinct items so far."""

    def __init__(self, n: int):
        self.n, self.waiting, self.parts = n, 0, []
        self.heaps: pa.Table | None = None

    def add(self, rows: pa.Table) -> None:
        self.parts.append(rows)
        self.waiting += rows.num_rows
        if self.waiting >= WAITING_ROWS:
            self.merge()

    def merge(self) -> pa.Table | None:
        parts = [*([self.heaps] if self.heaps is not None else []), *self.parts]
        self.parts, self.waiting = [], 0
        if not parts:
            return None
        rows = pa.concat_tables(parts)
        *groups, item, score = rows.column_names
        best = rows.group_by([*groups, item], use_threads=False).aggregate([(score, "max")]).rename_columns([*groups, item, score])
        best = best.sort_by([*((g, "ascending") for g in groups), (score, "descending"), (item, "ascending")])
        begins = np.ones(best.num_rows, bool)
        if best.num_rows > 1:
            begins[1:] = False
            for g in groups:
                column = best.column(g)
                begins[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy()
        at = np.arange(best.num_rows)
        place = at - np.maximum.accumulate(np.where(begins, at, 0))
        self.heaps = best.filter(pa.array(place < self.n))
        return self.heaps


def best_rows(df: DataFrame, groups: Sequence[str], item: str, score: str) -> DataFrame:
    """Groups, item_id and score of the rows that can be ranked."""
    # minus zero becomes zero, so that both tie everywhere
    rows = df.select(*[F.col(f"`{g}`") for g in groups], F.col(f"`{item}`").cast("string").alias("item_id"), (F.col(f"`{score}`").cast("double") + F.lit(0.0)).alias("score"))
    for c in (*groups, "item_id", "score"):
        rows = rows.where(F.col(f"`{c}`").isNotNull())
    return rows.where(~F.isnan("score"))


def best_by_item(df: DataFrame, groups: Sequence[str], item: str, score: str) -> DataFrame:
    """Groups, item and its highest score; what cannot be ranked is left out."""
    return best_rows(df, groups, item, score).groupBy(*[F.col(f"`{g}`") for g in groups], "item_id").agg(F.max("score").alias("score"))


def partial_heaps(rows: DataFrame, n: int) -> DataFrame:
    """Of groups..., item_id, score: the ``n`` best distinct items of each group in each task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = BoundedHeaps(n)
        for b in batches:
            heaps.add(pa.Table.from_batches([b]))
            if heaps.heaps is not None and heaps.heaps.num_rows > HEAP_ENTRIES:
                yield from heaps.heaps.to_batches()
                heaps.heaps = None
        last = heaps.merge()
        if last is not None:
            yield from last.to_batches()

    return rows.mapInArrow(work, rows.schema)


def top_n(df: DataFrame, groups: Sequence[str], item: str, score: str, n: int) -> DataFrame:
    """Groups, item_id, place (1 to n) and score."""
    if n < 1:
        raise ValueError("n must be positive")
    own = [F.col(f"`{g}`") for g in groups]
    heaps = partial_heaps(best_rows(df, groups, item, score), n).repartition(*own)
    # both steps keep the partitioning by group
    best = heaps.groupBy(*own, "item_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy(*own).orderBy(F.col("score").desc(), F.col("item_id").asc()))
    return best.select(*own, "item_id", place.cast("bigint").alias("place"), "score").where(F.col("place") <= n)
