"""Exact search by inner product.

Global: the query vectors are taken in blocks of bounded size; each block is broadcast, every
task multiplies its items batch by batch and keeps a running best k a query, and only k rows a
task and query are shuffled to be merged. The items are never shuffled.

Restricted to candidates: pairs are gathered at their item, which is encoded once and meets the
broadcast query vectors. Zero scores are kept. Ties go to the lesser item_id. Rows with a null id or
vector are left out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import block_by_block, few_tasks, spread
from .encoders import Encoder, encode_items, matrix
from .ranking import ranked
from .topk import BestK

#: Bytes of query vectors broadcast at a time.
BLOCK_BYTES = 64 << 20
#: Items and vectors of a block that are multiplied at a time (8 bytes a pair).
ITEM_ROWS, QUERY_ROWS = 2048, 1024
#: Hits (queries times k) that a task keeps for a block.
BLOCK_HITS = 1_000_000


#: Vectors with a smaller share of entries than this are multiplied entry by entry.
SPARSE = 1 / 16


class Packed:
    """Vectors by their entries other than zero, as hashed words give few; 8 bytes an entry."""

    def __init__(self, ids: pa.Array, lengths: np.ndarray, at: np.ndarray, value: np.ndarray, dimension: int):
        self.ids, self.starts, self.at, self.value, self.dimension = ids, np.r_[0, np.cumsum(lengths)].astype(np.int64), at, value, dimension

    def dense(self, rows: np.ndarray) -> np.ndarray:
        size = self.starts[rows + 1] - self.starts[rows]
        entry = np.arange(size.sum()) + np.repeat(self.starts[rows] - np.cumsum(size) + size, size)
        out = np.zeros((len(rows), self.dimension))
        out[np.repeat(np.arange(len(rows)), size), self.at[entry]] = self.value[entry]
        return out

    def products(self, columns: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """First row and inner products with the items (dimension x items), so many rows at a time."""
        n = len(self.ids)
        for first in range(0, n, QUERY_ROWS):
            last = min(n, first + QUERY_ROWS)
            if len(self.at) > n * self.dimension * SPARSE:
                yield first, self.dense(np.arange(first, last)) @ columns
                continue
            out = np.zeros((last - first, columns.shape[1]))
            for i, a, b in zip(range(last - first), self.starts[first:last].tolist(), self.starts[first + 1 : last + 1].tolist()):
                if a < b:
                    np.dot(self.value[a:b].astype(np.float64), columns[self.at[a:b]], out=out[i])
            yield first, out


def _entries(queries: DataFrame) -> DataFrame:
    """query_id, at, value, n: the entries other than zero of each vector, and its length."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            value = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
            ends = np.cumsum(size)
            at = (np.arange(len(value)) - np.repeat(ends - size, size)).astype(np.int32)
            some = np.flatnonzero(value)
            begin = np.searchsorted(some, np.r_[0, ends]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(begin, pa.array(at[some])), pa.ListArray.from_arrays(begin, pa.array(value[some])), pa.array(size)], names=["query_id", "at", "value", "n"])

    rows = queries.select(F.col("query_id").cast("string").alias("query_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    return rows.where("query_id IS NOT NULL AND embedding IS NOT NULL").mapInArrow(work, "query_id string, at array<int>, value array<float>, n bigint")


def _packed(t: pa.Table, dimension: int) -> Packed:
    """Of rows of ``_entries``."""
    flat = lambda c, kind: np.concatenate([np.zeros(0, kind), *(x.flatten().to_numpy() for x in t.column(c).chunks)])
    lengths = np.concatenate([np.zeros(0, np.int64), *(pc.list_value_length(x).to_numpy(zero_copy_only=False) for x in t.column("at").chunks)])
    return Packed(pa.concat_arrays([pa.array([], pa.string()), *t.column("query_id").chunks]), lengths, flat("at", np.int32), flat("value", np.float32), dimension)


def _blocks(queries: DataFrame, dimension: int, k: int) -> Iterator[Packed]:
    ids, at, value, entries = [], [], [], 0

    def block() -> Packed:
        return Packed(pa.array(ids, pa.string()), np.array([len(x) for x in at]), np.concatenate(at), np.concatenate(value), dimension)

    for r in _entries(queries).toLocalIterator(prefetchPartitions=True):
        if r.n != dimension:
            raise ValueError(f"a vector of {r.n} entries instead of {dimension}")
        ids.append(r.query_id)
        at.append(np.array(r.at, np.int32))
        value.append(np.array(r.value, np.float32))
        entries += len(r.at)
        if 8 * entries >= BLOCK_BYTES or len(ids) * k >= BLOCK_HITS:
            yield block()
            ids, at, value, entries = [], [], [], 0
    if ids:
        yield block()


def search(queries: DataFrame, items: DataFrame, k: int, dimension: int, encoder: Encoder | None = None, chunk: int = ITEM_ROWS) -> DataFrame:
    """query_id, item_id, score, rank: the k nearest items of every query.

    ``queries``: query_id, embedding. ``items``: item_id and embedding, or, with an encoder,
    item_id and text, which is then encoded in the task that scans it. At most ``chunk`` items are
    multiplied at a time."""
    chunk = max(1, min(chunk, ITEM_ROWS))
    source = "text" if encoder is not None else "embedding"
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), source).where("item_id IS NOT NULL" + ("" if encoder is not None else " AND embedding IS NOT NULL"))
    rows, spark = spread(rows), items.sparkSession
    if k <= 0:
        return spark.createDataFrame([], "query_id string, item_id string, score double, rank int")

    def scored(shared) -> DataFrame:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q = shared.value
            best = BestK(len(q.ids), k)
            for b in batches:
                for i in range(0, b.num_rows, chunk):
                    part = b.slice(i, chunk)
                    ids, columns = np.array(part.column(0).to_pylist(), dtype=object), np.ascontiguousarray(_vectors(part.column(1), encoder).T)
                    for first, scores in q.products(columns):
                        best.add(ids, scores, first)
            row, score, ids = best.result()
            yield pa.RecordBatch.from_arrays(
                [q.ids.take(pa.array(row, pa.int64())), pa.array(ids.tolist(), pa.string()), pa.array(score, pa.float64())],
                names=["query_id", "item_id", "score"],
            )

        return few_tasks(rows).mapInArrow(work, "query_id string, item_id string, score double")

    out = block_by_block(spark, _blocks(queries, dimension, k), scored)
    if out is None:
        out = spark.createDataFrame([], "query_id string, item_id string, score double")
    return ranked(out, ["query_id"], k)


def _vectors(column: pa.Array, encoder: Encoder | None) -> np.ndarray:
    return matrix(column) if encoder is None else encoder.encode([t or "" for t in column.to_pylist()]).astype(np.float64)


def candidate_search(pairs: DataFrame, queries: DataFrame, items: DataFrame, k: int, groups: Sequence[str] = ("query_id",), encoder: Encoder | None = None) -> DataFrame:
    """groups..., item_id, score, rank over the candidate pairs (groups..., item_id).

    ``queries``: query_id, embedding; ``items``: item_id and embedding, or, with an encoder,
    item_id and text. Unknown ids are ignored.

    The groups that want an item are gathered at the item, so its text or vector is shuffled once and
    encoded once, and meet the broadcast vectors of the queries. Queries are split by hash into
    blocks of bounded size, which also bounds what one item gathers."""
    spark, source = items.sparkSession, "embedding" if encoder is None else "text"
    asked = _entries(queries)
    kinds = dict(pairs.select(*groups, "item_id").dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*groups, "item_id"]) + ", score double"
    count, width, entries = asked.agg(F.count(F.lit(1)), F.max("n"), F.sum(F.size("at"))).first()
    n_blocks = max(1, -(-entries * 8 // BLOCK_BYTES)) if count else 0
    of_block = lambda df, i: df if n_blocks == 1 else df.where(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == i)
    known = items.select("item_id", source) if encoder is not None else items.select("item_id", source).where("embedding IS NOT NULL")

    def blocks() -> Iterator[tuple[int, Packed]]:
        for i in range(n_blocks):
            yield i, _packed(of_block(asked, i).select("query_id", "at", "value").toArrow(), width)

    def scored(shared) -> DataFrame:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q = shared.value[1]
            for b in batches:
                for start in range(0, b.num_rows, 1024):
                    part = b.slice(start, 1024)
                    vectors, wanted = _vectors(part.column(source), encoder), part.column("wanted")
                    who = wanted.flatten()
                    row = np.repeat(np.arange(part.num_rows), pc.list_value_length(wanted).to_numpy(zero_copy_only=False))
                    query = pc.fill_null(pc.index_in(who.field("query_id"), value_set=q.ids), -1).to_numpy(zero_copy_only=False)
                    at = np.flatnonzero(query >= 0)
                    for i in range(0, len(at), 8192):
                        own = at[i : i + 8192]
                        take = pa.array(own)
                        score = np.einsum("ij,ij->i", vectors[row[own]], q.dense(query[own]))
                        yield pa.RecordBatch.from_arrays([*(who.field(c).take(take) for c in groups), part.column("item_id").take(pa.array(row[own])), pa.array(score)], names=[*groups, "item_id", "score"])

        own = of_block(pairs, shared.value[0]).groupBy("item_id").agg(F.collect_set(F.struct(*groups)).alias("wanted"))
        return own.join(known, "item_id").select("item_id", source, "wanted").mapInArrow(work, schema)

    out = block_by_block(spark, blocks(), scored)
    return ranked(spark.createDataFrame([], schema) if out is None else out, groups, k)


def candidate_text_search(pairs: DataFrame, queries: DataFrame, items: DataFrame, encoder: Encoder, query_encoder: Encoder, k: int, groups: Sequence[str] = ("query_id",)) -> DataFrame:
    """As ``candidate_search``, with texts: ``queries`` (query_id, text) and ``items`` (item_id,
    text) are encoded once each."""
    asked = encode_items(queries.selectExpr("query_id AS item_id", "text"), query_encoder).withColumnRenamed("item_id", "query_id")
    return candidate_search(pairs, asked, items, k, groups, encoder)
