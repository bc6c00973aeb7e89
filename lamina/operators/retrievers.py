"""Retrievers: a common interface over the ranking operators.

``fit(items)`` takes (item_id, text) and returns the retriever; ``search(queries, k, candidates)``
takes (query_id, text) and ranks all items, or each query's candidates (query_id, item_id): known
ones only, each once, zero scores kept. Any object with these two methods serves as a stage of a
pipeline. Searching before fitting raises RuntimeError, fitting nothing ValueError.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame

from . import bm25, dense, fusion
from .encoders import Encoder, HashingEncoder, PrefixedEncoder, encode_items
from .ranking import pad_to_k, ranked


class Retriever(Protocol):
    def fit(self, items: DataFrame) -> "Retriever": ...

    def search(self, queries: DataFrame, k: int, candidates: DataFrame | None = None) -> DataFrame: ...


class _Fitted:
    _items: DataFrame | None = None

    def fit(self, items: DataFrame):
        if not items.limit(1).count():
            raise ValueError("nothing to fit")
        self._items = items.select("item_id", "text")
        return self

    @property
    def items(self) -> DataFrame:
        if self._items is None:
            raise RuntimeError("search before fit")
        return self._items

    def known(self, candidates: DataFrame) -> DataFrame:
        return candidates.select("query_id", "item_id").distinct().join(self.items.select("item_id"), "item_id", "left_semi")


class SparseRetriever(_Fitted):
    """BM25 with statistics of all items; lists are filled up with zero scores."""

    def __init__(self, k1: float = 1.5, b: float = 0.75):
        self.profile = bm25.Profile(k1=k1, b=b)

    def search(self, queries: DataFrame, k: int, candidates: DataFrame | None = None) -> DataFrame:
        if candidates is None:
            hits = pad_to_k(bm25.search(queries, self.items, k, self.profile), queries, "query_id", self.items, k)
        else:
            pairs = self.known(candidates)
            hits = pairs.join(bm25.scores(queries, self.items, self.profile, pairs), ["query_id", "item_id"], "left").fillna(0.0, ["score"])
        return ranked(hits.select("query_id", "item_id", "score"), ["query_id"], k)


class CandidateSparseRetriever(_Fitted):
    """BM25 with the statistics of each query's candidates; without candidates, of all items."""

    def search(self, queries: DataFrame, k: int, candidates: DataFrame | None = None) -> DataFrame:
        if candidates is None:
            hits = bm25.scores(queries, self.items, bm25.Profile(k1=bm25.CANDIDATES.k1, item_words=bm25.CANDIDATES.item_words, query_words=bm25.once(bm25.CANDIDATES.query_words)))
        else:
            hits = bm25.candidate_scores(queries, self.items, self.known(candidates))
        return ranked(hits.select("query_id", "item_id", "score"), ["query_id"], k)


class FullTextRetriever(_Fitted):
    """Full-text BM25 with floored idf and phrases; only items that match."""

    def search(self, queries: DataFrame, k: int, candidates: DataFrame | None = None) -> DataFrame:
        if candidates is None:
            return bm25.search(queries, self.items, k, bm25.FTS)
        hits = bm25.scores(queries, self.items, bm25.FTS, candidates)
        return ranked(hits.select("query_id", "item_id", "score"), ["query_id"], k)


class EncoderRetriever(_Fitted):
    """Exact search by the inner product of unit vectors of any encoder. With ``cache_path`` the
    vectors of the items are written there and used again as long as items and encoder stay the same."""

    def __init__(self, encoder: Encoder, query_prefix: str = "query: ", corpus_prefix: str = "passage: ", cache_path: str | None = None):
        self.cache_path = cache_path
        self.of_items, self.of_queries = (PrefixedEncoder(encoder, p) if p else encoder for p in (corpus_prefix, query_prefix))

    def search(self, queries: DataFrame, k: int, candidates: DataFrame | None = None) -> DataFrame:
        if candidates is not None and self.cache_path is None:
            return dense.candidate_text_search(candidates, queries, self.items, self.of_items, self.of_queries, k)
        asked = encode_items(queries.selectExpr("query_id AS item_id", "text"), self.of_queries).withColumnRenamed("item_id", "query_id")
        if self.cache_path is None:
            return dense.search(asked, self.items, k, self.of_items.dimension, self.of_items)
        from ..sources.vector_index import VectorIndex

        vectors = VectorIndex(self.items.sparkSession, self.cache_path, self.items, self.of_items).build().vectors()
        if candidates is not None:
            return dense.candidate_search(candidates, asked, vectors, k)
        return dense.search(asked, vectors, k, self.of_items.dimension)


class HashingRetriever(EncoderRetriever):
    def __init__(self, dimension: int = 512):
        super().__init__(HashingEncoder(dimension), "", "")


class CombinedRetriever:
    """Two retrievers searched at the same depth and fused."""

    def __init__(self, sparse: Retriever, dense: Retriever, method: str = "rrf", rrf_k: int = 60):
        if method not in ("rrf", "interleave"):
            raise ValueError(f"unknown fusion {method!r}: rrf or interleave")
        self.sparse, self.dense, self.method, self.rrf_k = sparse, dense, method, rrf_k

    def fit(self, items: DataFrame) -> "CombinedRetriever":
        self.sparse.fit(items)
        self.dense.fit(items)
        return self

    def search(self, queries: DataFrame, k: int, candidates: DataFrame | None = None) -> DataFrame:
        both = [r.search(queries, k, candidates) for r in (self.sparse, self.dense)]
        return fusion.fuse(both, self.method, k, self.rrf_k)
