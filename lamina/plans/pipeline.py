"""Two-stage retrieval and the nine experiments, all queries and methods in one plan.

Rank documents (sparse, dense, combined), expand them to passages, rank these the same ways.
Every base ranking is computed once, with the document method as a column, and shared by all
experiments that need it. Two profiles differ in what sparse means:

* ``memory``: BM25 with statistics of all items in both stages; lists are filled up to k with
  items of score 0.
* ``scalable``: full-text BM25 for documents; for passages, BM25 with the statistics of each
  query's own candidates; no zero scores.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bm25, candidates, dense, fusion
from ..operators.encoders import Encoder, HashingEncoder, ModelEncoder, PrefixedEncoder, encode_items
from ..operators.ranking import pad_to_k, ranked
from ..operators.retrievers import CombinedRetriever, EncoderRetriever, HashingRetriever, Retriever, SparseRetriever
from ..session import cut
from ..sources.dataset import Dataset, document_texts, passage_texts
from .config import Config

RANKING = ["item_id", "score", "rank"]


def encoders(config: Config, encoder: Encoder | None = None) -> tuple[Encoder, Encoder]:
    """Of items and of queries: the hashing encoder has no prefixes, models have."""
    r = config.retrieval
    if encoder is None:
        if r.dense_backend == "sentence_transformers":
            encoder = ModelEncoder.sentence_transformer(
                r.dense_model, r.dense_model_revision, batch_size=r.dense_batch_size, devices=r.preferred_devices, several=r.enable_multi_gpu,
                chunk=r.multi_process_chunk_size, dtype=r.embedding_dtype,
            )
        elif r.dense_backend == "hashing":
            encoder = HashingEncoder(r.hashing_features)
        else:
            raise ValueError("a dense_backend of 'model' needs an encoder")
    if isinstance(encoder, HashingEncoder):
        return encoder, encoder
    return PrefixedEncoder(encoder, r.dense_corpus_prefix), PrefixedEncoder(encoder, r.dense_query_prefix)


#: Makes the dense retriever of a stage from model_name, model_revision, batch_size, query_prefix,
#: corpus_prefix and cache_path.
DenseFactory = Callable[..., Retriever]


class Stopwatch:
    """Seconds by what took them."""

    def __init__(self):
        self.seconds: dict[tuple[str, str], float] = {}

    def cut(self, key: tuple[str, str], plan: Callable[[], DataFrame]) -> DataFrame:
        began = time.perf_counter()
        out = cut(plan())
        self.seconds[key] = self.seconds.get(key, 0.0) + time.perf_counter() - began
        return out

    def of(self, stage: str, method: str) -> float:
        """A combined method takes what its parts take, and the fusion."""
        parts = ("sparse", "dense", "combined") if method == "combined" else (method,)
        return sum(self.seconds.get((stage, m), 0.0) for m in parts)


def needed(methods: Sequence[str]) -> set[str]:
    """Base methods behind the given ones."""
    return {b for m in methods for b in (("sparse", "dense") if m == "combined" else (m,))}


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def rank_documents(ds: Dataset, config: Config, methods: Sequence[str], profile: str, encoder: Encoder | None = None, dense_factory: DenseFactory | None = None, watch: Stopwatch | None = None) -> DataFrame:
    """document_method, query_id, item_id, score, rank."""
    r, queries, watch = config.retrieval, ds.queries.select("query_id", "text"), watch or Stopwatch()
    items = document_texts(ds.documents, ds.passages, r.document_text)

    def sparse() -> DataFrame:
        if profile != "memory":
            return bm25.search(queries, items, r.document_top_k, bm25.FTS)
        hits = bm25.search(queries, items, r.document_top_k)
        return ranked(pad_to_k(hits, queries, "query_id", items, r.document_top_k), ["query_id"], r.document_top_k)

    def by_vectors() -> DataFrame:
        if dense_factory is not None:
            return build_retriever("dense", config, encoder, dense_factory).fit(items).search(queries, r.document_top_k)
        of_items, of_queries = encoders(config, encoder)
        asked = encode_items(queries.withColumnRenamed("query_id", "item_id"), of_queries).withColumnRenamed("item_id", "query_id")
        return dense.search(asked, items, r.document_top_k, of_items.dimension, of_items, r.dense_search_chunk_size)

    plans = {"sparse": sparse, "dense": by_vectors}
    base = {m: watch.cut(("document", m), lambda m=m: plans[m]().select("query_id", *RANKING)) for m in plans if m in needed(methods)}
    if "combined" in methods:
        base["combined"] = watch.cut(("document", "combined"), lambda: fusion.fuse([base["sparse"], base["dense"]], r.fusion, r.document_top_k, r.rrf_k).select("query_id", *RANKING))
    return _union([base[m].select(F.lit(m).alias("document_method"), "query_id", *RANKING) for m in methods])


def rank_passages(ds: Dataset, config: Config, pairs: DataFrame, methods: Sequence[str], profile: str, encoder: Encoder | None = None, dense_factory: DenseFactory | None = None, watch: Stopwatch | None = None) -> DataFrame:
    """document_method, passage_method, query_id, item_id, score, rank over candidate pairs."""
    r, queries, watch = config.retrieval, ds.queries.select("query_id", "text"), watch or Stopwatch()
    groups = ["document_method", "query_id"]
    items = passage_texts(ds.passages, r.passage_text)

    def sparse() -> DataFrame:
        if profile == "memory":
            scored = bm25.scores(queries, items, candidates=pairs)
            hits = pairs.select(*groups, "item_id").distinct().join(scored, ["query_id", "item_id"], "left").fillna(0.0, ["score"])
        else:
            hits = bm25.candidate_scores(queries, candidates.restrict(items, pairs), pairs, groups)
        return ranked(hits, groups, r.passage_top_k)

    def by_vectors() -> DataFrame:
        if dense_factory is not None:
            retriever = build_retriever("dense", config, encoder, dense_factory).fit(items)
            names = [x.document_method for x in pairs.select("document_method").distinct().collect()]  # at most the three methods
            return _union([retriever.search(queries, r.passage_top_k, pairs.where(F.col("document_method") == m)).withColumn("document_method", F.lit(m)) for m in sorted(names)])
        of_items, of_queries = encoders(config, encoder)
        return dense.candidate_text_search(pairs, queries, items, of_items, of_queries, r.passage_top_k, groups)

    plans = {"sparse": sparse, "dense": by_vectors}
    base = {m: watch.cut(("passage", m), lambda m=m: plans[m]().select(*groups, *RANKING)) for m in plans if m in needed(methods)}
    if "combined" in methods:
        base["combined"] = watch.cut(("passage", "combined"), lambda: fusion.fuse([base["sparse"], base["dense"]], r.fusion, r.passage_top_k, r.rrf_k, groups).select(*groups, *RANKING))
    return _union([base[m].select("document_method", F.lit(m).alias("passage_method"), "query_id", *RANKING) for m in methods])


def build_retriever(method: str, config: Config, encoder: Encoder | None = None, dense_factory: DenseFactory | None = None, cache_path: str | None = None) -> Retriever:
    """The retriever of a method: sparse, dense or combined."""
    r = config.retrieval
    if method == "sparse":
        return SparseRetriever()
    if method == "dense" and dense_factory is not None:
        return dense_factory(
            model_name=r.dense_model, model_revision=r.dense_model_revision, batch_size=r.dense_batch_size,
            query_prefix=r.dense_query_prefix, corpus_prefix=r.dense_corpus_prefix, cache_path=cache_path,
        )
    if method == "dense":
        of_items, of_queries = encoders(config, encoder)
        if isinstance(of_items, HashingEncoder):
            return HashingRetriever(of_items.dimension)
        return EncoderRetriever(of_items.encoder, r.dense_query_prefix, r.dense_corpus_prefix, cache_path)
    if method == "combined":
        parts = [build_retriever(m, config, encoder, dense_factory, cache_path) for m in ("sparse", "dense")]
        return CombinedRetriever(*parts, r.fusion, r.rrf_k)
    raise ValueError(f"unknown method {method!r}: sparse, dense or combined")


class TwoStagePipeline:
    """Any two retrievers as document and passage stage."""

    def __init__(self, document_retriever: Retriever, passage_retriever: Retriever, document_top_k: int = 20, passage_top_k: int = 100, document_text: str = "title_body", passage_text: str = "title_text"):
        self.document_retriever, self.passage_retriever = document_retriever, passage_retriever
        self.document_top_k, self.passage_top_k = document_top_k, passage_top_k
        self.document_text, self.passage_text = document_text, passage_text

    def fit(self, ds: Dataset) -> "TwoStagePipeline":
        self.passages = ds.passages
        self.document_retriever.fit(document_texts(ds.documents, ds.passages, self.document_text))
        self.passage_retriever.fit(passage_texts(ds.passages, self.passage_text))
        return self

    def run(self, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Document and passage rankings of (query_id, text)."""
        documents = cut(self.document_retriever.search(queries, self.document_top_k))
        pairs = cut(candidates.expand_to_passages(documents, self.passages))
        return documents, self.passage_retriever.search(queries, self.passage_top_k, pairs)


def hierarchical_search(ds: Dataset, config: Config, experiments: Sequence[str], profile: str = "memory", encoder: Encoder | None = None, dense_factory: DenseFactory | None = None, watch: Stopwatch | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Document rankings, candidate pairs and passage rankings; the last with ``experiment``."""
    if profile not in ("memory", "scalable"):
        raise ValueError(f"unknown profile {profile!r}: memory or scalable")
    watch = watch or Stopwatch()
    wanted = [e.split("__") for e in experiments]
    doc_methods = list(dict.fromkeys(d for d, _ in wanted))
    documents = rank_documents(ds, config, doc_methods, profile, encoder, dense_factory, watch)
    pairs = watch.cut(("candidates", "all"), lambda: candidates.expand_to_passages(documents, ds.passages, ["document_method", "query_id"]))
    passages = rank_passages(ds, config, pairs, list(dict.fromkeys(p for _, p in wanted)), profile, encoder, dense_factory, watch)
    passages = passages.withColumn("experiment", F.concat_ws("__", "document_method", "passage_method")).where(F.col("experiment").isin(list(experiments)))
    return documents, pairs, passages
