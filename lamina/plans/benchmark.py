"""A whole benchmark run: retrieval, metrics, leaderboard, artifacts."""

from __future__ import annotations

import json
import time
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import candidates, judgements, metrics
from ..operators.encoders import Encoder, encode_items
from ..operators.fingerprint import corpus_fingerprint, ordered_fingerprint
from ..session import cut
from ..sources.dataset import Dataset, document_texts, passage_texts
from . import artifacts
from .config import Config, configured
from .pipeline import DenseFactory, Stopwatch, encoders, hierarchical_search, needed


@dataclass
class Report:
    run_id: str
    config: Config
    summary: dict[str, Any]
    leaderboard: DataFrame
    per_query: DataFrame
    grouped: DataFrame | None
    documents: DataFrame
    passages: DataFrame
    audit: DataFrame
    seconds: dict[str, float]
    preflight: dict[str, dict[str, float]] = field(default_factory=dict)
    archive: str | None = None

    @property
    def latency(self) -> DataFrame:
        """experiment, queries, mean_ms, min_ms, max_ms of the run's queries."""
        ms = F.col("latency_ms")
        return self.per_query.groupBy("experiment").agg(F.count(F.lit(1)).alias("queries"), F.avg(ms).alias("mean_ms"), F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms"))

    @property
    def best_experiment(self) -> str:
        row = self.leaderboard.first()
        if row is None:
            raise RuntimeError("no experiment was run")
        return row["experiment"]


def relevance_of(ds: Dataset, profile: str) -> DataFrame:
    """query_id, item_id, relevance: of pairs judged twice the last (memory) or highest grade."""
    rows = judgements.last_wins(ds.qrels) if profile == "memory" else judgements.upsert(ds.qrels)
    return rows.select("query_id", F.col("passage_id").alias("item_id"), F.col("score").alias("relevance"))


def evaluate(ds: Dataset, config: Config, experiments: Sequence[str], documents: DataFrame, passages: DataFrame, profile: str) -> DataFrame:
    """experiment, query_id and the metrics of each."""
    groups = ["experiment", "query_id"]
    names = F.array(*[F.lit(e) for e in experiments])
    runs = ds.queries.select(F.explode(names).alias("experiment"), "query_id")
    each = F.explode(F.filter(names, lambda e: F.split(e, "__")[0] == F.col("document_method"))).alias("experiment")
    docs = documents.select(each, "query_id", "item_id", "score", "rank")
    passage_documents = ds.passages.select(F.col("passage_id").alias("item_id"), "doc_id")
    e, k = config.evaluation, config.retrieval.document_top_k
    return metrics.per_query_metrics(runs, passages, docs, relevance_of(ds, profile), passage_documents, e.ndcg_k, e.recall_k, k, groups)


def latencies(watch: Stopwatch, experiments: Sequence[str], n_queries: int) -> dict[str, float]:
    """Milliseconds a query by experiment. Queries are answered together, so each bears its share of
    the stages it needs; a passage stage serves all document methods at once and is shared by them."""
    methods = max(1, len({e.split("__")[0] for e in experiments}))
    out = {}
    for e in experiments:
        document, passage = e.split("__")
        seconds = watch.of("document", document) + (watch.of("passage", passage) + watch.seconds.get(("candidates", "all"), 0.0)) / methods
        out[e] = 1000 * seconds / max(1, n_queries)
    return out


def run(ds: Dataset, config: Config = Config(), profile: str = "memory", experiments: Sequence[str] | None = None, encoder: Encoder | None = None, output: str | None = None, check: bool = True, dense_factory: DenseFactory | None = None, **overrides: Any) -> Report:
    """Runs the named experiments (or those of the run mode); with ``output`` writes artifacts.

    ``overrides`` replace single settings of ``config`` by name. ``dense_factory`` makes the dense
    retrievers instead of the configured backend."""
    config = configured(config, **overrides).validate()
    names = config.experiments(list(experiments) if experiments is not None else None)
    if check:
        ds.validate()
    summary = ds.summary()
    if profile == "memory" and not summary["queries_with_relevant_passages"]:
        raise ValueError("no query has a relevant passage")
    r, dense_used = config.retrieval, dense_factory is None and "dense" in needed([m for e in names for m in e.split("__")])
    estimate = {}
    if r.preflight_sample_size > 0 and dense_used:
        for level in ("document", "passage"):
            estimate[level] = preflight(ds, config, encoder, r.preflight_sample_size, r.preflight_timeout_threshold_hours, r.strict_preflight, level)
    seconds, began, watch = {}, time.perf_counter(), Stopwatch()
    documents, pairs, passages = hierarchical_search(ds, config, names, profile, encoder, dense_factory, watch)
    seconds["retrieval"] = time.perf_counter() - began
    seconds |= {"_".join(k): v for k, v in watch.seconds.items()}
    share = latencies(watch, names, summary["queries"])
    latency = F.create_map(*[F.lit(x) for e, ms in share.items() for x in (e, ms)])[F.col("experiment")]
    per_query = cut(evaluate(ds, config, names, documents, passages, profile).withColumn("latency_ms", latency))
    means = metrics.mean_metrics(per_query, ["experiment"])
    board = cut(metrics.leaderboard(means, f"passage_ndcg@{config.evaluation.ndcg_k}"))
    seconds["total"] = time.perf_counter() - began
    audit = candidates.candidate_audit(pairs, ds.passages.agg(F.count(F.lit(1))))
    report = Report(datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S%fZ"), config, summary, board, per_query, None, documents, passages, audit, seconds, estimate)
    if ds.query_metadata is not None:
        best = per_query.where(F.col("experiment") == report.best_experiment)
        report.grouped = metrics.grouped_metrics(best, ds.query_metadata)
    if output:
        report.archive = artifacts.save_report(report, output)
    return report


def preflight(ds: Dataset, config: Config, encoder: Encoder | None = None, sample: int = 1000, limit_hours: float = 10.0, strict: bool = False, level: str = "passage") -> dict[str, float]:
    """Estimate of encoding all items of a level from a timed sample: rows/s, hours, GiB of vectors."""
    r = config.retrieval
    items = passage_texts(ds.passages, r.passage_text) if level == "passage" else document_texts(ds.documents, ds.passages, r.document_text)
    n, of_items = items.count(), encoders(config, encoder)[0]
    began = time.perf_counter()
    done = encode_items(items.limit(sample), of_items).count()
    rate = done / max(1e-9, time.perf_counter() - began)
    width = 2 if r.embedding_dtype == "float16" else 4
    out = {"rows": float(n), "rows_per_second": rate, "hours": n / rate / 3600 if rate else 0.0, "gib": n * of_items.dimension * width / 2**30}
    if strict and out["hours"] >= limit_hours:
        raise RuntimeError(f"encoding all {level}s would take {duration(out['hours'] * 3600)}")
    return out


def duration(seconds: float) -> str:
    """The two largest units of a time, in whole seconds: 2h 05m, 3m 07s, 9s; nothing is less than 0s."""
    whole = max(0, int(seconds))
    if whole >= 3600:
        return f"{whole // 3600}h {whole // 60 % 60:02d}m"
    return f"{whole // 60}m {whole % 60:02d}s" if whole >= 60 else f"{whole}s"


def run_key(ds: Dataset, config: Config) -> str:
    """Twelve hex digits that change with the configuration or any id or text of the corpus."""
    texts = [document_texts(ds.documents, strategy="title_body"), passage_texts(ds.passages)]
    parts = [json.dumps(asdict(config), sort_keys=True), *[json.dumps(corpus_fingerprint(t).first().asDict(), sort_keys=True) for t in texts]]
    return ordered_fingerprint(parts)[:12]
