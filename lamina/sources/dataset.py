"""The data model: documents, passages, queries and judgements as DataFrames.

Ids are strings; ``pos`` is the order of arrival, which DataFrames do not keep by themselves.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip, titled
from ..operators import validate
from ..session import kept
from .tables import read_table

DOCUMENTS = "doc_id string, title string, text string, pos bigint"
PASSAGES = "passage_id string, doc_id string, title string, text string, paragraph_no int, metadata string, pos bigint"
QUERIES = "query_id string, text string, metadata string"
QRELS = "query_id string, passage_id string, score double, metadata string, seq bigint"
QUERY_METADATA = "query_id string, categories array<string>"
RANKING = "query_id string, item_id string, score double, rank int"


def sorted_json(value: Mapping[str, Any] | str | None) -> str:
    """JSON with sorted keys; text is taken as it is, None is an empty object."""
    return value if isinstance(value, str) else json.dumps(value or {}, sort_keys=True)


@dataclass
class Dataset:
    documents: DataFrame
    passages: DataFrame
    queries: DataFrame
    qrels: DataFrame
    query_metadata: DataFrame | None = None
    name: str = "unknown"
    provenance: dict[str, Any] = field(default_factory=dict)

    def validate(self) -> None:
        found = validate.errors(self.documents, self.passages, self.queries, self.qrels, self.query_metadata)
        if found:
            raise ValueError("invalid dataset: " + "; ".join(found))

    def summary(self) -> dict[str, Any]:
        return {"name": self.name, **validate.summary(self.documents, self.passages, self.queries, self.qrels).first().asDict(), "provenance": dict(self.provenance)}


def from_rows(spark: SparkSession, documents: Iterable, passages: Iterable, queries: Iterable, qrels: Iterable, query_metadata: Mapping[str, Mapping] | None = None, name: str = "unknown", provenance: dict | None = None) -> Dataset:
    """From tuples: (doc_id, title, text), (passage_id, doc_id, title, text[, paragraph_no[, metadata]]),
    (query_id, text[, metadata]), (query_id, passage_id, score[, metadata])."""

    def pad(row: tuple, n: int) -> list:
        return [*row, *[None] * (n - len(row))]

    docs = [(str(d), t, x, i) for i, (d, t, x) in enumerate(documents)]
    rows = [(str(p), str(d), t, x, no, sorted_json(m), i) for i, (p, d, t, x, no, m) in enumerate(pad(r, 6) for r in passages)]
    asked = [(str(q), t, sorted_json(m)) for q, t, m in (pad(r, 3) for r in queries)]
    judged = [(str(q), str(p), float(s), sorted_json(m), i) for i, (q, p, s, m) in enumerate(pad(r, 4) for r in qrels)]
    meta = None
    if query_metadata is not None:
        meta = spark.createDataFrame([(str(q), [str(c) for c in m.get("categories") or []]) for q, m in query_metadata.items()], QUERY_METADATA)
    return Dataset(
        spark.createDataFrame(docs, DOCUMENTS), spark.createDataFrame(rows, PASSAGES), spark.createDataFrame(asked, QUERIES), spark.createDataFrame(judged, QRELS),
        meta, name, provenance or {},
    )


def first_delivery(df: DataFrame, key: str, time: str, *then: str) -> DataFrame:
    """Of each key the row with the earliest time (nulls last); null and blank keys are dropped."""
    # partitioned before the window, or each side of the shuffle would sort whole rows
    rows = df.where(f"trim({key}) <> ''").withColumn(key, F.trim(F.col(key))).repartition(key)
    w = Window.partitionBy(key).orderBy(F.col(time).asc_nulls_last(), *then)
    return rows.withColumn("delivery", F.row_number().over(w)).where("delivery = 1").drop("delivery")


def documents_of(spark: SparkSession, directory: str) -> DataFrame:
    return read_table(spark, directory, "documents").withColumn("pos", F.col("doc_id")).withColumn("doc_id", F.col("doc_id").cast("string"))


def passages_of(spark: SparkSession, directory: str) -> DataFrame:
    """Each passage once, doc_id trimmed; passages without a document id are left out."""
    rows = read_table(spark, directory, "passages").withColumn("doc_id", F.trim("doc_id")).where("doc_id <> ''")
    rows = first_delivery(rows, "passage_id", "ingested_at")
    return rows.withColumn("pos", F.coalesce(F.col("paragraph_no").cast("bigint"), F.lit(10**9)))


def queries_of(spark: SparkSession, directory: str) -> DataFrame:
    return first_delivery(read_table(spark, directory, "queries"), "query_id", "created_at", "batch_no")


def judgements_of(spark: SparkSession, directory: str) -> DataFrame:
    """Rows with both keys (trimmed, lower case) and a grade; ``seq`` is the order of judging."""
    key = lambda c: F.lower(F.trim(c)).alias(c)
    rows = read_table(spark, directory, "qrels").select(key("query_id"), key("passage_id"), "score", "metadata", F.col("qrel_id").alias("seq"))
    return rows.where("query_id <> '' AND passage_id <> '' AND score IS NOT NULL")


def from_tables(spark: SparkSession, directory: str, name: str = "tables", keep: bool = False) -> Dataset:
    """The delivered tables, cleaned as each reader above says. With ``keep`` the cleaned passages
    and queries are written once to the shared folder, for runs that read them many times."""
    hold = kept if keep else lambda df: df
    passages, queries = hold(passages_of(spark, directory)), hold(queries_of(spark, directory))
    meta = read_table(spark, directory, "query_metadata")
    return Dataset(documents_of(spark, directory), passages, queries, judgements_of(spark, directory), meta, name, {"directory": directory})


def documents_from_passages(passages: DataFrame) -> DataFrame:
    """Documents made of their passages: by paragraph number (nulls last), then arrival; title of
    the first; texts joined by line feeds; ``pos`` of the first arrival. A null text or title
    counts as empty; passages without a document id are left out."""
    part = F.struct(
        F.coalesce(F.col("paragraph_no").cast("bigint"), F.lit(10**9)).alias("no"), F.col("pos"), F.col("passage_id"),
        F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"),
    )
    grouped = passages.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.min("pos").alias("pos"))
    body = F.array_join(F.transform("parts", lambda p: p["text"]), "\n")
    return grouped.select("doc_id", F.get("parts", F.lit(0))["title"].alias("title"), body.alias("text"), "pos")


def document_texts(documents: DataFrame, passages: DataFrame | None = None, strategy: str = "title_body", max_passages: int | None = None) -> DataFrame:
    """item_id, text of each document: ``title``, ``body``, ``title_body`` or ``title_passages``
    (title and the first ``max_passages`` passages in paragraph order)."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    if strategy == "title":
        return documents.select(F.col("doc_id").alias("item_id"), strip(blank("title")).alias("text"))
    if strategy == "body":
        return documents.select(F.col("doc_id").alias("item_id"), strip(blank("text")).alias("text"))
    if strategy == "title_body":
        return documents.select(F.col("doc_id").alias("item_id"), titled(F.col("title"), F.col("text")).alias("text"))
    if strategy == "title_passages" and passages is not None:
        part = F.struct(F.coalesce(F.col("paragraph_no").cast("bigint"), F.lit(10**9)).alias("no"), F.col("pos"), F.col("passage_id"), F.coalesce("text", F.lit("")).alias("text"))
        grouped = passages.groupBy("doc_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
        if max_passages is not None:
            grouped = grouped.withColumn("parts", F.slice("parts", 1, max_passages))
        joined = documents.select("doc_id", "title").join(grouped, "doc_id", "left")
        # a document without passages has no such text
        body = F.when(F.col("parts").isNull(), F.raise_error(F.concat(F.lit("no passages for document "), F.col("doc_id")))).otherwise(F.array_join(F.transform("parts", lambda p: p["text"]), "\n"))
        return joined.select(F.col("doc_id").alias("item_id"), titled(F.col("title"), body).alias("text"))
    raise ValueError(f"unknown document text strategy {strategy!r}")


def passage_texts(passages: DataFrame, strategy: str = "title_text") -> DataFrame:
    """item_id, text of each passage: ``title_text`` or ``text``."""
    if strategy == "title_text":
        return passages.select(F.col("passage_id").alias("item_id"), titled(F.col("title"), F.col("text")).alias("text"))
    if strategy == "text":
        return passages.select(F.col("passage_id").alias("item_id"), strip(F.coalesce("text", F.lit(""))).alias("text"))
    raise ValueError(f"unknown passage text strategy {strategy!r}")


def synthetic(spark: SparkSession) -> Dataset:
    """A dataset of three documents for smoke runs."""
    # Titles, texts and ids of the smoke dataset, for which results are known.
    titles = {"d1": "Half Moon Putney", "d2": "Apollo Theatre", "d3": "Genome"}
    texts = {"d1": "A London pub and music venue. Artists included the Rolling Stones.", "d2": "A theatre for plays and musicals.", "d3": "DNA and genetic instructions."}
    passages = [("p1", "d1", 0, "Artists at the venue included the Rolling Stones."), ("p2", "d1", 1, "The pub is a music venue in London."), ("p3", "d2", 0, "The theatre hosts plays and musicals."), ("p4", "d3", 0, "DNA contains genetic instructions.")]
    return from_rows(
        spark,
        [(d, titles[d], texts[d]) for d in titles],
        [(p, d, titles[d], t, no) for p, d, no, t in passages],
        [("q1", "who played at the Half Moon Putney"), ("q2", "genetic instructions DNA")],
        [("q1", "p1", 1.0), ("q2", "p4", 1.0)],
        {"q1": {"categories": ["history"]}, "q2": {"categories": ["science"]}},
        "synthetic",
    )
