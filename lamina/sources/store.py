"""A dataset on disk: parquet tables in a folder with a manifest.

Tables are appended to until ``finalize``; from then on the store is read-only. Any folder
Spark can write to will do: the manifest too is written through Spark's file system. Each change is a
new numbered file, written under a temporary name that is then renamed; the one with the highest
number counts, so a crash at any point leaves the last complete one. Rows are numbered from 0 in
order of arrival, without gaps.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import titled
from ..operators import bm25, fingerprint, judgements, validate
from ..operators.ranking import ranked
from ..session import kept
from .dataset import Dataset, sorted_json

LEVELS = {"document": ("documents", "doc_id"), "passage": ("passages", "passage_id")}
_SCHEMAS = {
    "documents": "doc_id string, title string, text string, search_text string, pos bigint",
    "passages": "passage_id string, doc_id string, title string, text string, paragraph_no int, metadata string, search_text string, pos bigint",
    "queries": "query_id string, text string, metadata string, pos bigint",
    "qrels": "query_id string, passage_id string, score double, metadata string, seq bigint",
}


class DatasetStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        if not self._versions():
            raise FileNotFoundError(f"no dataset store at {path}")

    # files

    def _fs(self, name: str):
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        place = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place.getFileSystem(conf), place

    def _exists(self, name: str) -> bool:
        fs, place = self._fs(name)
        return fs.exists(place)

    def _versions(self) -> list[int]:
        fs, place = self._fs("manifest-*.json")
        found = fs.globStatus(place) or []
        return sorted(int(f.getPath().getName()[len("manifest-") : -len(".json")]) for f in found)

    def _write_manifest(self, manifest: dict[str, Any]) -> None:
        fs, temporary = self._fs("manifest.tmp")
        out = fs.create(temporary, True)
        out.write(bytearray(json.dumps(manifest, indent=2, sort_keys=True).encode()))
        out.close()
        _, place = self._fs(f"manifest-{max(self._versions(), default=0) + 1:08d}.json")
        if not fs.rename(temporary, place):
            raise RuntimeError(f"another writer changed the store at {self.path}")

    @property
    def manifest(self) -> dict[str, Any]:
        fs, place = self._fs(f"manifest-{self._versions()[-1]:08d}.json")
        stream = fs.open(place)
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text)

    dataset_id = property(lambda self: self.manifest["dataset_id"])
    name = property(lambda self: self.manifest["name"])
    provenance = property(lambda self: self.manifest["provenance"])
    finalized = property(lambda self: self.manifest["finalized"])

    @classmethod
    def create(cls, spark: SparkSession, path: str, name: str, provenance: dict[str, Any] | None = None) -> "DatasetStore":
        store = cls.__new__(cls)
        store.spark, store.path = spark, path.rstrip("/")
        if store._versions():
            raise FileExistsError(f"there is a dataset store at {path}")
        store._write_manifest({"dataset_id": uuid.uuid4().hex, "name": name, "provenance": provenance or {}, "finalized": False, "index": []})
        return store

    # writing

    def _append(self, table: str, rows: DataFrame) -> None:
        if self.finalized:
            raise RuntimeError("the store is finalized")
        rows.select(*[c.split()[0] for c in _SCHEMAS[table].split(", ")]).write.mode("append").parquet(f"{self.path}/{table}")

    def _frame(self, rows: DataFrame | Iterable[tuple], schema: str) -> DataFrame:
        return rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(list(rows), schema).coalesce(1)

    def _next(self, table: str) -> int:
        column = "seq" if table == "qrels" else "pos"
        last = self._table(table).agg(F.max(column)).first()[0]
        return 0 if last is None else last + 1

    def add_documents(self, rows: DataFrame | Iterable[tuple]) -> None:
        """doc_id, title, text. Rows are numbered on from those in the store, those of a DataFrame by
        partition and row."""
        df = self._frame(rows, "doc_id string, title string, text string")
        self._append("documents", self._numbered(df, "documents").withColumn("search_text", titled(F.col("title"), F.col("text"))))

    def add_passages(self, rows: DataFrame | Iterable[tuple]) -> None:
        """passage_id, doc_id, title, text, paragraph_no, metadata (JSON text or dict)."""
        if not isinstance(rows, DataFrame):
            rows = [(*r[:4], r[4] if len(r) > 4 else None, sorted_json(r[5] if len(r) > 5 else None)) for r in rows]
        df = self._frame(rows, "passage_id string, doc_id string, title string, text string, paragraph_no int, metadata string")
        self._append("passages", self._numbered(df, "passages").withColumn("search_text", titled(F.col("title"), F.col("text"))))

    def add_queries(self, rows: DataFrame | Iterable[tuple]) -> None:
        if not isinstance(rows, DataFrame):
            rows = [(*r[:2], sorted_json(r[2] if len(r) > 2 else None)) for r in rows]
        self._append("queries", self._numbered(self._frame(rows, "query_id string, text string, metadata string"), "queries"))

    def add_qrels(self, rows: DataFrame | Iterable[tuple]) -> None:
        """Pairs may repeat: reading merges them (highest score, latest metadata)."""
        if not isinstance(rows, DataFrame):
            rows = [(*r[:2], float(r[2]), sorted_json(r[3] if len(r) > 3 else None)) for r in rows]
        df = self._frame(rows, "query_id string, passage_id string, score double, metadata string")
        self._append("qrels", self._numbered(df, "qrels", "seq"))

    def _numbered(self, df: DataFrame, table: str, column: str = "pos") -> DataFrame:
        """Arrival numbers without gaps. The rows are written to the shared folder first, so that
        counting the rows of each partition and numbering them see the same rows."""
        at, part, before = "place in the partition", "partition", "rows before"
        rows = kept(df.drop(column).withColumn(at, F.monotonically_increasing_id())).withColumn(part, F.shiftright(at, 33))
        counts = rows.groupBy(part).agg(F.count(F.lit(1)).alias(before))
        earlier = F.sum(before).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))  # one row a partition
        offsets = counts.withColumn(before, F.coalesce(earlier, F.lit(0)))
        number = F.col(at).bitwiseAND(F.lit((1 << 33) - 1)) + F.col(before) + self._next(table)
        return rows.join(offsets, part).withColumn(column, number).drop(at, part, before)

    def finalize(self, build_passage_index: bool = False) -> "DatasetStore":
        """Checks the data, writes the term index of the documents (and passages), closes the store."""
        if self.finalized:
            raise RuntimeError("the store is finalized")
        for level in ("document", *(("passage",) if build_passage_index else ())):
            bm25.write_index(self.items(level).withColumnRenamed("search_text", "text"), f"{self.path}/index_{level}", bm25.FTS)
        self._check()
        self._write_manifest(self.manifest | {"finalized": True, "index": ["document", *(["passage"] if build_passage_index else [])]})
        return self

    # reading

    def _table(self, name: str) -> DataFrame:
        if not self._exists(name):
            return self.spark.createDataFrame([], _SCHEMAS[name])
        return self.spark.read.schema(_SCHEMAS[name]).parquet(f"{self.path}/{name}")

    @property
    def documents(self) -> DataFrame:
        return self._table("documents")

    def in_order(self, table: str) -> DataFrame:
        """Rows of a table in order of arrival; judgements once a pair, by their first arrival."""
        if table != "qrels":
            return self._table(table).orderBy("pos")
        first = self._table("qrels").groupBy(*judgements.PAIR).agg(F.min("seq").alias("pos"))
        return self.qrels.join(first, judgements.PAIR).orderBy("pos").drop("pos")

    @property
    def passages(self) -> DataFrame:
        return self._table("passages")

    @property
    def queries(self) -> DataFrame:
        return self._table("queries")

    @property
    def qrels(self) -> DataFrame:
        return judgements.upsert(self._table("qrels"))

    @staticmethod
    def _level(level: str) -> tuple[str, str]:
        if level not in LEVELS:
            raise ValueError(f"unknown level {level!r}: document or passage")
        return LEVELS[level]

    def items(self, level: str) -> DataFrame:
        """pos, item_id, search_text in no order."""
        table, key = self._level(level)
        return self._table(table).select("pos", F.col(key).alias("item_id"), "search_text")

    def iter_items(self, level: str) -> Iterator[tuple[int, str, str]]:
        """Ordered scan with row numbers from 0, one row at a time."""
        for r in self.items(level).orderBy("pos").toLocalIterator(prefetchPartitions=True):
            yield r.pos, r.item_id, r.search_text

    def items_for_ids(self, level: str, ids: DataFrame | Iterable[str]) -> DataFrame:
        """Known items of the ids, each once; order by ``pos`` for corpus order."""
        wanted = ids.select("item_id") if isinstance(ids, DataFrame) else self.spark.createDataFrame([(i,) for i in ids], "item_id string")
        return self.items(level).join(wanted.distinct(), "item_id", "left_semi")

    def rows_for_ids(self, level: str, ids: DataFrame | Iterable[str]) -> DataFrame:
        """item_id, pos; an equi-join on ``pos`` leads back."""
        return self.items_for_ids(level, ids).select("item_id", "pos")

    def ids_for_rows(self, level: str, rows: Iterable[int]) -> DataFrame:
        wanted = self.spark.createDataFrame([(int(r),) for r in rows], "pos bigint").distinct()
        return self.items(level).join(wanted, "pos", "left_semi").select("pos", "item_id")

    def passages_of_documents(self, doc_ids: DataFrame | Iterable[str]) -> DataFrame:
        wanted = doc_ids.select("doc_id") if isinstance(doc_ids, DataFrame) else self.spark.createDataFrame([(i,) for i in doc_ids], "doc_id string")
        return self.passages.join(wanted.distinct(), "doc_id", "left_semi").select("passage_id", "doc_id", "pos")

    def documents_of_passages(self, passage_ids: Iterable[str]) -> DataFrame:
        wanted = self.spark.createDataFrame([(i,) for i in passage_ids], "passage_id string").distinct()
        return self.passages.join(wanted, "passage_id", "left_semi").select("passage_id", "doc_id")

    def item_count(self, level: str) -> int:
        return self._table(self._level(level)[0]).count()

    def sparse_search(self, level: str, queries: DataFrame, k: int, candidates: DataFrame | None = None) -> DataFrame:
        """Full-text BM25 over all queries (query_id, text): query_id, item_id, score, rank."""
        self._level(level)
        if level not in self.manifest["index"]:
            raise RuntimeError(f"the store has no {level} index")
        index, items = f"{self.path}/index_{level}", self.items(level).withColumnRenamed("search_text", "text")
        if candidates is None:  # only the k best become rows
            hits = bm25.best_of_index(queries, index, k, bm25.FTS)
            if hits is None:
                hits = bm25.search(queries, items, k, bm25.FTS)
            return hits.select("query_id", "item_id", "score", "rank")
        hits = bm25.search_index(queries, index, bm25.FTS, candidates)
        if hits is None:
            hits = bm25.scores(queries, items, bm25.FTS, candidates)
        return ranked(hits.select("query_id", "item_id", "score"), ["query_id"], k)

    def summary(self) -> dict[str, Any]:
        m = self.manifest
        return {"name": m["name"], **validate.summary(self.documents, self.passages, self.queries, self.qrels).first().asDict(), "provenance": m["provenance"]}

    def fingerprint(self, level: str) -> dict[str, Any]:
        return fingerprint.corpus_fingerprint(self.items(level).withColumnRenamed("search_text", "text"), pos="pos").first().asDict()

    def _check(self) -> None:
        problems = [f"no {t}" for t in ("documents", "passages", "queries") if not self._table(t).limit(1).count()]
        for table, key in (("documents", "doc_id"), ("passages", "passage_id"), ("queries", "query_id")):
            if self._table(table).groupBy(key).count().where("count > 1").limit(1).count():
                problems.append(f"duplicate {key}")
        counts = validate.orphan_counts(self.documents, self.passages, self.queries, self.qrels).where("n_orphans > 0").collect()
        problems += [f"{r.n_orphans} rows without parent in {r.relation}" for r in counts]
        if problems:
            raise ValueError("invalid store: " + "; ".join(problems))

    def validate(self) -> None:
        if not self.finalized:
            raise RuntimeError("the store is not finalized")
        self._check()

    def dataset(self) -> Dataset:
        m = self.manifest
        return Dataset(self.documents, self.passages, self.queries, self.qrels.withColumn("seq", F.lit(0)), None, m["name"], m["provenance"])
