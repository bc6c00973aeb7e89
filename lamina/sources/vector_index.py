"""Encoded items on disk: built once, reused when nothing changed, resumed when interrupted."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dense
from ..operators.encoders import Encoder, encode_items
from ..operators.fingerprint import corpus_fingerprint


class VectorIndex:
    """Vectors of ``items`` (item_id, text) in ``path``/vectors, with a manifest beside them."""

    def __init__(self, spark: SparkSession, path: str, items: DataFrame, encoder: Encoder, identity: str = "", checkpoint_rows: int | None = None, file_rows: int = 0, resume: bool = True):
        """``checkpoint_rows``: an interrupted build loses about so many rows (None: the whole of its one
        portion). ``file_rows``: most rows of a file (0: no limit). Without ``resume`` an unfinished
        index is begun anew."""
        self.spark, self.path, self.items, self.encoder, self.identity = spark, path.rstrip("/"), items, encoder, identity
        self.checkpoint_rows, self.file_rows, self.resume = checkpoint_rows, file_rows, resume

    def _file(self, name: str):
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place.getFileSystem(conf), place

    def _read(self, name: str) -> dict[str, Any] | None:
        fs, place = self._file(name)
        if not fs.exists(place):
            return None
        stream = fs.open(place)
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text)

    def _write(self, name: str, value: dict[str, Any]) -> None:
        fs, place = self._file(name)
        out = fs.create(place, True)
        out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        out.close()

    def expected(self) -> dict[str, Any]:
        """What vectors depend on; equal manifests mean equal vectors, across datasets too."""
        return {"encoder": self.encoder.name, "dimension": self.encoder.dimension, "identity": self.identity, **corpus_fingerprint(self.items).first().asDict()}

    def build(self, part_done: Callable[[int, int], None] | None = None) -> "VectorIndex":
        """Encodes what is missing, portion by portion (items split by hash), each a distributed job
        after which ``part_done(portions done, portions)`` is called. A finished index of the same
        manifest is reused; an unfinished one of another manifest is refused, of the same one completed."""
        want, done, begun = self.expected(), self._read("manifest.json"), self._read("progress.json")
        if done == want:
            return self
        if begun is not None and begun != want and self.resume:
            raise ValueError(f"an unfinished index of other contents lies in {self.path}")
        todo, mode = self.items, "overwrite"
        fs, place = self._file("vectors/_SUCCESS")
        if begun is not None and self.resume and fs.exists(place):
            todo, mode = self.items.join(self.vectors(check=False).select("item_id"), "item_id", "left_anti"), "append"
        self._write("progress.json", want)
        portions = max(1, -(-want["n_items"] // self.checkpoint_rows)) if self.checkpoint_rows else 1
        for i in range(portions):
            part = todo if portions == 1 else todo.where(F.pmod(F.xxhash64("item_id"), F.lit(portions)) == i)
            writer = encode_items(part, self.encoder).write.mode(mode)
            (writer.option("maxRecordsPerFile", self.file_rows) if self.file_rows else writer).parquet(f"{self.path}/vectors")
            mode = "append"
            if part_done is not None:
                part_done(i + 1, portions)
        n = self.vectors(check=False).count()
        if n != want["n_items"]:
            raise RuntimeError(f"{n} vectors for {want['n_items']} items")
        self._write("manifest.json", want)
        fs, place = self._file("progress.json")
        fs.delete(place, False)
        return self

    def vectors(self, check: bool = True) -> DataFrame:
        if check and self._read("manifest.json") is None:
            raise RuntimeError("the index is not built")
        return self.spark.read.schema("item_id string, embedding array<float>").parquet(f"{self.path}/vectors")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """Of (query_id, text): query_id, item_id, score, rank."""
        return dense.search(self.encode_queries(queries), self.vectors(), k, self.encoder.dimension)

    def search_candidates(self, queries: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
        return dense.candidate_search(pairs, self.encode_queries(queries), self.vectors(), k)

    def encode_queries(self, queries: DataFrame) -> DataFrame:
        return encode_items(queries.selectExpr("query_id AS item_id", "text"), self.encoder).withColumnRenamed("item_id", "query_id")
