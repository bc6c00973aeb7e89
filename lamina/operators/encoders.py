"""Encoders turn texts into unit vectors inside Arrow batches.

An encoder is any picklable object with ``dimension`` and ``encode(texts) -> float array
(texts x dimension)``; ``name`` enters index manifests. It is built once a Python worker.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"\b\w\w+\b")
_CACHED_WORDS = 200_000


class Encoder(Protocol):
    name: str
    dimension: int

    def encode(self, texts: Sequence[str]) -> np.ndarray: ...


class HashingEncoder:
    """Signed feature hashing of words, then unit length; a text without words stays zero.

    Fixed values (digest, byte order, sign bit): vectors are equal wherever they are made. A word's bucket is the first 8 bytes of its BLAKE2b digest (least byte first) modulo the
    dimension; bit 8 set means minus."""

    def __init__(self, dimension: int = 512):
        if dimension <= 0:
            raise ValueError("dimension must be positive")
        self.name, self.dimension = f"hashing-{dimension}", dimension
        self._known: dict[str, tuple[int, float]] = {}

    def bucket(self, word: str) -> tuple[int, float]:
        hit = self._known.get(word)
        if hit is None:
            v = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            hit = v % self.dimension, -1.0 if v >> 8 & 1 else 1.0
            if len(self._known) >= _CACHED_WORDS:
                self._known.clear()
            self._known[word] = hit
        return hit

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        rows, cols, signs = [], [], []
        for i, t in enumerate(texts):
            for w in _WORD.findall((t or "").lower()):
                c, s = self.bucket(w)
                rows.append(i)
                cols.append(c)
                signs.append(s)
        flat = np.bincount(np.array(rows, np.int64) * self.dimension + np.array(cols, np.int64), weights=signs, minlength=len(texts) * self.dimension) if rows else np.zeros(len(texts) * self.dimension)
        out = flat.reshape(len(texts), self.dimension)
        size = np.sqrt((out * out).sum(1, keepdims=True))
        return (out / np.where(size > 0, size, 1.0)).astype(np.float32)


class PrefixedEncoder:
    """Another encoder behind a text prefix."""

    def __init__(self, encoder: Encoder, prefix: str):
        self.encoder, self.prefix = encoder, prefix
        self.name, self.dimension = f"{encoder.name}|{prefix}", encoder.dimension

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        return self.encoder.encode([self.prefix + (t or "") for t in texts])


def available_devices() -> tuple[str, ...]:
    """Devices of this machine: its CUDA devices, else the processor."""
    try:
        from torch import cuda
    except ImportError:
        return ("cpu",)
    return tuple(f"cuda:{i}" for i in range(cuda.device_count())) or ("cpu",)


def worker_device(preferred: Sequence[str] = (), several: bool = True, available: Sequence[str] | None = None) -> str:
    """Device of this Python worker: one of the GPUs Spark gave to its task; else the available preferred
    ones in turn by task (only the first unless ``several``); else the first available one."""
    from pyspark import TaskContext

    task = TaskContext.get()
    given = task.resources().get("gpu") if task is not None else None
    if given is not None and given.addresses:
        return f"cuda:{given.addresses[0]}"
    have = tuple(available) if available is not None else available_devices()
    usable = [d for d in preferred if d in have] or [have[0]]
    return usable[task.partitionId() % len(usable)] if task is not None and several else usable[0]


class ModelEncoder:
    """A sentence-embedding model, loaded once a worker by ``load(device)``: an object with
    ``encode(texts, batch_size=..., normalize_embeddings=True)``. ``dimension`` None asks the model,
    which is then loaded on the driver too. ``chunk`` texts are handed to the model at a time;
    ``dtype`` float16 rounds the vectors to half precision."""

    def __init__(self, name: str, load: Callable[[str], object], dimension: int | None = None, batch_size: int = 64, devices: Sequence[str] = (), several: bool = True, chunk: int = 5_000, dtype: str = "float32"):
        self.name, self.load, self.batch_size, self.devices, self.several, self.chunk, self.dtype = name, load, batch_size, tuple(devices), several, chunk, dtype
        self._dimension, self._model = dimension, None

    @classmethod
    def sentence_transformer(cls, model: str, revision: str | None = None, **settings) -> "ModelEncoder":
        """A pinned revision of a public model; the library is imported where it is loaded."""

        def load(device: str) -> object:
            try:
                from sentence_transformers import SentenceTransformer
            except ImportError as absent:
                raise RuntimeError("dense retrieval by model needs the sentence-transformers library") from absent
            return SentenceTransformer(model, revision=revision, device=device)

        return cls(f"{model}@{revision or 'main'}", load, **settings)

    def __getstate__(self):
        return self.__dict__ | {"_model": None}

    @property
    def model(self) -> object:
        if self._model is None:
            self._model = self.load(worker_device(self.devices, self.several))
        return self._model

    @property
    def dimension(self) -> int:
        if self._dimension is None:
            names = ("get_embedding_dimension", "get_sentence_embedding_dimension")
            ask = next((f for n in names if callable(f := getattr(self.model, n, None))), None)
            if ask is None:
                raise TypeError(f"the model tells no dimension: it has none of {', '.join(names)}")
            self._dimension = int(ask())
        return self._dimension

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        texts = list(texts)
        parts = [np.asarray(self.model.encode(texts[i : i + self.chunk], batch_size=self.batch_size, normalize_embeddings=True)) for i in range(0, len(texts), self.chunk)]
        out = np.concatenate(parts) if parts else np.zeros((0, self.dimension))
        return out.astype(self.dtype).astype(np.float32)


def vector_array(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(0, rows.size + 1, rows.shape[1] or 1, dtype=np.int32)[: len(rows) + 1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel().astype(np.float32)))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix; null rows are not allowed."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def encode_items(items: DataFrame, encoder: Encoder, batch: int = 1024) -> DataFrame:
    """item_id, embedding (array<float>) of (item_id, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, batch):
                part = b.slice(i, batch)
                rows = encoder.encode([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), vector_array(rows)], names=["item_id", "embedding"])

    return items.select("item_id", F.col("text").cast("string")).mapInArrow(work, "item_id string, embedding array<float>")
