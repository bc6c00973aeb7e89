"""Configuration: frozen dataclasses with defaults, overlaid from YAML or keywords."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace
from typing import Any

# Methods, depths, cutoffs, model and experiment lists of the standard configuration.
METHODS = ("sparse", "dense", "combined")
EXPERIMENTS = tuple(f"{d}__{p}" for d in METHODS for p in METHODS)


@dataclass(frozen=True)
class Retrieval:
    document_top_k: int = 20
    passage_top_k: int = 100
    fusion: str = "rrf"
    rrf_k: int = 60
    dense_backend: str = "hashing"
    dense_model: str = "intfloat/e5-small-v2"
    dense_model_revision: str = "ffb93f3bd4047442299a41ebb6fa998a38507c52"
    dense_batch_size: int = 64
    #: Texts handed to the model at a time in a worker.
    multi_process_chunk_size: int = 5_000
    #: Rows of a file of vectors, rows after which an unfinished index can be resumed, rows between reports.
    embedding_write_chunk_size: int = 50_000
    embedding_checkpoint_rows: int = 50_000
    progress_interval: int = 50_000
    #: Items that are multiplied with the query vectors at a time (at most; a task takes less if it must).
    dense_search_chunk_size: int = 50_000
    preferred_devices: tuple[str, ...] = ("cuda:0", "cuda:1")
    enable_multi_gpu: bool = True
    enable_resume: bool = True
    embedding_dtype: str = "float32"
    #: Rows of the timed sample before a run (0: none), the limit of its estimate and whether it stops the run.
    preflight_sample_size: int = 0
    preflight_timeout_threshold_hours: float = 10.0
    strict_preflight: bool = False
    dense_query_prefix: str = "query: "
    dense_corpus_prefix: str = "passage: "
    hashing_features: int = 512
    document_text: str = "title_body"
    passage_text: str = "title_text"


@dataclass(frozen=True)
class Evaluation:
    ndcg_k: int = 10
    recall_k: int = 100


@dataclass(frozen=True)
class Run:
    mode: str = "smoke"
    smoke_experiments: tuple[str, ...] = ("sparse__sparse", "sparse__dense", "dense__dense", "combined__combined")
    baseline_experiments: tuple[str, ...] = ("sparse__dense", "dense__dense", "combined__dense", "combined__combined")


_POSITIVE = {
    "retrieval": (
        "document_top_k", "passage_top_k", "rrf_k", "dense_batch_size", "hashing_features", "multi_process_chunk_size", "embedding_write_chunk_size",
        "embedding_checkpoint_rows", "dense_search_chunk_size", "progress_interval", "preflight_timeout_threshold_hours",
    ),
    "evaluation": ("ndcg_k", "recall_k"),
}
_CHOICES = {
    ("retrieval", "fusion"): ("rrf", "interleave"),
    ("retrieval", "dense_backend"): ("hashing", "sentence_transformers", "model"),
    ("retrieval", "embedding_dtype"): ("float32", "float16"),
    ("run", "mode"): ("smoke", "baseline", "full"),
}


@dataclass(frozen=True)
class Config:
    project_name: str = "lamina"
    seed: int = 42
    retrieval: Retrieval = field(default_factory=Retrieval)
    evaluation: Evaluation = field(default_factory=Evaluation)
    run: Run = field(default_factory=Run)

    def problems(self) -> list[str]:
        """All that is wrong, each as a message."""
        out = [f"{section}.{name} must be positive" for section, names in _POSITIVE.items() for name in names if getattr(getattr(self, section), name) <= 0]
        if self.retrieval.preflight_sample_size < 0:
            out.append("retrieval.preflight_sample_size must not be negative")
        for (section, name), known in _CHOICES.items():
            if getattr(getattr(self, section), name) not in known:
                out.append(f"{section}.{name} is one of {', '.join(known)}")
        return out

    def validate(self) -> "Config":
        if found := self.problems():
            raise ValueError("invalid configuration: " + "; ".join(found))
        return self

    def experiments(self, names: list[str] | None = None) -> list[str]:
        """Named experiments, or those of the run mode."""
        if names is None:
            names = {"smoke": self.run.smoke_experiments, "baseline": self.run.baseline_experiments, "full": EXPERIMENTS}[self.run.mode]
        if unknown := sorted(set(names) - set(EXPERIMENTS)):
            raise ValueError(f"unknown experiments: {', '.join(unknown)}")
        return list(names)


def _overlay(part: Any, given: Mapping[str, Any]) -> Any:
    known = {f.name: getattr(part, f.name) for f in fields(part)}
    if unknown := sorted(set(given) - set(known)):
        raise TypeError(f"unknown keys: {', '.join(unknown)}")
    return replace(part, **{k: tuple(v) if isinstance(known[k], tuple) else v for k, v in given.items()})


def from_mapping(given: Mapping[str, Any], base: Config = Config()) -> Config:
    """Unknown keys of a section raise TypeError, unknown sections are ignored."""
    parts = {name: _overlay(getattr(base, name), given.get(name) or {}) for name in ("retrieval", "evaluation", "run")}
    plain = {k: given[k] for k in ("project_name", "seed") if k in given}
    return replace(base, **parts, **plain).validate()


def configured(base: Config = Config(), **overrides: Any) -> Config:
    """``base`` with single settings replaced by name, whatever their section; None leaves one as it is."""
    sections = {f.name: name for name in ("retrieval", "evaluation", "run") for f in fields(getattr(base, name))}
    given: dict[str, Any] = {}
    for name, value in overrides.items():
        if value is not None and name in sections:
            given.setdefault(sections[name], {})[name] = value
        elif value is not None and name in ("project_name", "seed"):
            given[name] = value
        elif value is not None:
            raise TypeError(f"unknown setting: {name}")
    return from_mapping(given, base)


def load(path: str) -> Config:
    import yaml

    with open(path, encoding="utf-8") as f:
        return from_mapping(yaml.safe_load(f) or {})
