"""Settings of the engine. The driver reads them; scalars enter plans as literals."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from typing import Any


@dataclass(frozen=True)
class Config:
    k1: float = 1.2
    b: float = 0.55
    pool: str = "max"
    rrf_k: int = 60
    bm25_weight: float = 1.0
    dense_weight: float = 1.0
    top_k: int = 5
    threshold_low: float = 0.011
    threshold_high: float = 0.025
    match_boost: float = 1.5
    mismatch_penalty: float = 0.3
    pool_multiplier: int = 6
    validation: bool = True
    min_length: int = 3
    max_length: int = 200
    max_repeat: float = 0.6
    max_missing: float = 0.5
    min_dense: float = 0.35
    min_bm25: float = 3.0
    min_reranker: float = 0.35
    min_coverage: float = 0.5
    select_threshold: float = 0.1
    cache: bool = True
    cache_size: int = 256
    embed_dims: int = 256
    #: Fixed value.
    fallback_message: str = "माफ करा, मला या प्रश्नाची माहिती माहित नाही. कृपया दुसरा प्रश्न विचारा किंवा शाळेच्या कार्यालयात संपर्क करा."


#: Where a YAML file of settings has each field.
_PATHS = {
    "k1": "retrieval.bm25.k1", "b": "retrieval.bm25.b", "pool": "retrieval.dense.pool", "rrf_k": "retrieval.fusion.k",
    "bm25_weight": "retrieval.fusion.bm25_weight", "dense_weight": "retrieval.fusion.dense_weight", "top_k": "retrieval.top_k",
    "threshold_low": "retrieval.confidence.threshold_low", "threshold_high": "retrieval.confidence.threshold_high",
    "match_boost": "retrieval.intent.match_boost", "mismatch_penalty": "retrieval.intent.mismatch_penalty", "pool_multiplier": "retrieval.intent.pool_multiplier",
    "validation": "query_validation.enabled", "min_length": "query_validation.structural.min_length", "max_length": "query_validation.structural.max_length",
    "max_repeat": "query_validation.structural.max_token_repeat_ratio", "max_missing": "query_validation.structural.max_missing_token_ratio",
    "min_dense": "query_validation.score.min_dense_cosine", "min_bm25": "query_validation.score.min_bm25_raw",
    "min_reranker": "query_validation.score.min_reranker_score", "min_coverage": "query_validation.score.min_token_coverage",
    "cache": "cache.enabled", "cache_size": "cache.max_size", "fallback_message": "pipeline.fallback_message_mr",
}


def from_tree(tree: dict[str, Any] | None) -> Config:
    """Settings from a nested mapping; missing keys keep their defaults."""
    found = {}
    for f in fields(Config):
        at: Any = tree or {}
        for key in _PATHS.get(f.name, f.name).split("."):
            at = at.get(key) if isinstance(at, dict) else None
        if at is not None:
            found[f.name] = type(f.default)(at)
    return replace(Config(), **found)


def load(path: str) -> Config:
    """Settings from a YAML file on the driver."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return from_tree(yaml.safe_load(f))
