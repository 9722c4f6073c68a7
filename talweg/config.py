"""Settings resolved on the driver; executors never read the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass


def _number(name: str, default: float, least: float | None = None, most: float | None = None) -> float:
    try:
        value = float(os.environ.get(name, "").strip() or default)
    except ValueError:
        value = default
    value = value if least is None else max(least, value)
    return value if most is None else min(most, value)


@dataclass(frozen=True)
class Settings:
    """Weights and sizes of the retrieval and scoring operators."""

    rrf_k: int = 60
    hybrid: bool = True
    weight_skill: float = 0.20
    weight_delivery: float = 0.80
    weight_role: float = 0.0
    overall_skill: float = 0.30
    overall_semantic: float = 0.40
    overall_quality: float = 0.30
    job_coverage: float = 0.62
    top_chunks: int = 3
    embedding_dim: int = 128
    embedding_batch: int = 16
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    chunk_chars: int = 4000
    pool_limit: int | None = None

    @classmethod
    def from_environment(cls) -> Settings:
        skill = _number("SEMANTIC_WEIGHT_SKILL", cls.weight_skill)
        delivery = _number("SEMANTIC_WEIGHT_DELIVERY", cls.weight_delivery)
        role = _number("SEMANTIC_WEIGHT_ROLE", cls.weight_role)
        total = skill + delivery + role
        if total <= 0:
            skill, delivery, role, total = cls.weight_skill, cls.weight_delivery, cls.weight_role, 1.0
        return cls(
            rrf_k=int(_number("SEMANTIC_RRF_K", cls.rrf_k, least=1)),
            hybrid=os.environ.get("SEMANTIC_DELIVERY_HYBRID", "1").strip().lower() not in {"0", "false", "no", "off", "n"},
            weight_skill=skill / total, weight_delivery=delivery / total, weight_role=role / total,
            job_coverage=_number("SEMANTIC_DELIVERY_JOB_COVERAGE", cls.job_coverage, 0.0, 1.0),
            embedding_dim=int(_number("EMBEDDING_DIM", cls.embedding_dim, least=1)),
        )
