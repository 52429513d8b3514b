"""The pipeline after retrieval, with its settings."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ranking
from ..operators.ranking import Scorer
from ..types import InvalidArgument


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise InvalidArgument(what)


@dataclass(frozen=True)
class Fusion:
    """Weights of the signals, the age that counts as new, and the decay by day beyond it."""

    weight_vector: float = 0.7
    weight_recency: float = 0.3
    grace_days: float = 30.0
    decay: float = 0.01

    def __post_init__(self) -> None:
        _need(self.weight_vector >= 0 and self.weight_recency >= 0, "weights can't be negative")
        _need(abs(self.weight_vector + self.weight_recency - 1) <= 1e-5, "weights must sum to 1")
        _need(self.grace_days >= 0, "grace_days can't be negative")
        _need(self.decay > 0, "decay must be positive")


@dataclass(frozen=True)
class Rerank:
    """Models; without a bi-encoder, no model is asked."""

    bi: Scorer | None = None
    cross: Scorer | None = None
    alpha: float = 0.5
    top_p: int = 50
    top_k: int = 10

    def __post_init__(self) -> None:
        _need(0 < self.alpha < 1, "alpha must lie between 0 and 1")
        _need(self.top_p >= 1 and self.top_k >= 1, "top_p and top_k must be 1 or more")


@dataclass(frozen=True)
class Config:
    """All settings; as_of is the time (seconds) that ages are taken from."""

    as_of: float
    top_n: int = 500
    top_m: int = 50
    fusion: Fusion = field(default_factory=Fusion)
    rerank: Rerank = field(default_factory=Rerank)

    def __post_init__(self) -> None:
        _need(1 <= self.top_m <= self.top_n, "need 1 <= top_m <= top_n")


@dataclass(frozen=True)
class Tables:
    """The enrichment tables, as DataFrames."""

    embeddings: DataFrame
    documents: DataFrame
    authors: DataFrame
    classifications: DataFrame
    access_control: DataFrame


def candidates_of(results: DataFrame) -> DataFrame:
    """(id, ann_distance, ann_rank) of search results (id, score, rank)."""
    return results.select(F.col("id").cast("string").alias("id"), F.col("score").alias("ann_distance"), F.col("rank").alias("ann_rank"), *(["query_id"] if "query_id" in results.columns else []))


@dataclass(frozen=True)
class Pipeline:
    """Enrich, fuse, and rerank with the models that there are."""

    tables: Tables
    config: Config

    def run(self, candidates: DataFrame, query: str, teams: tuple[str, ...] = (), top_k: int = 10) -> DataFrame:
        c, t = self.config, self.tables
        rich = ranking.enrich(candidates, t.embeddings, t.documents, t.authors, t.classifications, t.access_control, teams)
        f = c.fusion
        fused = ranking.fuse(rich, f.weight_vector, f.weight_recency, c.as_of, f.grace_days, f.decay, c.top_m)
        none = F.lit(None).cast("double")
        if c.rerank.bi is None:
            out = fused.orderBy(F.desc("fusion_score"), "id").limit(top_k)
            return out.select("id", "fusion_score", none.alias("bi_score"), none.alias("cross_score"), "chunk_text")
        ranked = ranking.rerank_bi(fused, query, c.rerank.bi, c.rerank.alpha, c.rerank.top_p)
        if c.rerank.cross is None:
            return ranked.orderBy(F.desc("fusion_score"), "id").limit(top_k).select("id", "fusion_score", "bi_score", none.alias("cross_score"), "chunk_text")
        return ranking.rerank_cross(ranked, query, c.rerank.cross, c.rerank.top_k).select("id", "fusion_score", "bi_score", "cross_score", "chunk_text")
