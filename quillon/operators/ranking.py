"""After retrieval: enrichment joins, access control, score fusion and reranking."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import interpolated, inverted, recency
from ..types import InvalidArgument


class Scorer(Protocol):
    """A model client: one batched call for all texts."""

    def score(self, query: str, texts: Sequence[str]) -> Sequence[float]: ...


class LexicalScorer:
    """A deterministic stand-in for a model: the share of the query's words that a text has."""

    def score(self, query: str, texts: Sequence[str]) -> list[float]:
        words = set(re.findall(r"\w+", query.lower()))
        return [len(words & set(re.findall(r"\w+", (t or "").lower()))) / max(1, len(words)) for t in texts]


class HttpScorer:
    """Posts {query, texts} as JSON and reads a list of numbers."""

    def __init__(self, url: str, timeout: float = 10.0):
        self.url, self.timeout = url, timeout

    def score(self, query: str, texts: Sequence[str]) -> list[float]:
        import json
        import urllib.request

        body = json.dumps({"query": query, "texts": list(texts)}).encode()
        with urllib.request.urlopen(urllib.request.Request(self.url, body, {"Content-Type": "application/json"}), timeout=self.timeout) as r:  # noqa: S310
            return [float(x) for x in json.load(r)]


def check_teams(teams: Sequence[str]) -> list[str]:
    """The team names, if they are well formed."""
    for t in teams:
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", t):
            raise InvalidArgument(f"bad team name {t!r}")
    return list(teams)


def enrich(candidates: DataFrame, embeddings: DataFrame, documents: DataFrame, authors: DataFrame, classifications: DataFrame, access_control: DataFrame, teams: Sequence[str] = (), include_embedding: bool = False) -> DataFrame:
    """Candidates (id, ann_distance, ann_rank[, query_id]) with their text, document and author.

    Inner joins; restricted documents go, and those that none of the teams may
    read (no teams: open access). A document with several labels gives several
    rows. Candidates are the small side; Spark's statistics pick the join.
    """
    extra = ["query_id"] if "query_id" in candidates.columns else []
    c = candidates.select("id", "ann_distance", "ann_rank", *extra)
    e = embeddings.select(F.col("chunk_id").alias("__chunk"), F.col("doc_id").alias("__doc"), "chunk_text", *(["embedding"] if include_embedding else []))
    d = documents.select(F.col("id").alias("__d"), F.col("author_id").alias("__a"), "created_at")
    a = authors.select(F.col("id").alias("__author"), "reputation_score", "is_verified")
    cl = classifications.where("sensitivity_label != 'restricted'").select(F.col("doc_id").alias("__c"))
    acl = access_control.select(F.col("doc_id").alias("__acl"), "allowed_teams")
    if check_teams(teams):
        acl = acl.where(F.arrays_overlap("allowed_teams", F.array(*[F.lit(t) for t in teams])))
    j = c.join(e, F.col("id") == F.col("__chunk")).join(d, F.col("__doc") == F.col("__d")).join(a, F.col("__a") == F.col("__author"))
    j = j.join(cl, F.col("__doc") == F.col("__c")).join(acl, F.col("__doc") == F.col("__acl"))
    return j.select(*extra, "id", "ann_distance", "ann_rank", "chunk_text", "created_at", "reputation_score", "is_verified", *(["embedding"] if include_embedding else []))


def fuse(enriched: DataFrame, weight_vector: float, weight_recency: float, as_of: float, grace_days: float, decay: float, top_m: int) -> DataFrame:
    """Min-max normalized vector and recency signals, weighted into fusion_score; the best top_m.

    A signal that is the same for all counts 0. With a column query_id, every
    query is normalized and cut by itself.
    """
    extra = ["query_id"] if "query_id" in enriched.columns else []
    every = Window.partitionBy(*(extra or [F.lit(0)]))
    signals = {"__v": inverted(F.col("ann_distance")), "__r": recency(F.col("created_at"), as_of, grace_days, decay)}
    s = enriched.withColumns(signals)

    def scaled(c: str):
        low, high = F.min(c).over(every), F.max(c).over(every)
        return F.coalesce((F.col(c) - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.0))

    score = float(weight_vector) * scaled("__v") + float(weight_recency) * scaled("__r")
    out = s.withColumn("fusion_score", score).select(*extra, "id", "ann_distance", "ann_rank", "chunk_text", "created_at", "fusion_score")
    if not extra:
        return out.orderBy(F.desc("fusion_score"), "id").limit(top_m)
    return out.withColumn("__n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("fusion_score"), "id"))).where(F.col("__n") <= top_m).drop("__n")


def _scored(pdf: pd.DataFrame, scorer: Scorer, query: str) -> list[float]:
    scores = [float(x) for x in scorer.score(query, pdf["chunk_text"].tolist())] if len(pdf) else []
    if len(scores) != len(pdf):
        raise InvalidArgument(f"the scorer gave {len(scores)} scores for {len(pdf)} texts")
    return scores


def rerank(fused: DataFrame, query: str, scorer: Scorer, name: str, order: Callable[[], object], top: int) -> DataFrame:
    """fused with the model's scores in a column, the best ``top`` by ``order()``; one call for all rows.

    fused has at most top_m rows, which one task scores.
    """
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fused.schema), f"{name} double"])

    def run(batches):
        parts = [b for b in batches if len(b)]
        if parts:
            pdf = pd.concat(parts)
            yield pdf.assign(**{name: _scored(pdf, scorer, query)})

    return fused.coalesce(1).mapInPandas(run, schema).orderBy(F.desc(order()), "id").limit(top)


def rerank_bi(fused: DataFrame, query: str, scorer: Scorer, alpha: float, top_p: int) -> DataFrame:
    """Bi-encoder scores as bi_score; fusion_score becomes the interpolation with them."""
    out = rerank(fused, query, scorer, "bi_score", lambda: interpolated(alpha, F.col("bi_score"), F.col("fusion_score")), top_p)
    return out.withColumn("fusion_score", interpolated(alpha, F.col("bi_score"), F.col("fusion_score")))


def rerank_cross(ranked: DataFrame, query: str, scorer: Scorer, top_k: int) -> DataFrame:
    """Cross-encoder scores as cross_score, which alone decide the order."""
    return rerank(ranked, query, scorer, "cross_score", lambda: F.col("cross_score"), top_k)
