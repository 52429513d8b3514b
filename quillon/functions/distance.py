"""Distances and scores as columns; all arithmetic is in double."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..types import Metric

#: Added to the product of norms, so that a zero vector has cosine distance 1.
EPSILON = 1.1920929e-07


def vector_literal(values: list[float]) -> Column:
    """A constant vector of doubles."""
    return F.array(*[F.lit(float(x)) for x in values])


def _folded(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    """Sum of products; 0 for empty vectors."""
    return _folded(a, b, lambda x, y: x.cast("double") * y.cast("double"))


def norm(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 minus the cosine."""
    return 1 - dot(a, b) / (norm(a) * norm(b) + F.lit(EPSILON))


def l2_distance(a: Column, b: Column) -> Column:
    """Euclidean distance."""
    return F.sqrt(_folded(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def distance(metric: Metric | str, a: Column, b: Column) -> Column:
    """Distance under the metric, lower is closer."""
    metric = Metric.parse(metric)
    if metric is Metric.DOT:
        return -dot(a, b)
    return cosine_distance(a, b) if metric is Metric.COSINE else l2_distance(a, b)


def normalized(a: Column) -> Column:
    """The vector scaled to length 1; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(a.cast("array<double>"))


def pairwise(metric: Metric | str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact distances of matching rows (or of x's rows to one y)."""
    metric = Metric.parse(metric)
    if metric is Metric.L2:
        d = x - y
        return np.sqrt(np.einsum("...i,...i->...", d, d))
    dots = np.einsum("...i,...i->...", x, y)
    if metric is Metric.DOT:
        return -dots
    return 1 - dots / (np.sqrt(np.einsum("...i,...i->...", x, x)) * np.sqrt(np.einsum("...i,...i->...", y, y)) + EPSILON)


def batched_distance(metric: Metric | str, query: list[float]):
    """A function of a vector column: distances to one query by Arrow batches, for long vectors."""
    metric, q = Metric.parse(metric), np.asarray(query, dtype=np.float64)

    @F.pandas_udf("double")
    def of(vectors: pd.Series) -> pd.Series:
        out = np.full(len(vectors), np.nan)
        some = np.array([v is not None and len(v) == len(q) for v in vectors], dtype=bool)
        if some.any():
            out[some] = pairwise(metric, np.vstack(vectors[some].to_list()).astype(np.float64), q)
        return pd.Series(out).where(some)

    return of


def inverted(d: Column) -> Column:
    """1 / (1 + distance), as a signal where higher is better."""
    return 1 / (1 + d.cast("double"))


def recency(created_at: Column, as_of: float, grace_days: float, decay: float) -> Column:
    """exp(-decay * days over the grace); 1 where the time is null. created_at: seconds."""
    over = (F.lit(float(as_of)) - created_at.cast("double")) / 86400 - float(grace_days)
    return F.exp(-float(decay) * F.when(over > 0, over).otherwise(0.0))


def rrf_term(rank: Column, rrf_k: float = 60.0) -> Column:
    """A rank's share in reciprocal-rank fusion; ranks begin at 1."""
    return 1.0 / (float(rrf_k) + rank)


def interpolated(alpha: float, a: Column, b: Column) -> Column:
    """alpha * a + (1 - alpha) * b."""
    return float(alpha) * a + (1 - float(alpha)) * b


def register_sql_functions(spark: SparkSession) -> None:
    """dot_product, cosine_similarity and l2_distance for SQL, inlined by Catalyst."""
    v = "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>"
    body = "aggregate(zip_with(a, b, (x, y) -> {}), 0D, (s, x) -> s + x)"
    total = body.format("x * y")
    size = "sqrt(aggregate({0}, 0D, (s, x) -> s + x * x))"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION dot_product({v}) RETURNS DOUBLE RETURN {total}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION l2_distance({v}) RETURNS DOUBLE RETURN sqrt({body.format('(x - y) * (x - y)')})")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION cosine_similarity({v}) RETURNS DOUBLE RETURN {total} / ({size.format('a')} * {size.format('b')} + {EPSILON}D)")
