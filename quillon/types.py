"""Metrics, index kinds, errors and argument rules of collections."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from enum import Enum

#: Largest number of results that a search may ask for.
MAX_K = 1024


class EngineError(Exception):
    """Base of the library's errors."""


class DimMismatch(EngineError):
    """A vector's length isn't the collection's dimension."""


class CollectionNotFound(EngineError):
    """No collection of that name."""


class CollectionExists(EngineError):
    """A collection of that name is there already."""


class VectorNotFound(EngineError):
    """No vector of that id."""


class InvalidArgument(EngineError, ValueError):
    """An argument breaks a rule."""


class ColumnNotFound(EngineError):
    """A source lacks a column."""


class TypeMismatch(EngineError):
    """A source's column has another type than it must."""


class SnapshotDiverged(EngineError):
    """The older snapshot isn't an ancestor of the newer: scan the whole table again."""


class Metric(Enum):
    """Lower scores are closer for all three."""

    L2 = "l2"
    COSINE = "cosine"
    DOT = "dot"

    @classmethod
    def parse(cls, name: str | Metric) -> Metric:
        if isinstance(name, Metric):
            return name
        try:
            return cls(name.lower())
        except ValueError:
            raise InvalidArgument(f"unknown metric {name!r}") from None


@dataclass(frozen=True)
class Flat:
    """Exact search."""


@dataclass(frozen=True)
class Ivf:
    """Inverted file; sq8 keeps scalar-quantized codes. train: kmeans, or first (the first nlist vectors)."""

    nlist: int = 100
    nprobe: int = 10
    sq8: bool = False
    train: str = "kmeans"

    def __post_init__(self) -> None:
        if self.nlist < 1 or not 1 <= self.nprobe <= self.nlist:
            raise InvalidArgument("need 1 <= nprobe <= nlist")
        if self.train not in ("kmeans", "first"):
            raise InvalidArgument("train is kmeans or first")


@dataclass(frozen=True)
class Hnsw:
    """Layered proximity graphs, one for each partition."""

    m: int = 16
    ef_construction: int = 100
    ef_search: int = 50

    def __post_init__(self) -> None:
        if self.m < 2 or self.ef_construction < self.m or self.ef_search < 1:
            raise InvalidArgument("need m >= 2, ef_construction >= m and ef_search >= 1")


@dataclass(frozen=True)
class SourceBinding:
    """Where a collection's rows come from."""

    table: str
    id_column: str
    vector_column: str
    payload_columns: tuple[str, ...] = ()
    namespace: tuple[str, ...] = ()


@dataclass(frozen=True)
class CollectionSpec:
    """What is fixed when a collection is made."""

    name: str
    dim: int
    metric: Metric = Metric.L2
    index: Flat | Ivf | Hnsw = field(default_factory=Flat)
    fts: bool = False
    binding: SourceBinding | None = None

    def __post_init__(self) -> None:
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", self.name) or set(self.name) == {"."}:
            raise InvalidArgument("a name is made of letters, digits, - _ and .")
        if self.dim < 1:
            raise InvalidArgument("dim must be positive")


def check_k(k: int) -> int:
    """k, if a search may ask for so many."""
    if not 1 <= k <= MAX_K:
        raise InvalidArgument(f"k must be 1 to {MAX_K}")
    return k
