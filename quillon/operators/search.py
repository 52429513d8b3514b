"""Exact nearest neighbours, and reads by id. A collection is (id, vector, payload)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import EPSILON, batched_distance, distance, pairwise, vector_literal
from ..functions.predicate import matches
from ..types import DimMismatch, Metric

#: Queries in a block of the batched search, queries and rows in a tile of it, and pairs measured at a time.
BLOCK, TILE, MEASURED = 16_384, (256, 2048), 65_536


def with_payload(top: DataFrame, rows: DataFrame) -> DataFrame:
    """top with the payloads, fetched after the top is known."""
    return top.join(rows.select("id", "payload"), "id", "left")


def knn(rows: DataFrame, query: list[float], k: int, metric: Metric | str = Metric.L2, predicate: dict | Column | None = None, include_payload: bool = False, arrow: bool = False) -> DataFrame:
    """(id, score[, payload]): the k nearest, closest first, ties by id.

    The filter applies before the top k. Rows whose vector is null are left out;
    k = 0 gives no rows. ``arrow`` computes by Arrow batches instead of in the JVM.
    """
    if predicate is not None:
        rows = rows.where(predicate if isinstance(predicate, Column) else matches(F.col("payload"), predicate))
    score = batched_distance(metric, query)(F.col("vector")) if arrow else distance(metric, F.col("vector"), vector_literal(query))
    top = rows.where("vector is not null").select("id", score.alias("score")).orderBy("score", "id").limit(k)
    return with_payload(top, rows).orderBy("score", "id") if include_payload else top


class Nearest:
    """The k nearest rows of each of many queries, of rows that come a block at a time.

    Products of tiles in single precision tell which pairs may belong to the k; the
    slack is above their rounding, so none is lost, and those pairs alone are
    measured in double. Held are the queries, their k so far and one tile.
    """

    def __init__(self, metric: Metric, ids: np.ndarray, vectors: np.ndarray, k: int, skip_self: bool = False):
        self.metric, self.ids, self.vectors, self.k, self.skip_self = metric, ids, vectors, k, skip_self
        self.norms = np.sqrt((vectors * vectors).sum(1))
        self.scores, self.found = np.full((len(ids), k), np.inf), np.zeros((len(ids), k), np.int64)
        #: What a product must not exceed for its pair to be measured, without the slack.
        self.limits = np.full(len(ids), np.inf)
        self.waiting: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def meet(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Take in rows."""
        if vectors.shape[1] != self.vectors.shape[1]:
            raise ValueError("vectors differ in length")
        for lo in range(0, len(self.ids), TILE[0]):
            for at in range(0, len(ids), TILE[1]):
                self._tile(lo, ids[at : at + TILE[1]], vectors[at : at + TILE[1]])
        self._merge()

    def _rough(self, lo: int, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Products that order the tile's pairs, and each query's slack."""
        q, qn = self.vectors[lo : lo + TILE[0]], self.norms[lo : lo + TILE[0]]
        squares = (c * c).sum(1)
        cn = np.sqrt(squares)
        size = (qn + cn.max(initial=0)) ** 2
        kind = np.float32 if size.max(initial=0) < 1e30 else np.float64
        slack = 2 * (q.shape[1] + 8) * float(np.finfo(kind).eps)
        if self.metric is Metric.L2:
            q, c = np.hstack([-2 * q, np.ones((len(q), 1))]), np.hstack([c, squares[:, None]])
        else:
            q = -q
        d = q.astype(kind) @ c.astype(kind).T
        if self.metric is Metric.COSINE:
            d /= (qn[:, None] * cn[None, :] + EPSILON).astype(kind)
            size = np.ones(len(q))
        return d, slack * size + q.shape[1] * 1e-36

    def _tile(self, lo: int, ids: np.ndarray, c: np.ndarray) -> None:
        d, slack = self._rough(lo, c)
        if self.skip_self:
            d[self.ids[lo : lo + TILE[0], None] == ids[None, :]] = np.inf
        limit = self.limits[lo : lo + TILE[0]]
        first = np.flatnonzero(np.isinf(limit))
        if len(first) and len(ids) >= self.k:
            limit[first] = np.partition(d[first], self.k - 1, axis=1)[:, self.k - 1] + slack[first]
        at = np.flatnonzero(d <= (limit + slack).astype(d.dtype)[:, None])
        at = at[np.isfinite(d.ravel()[at])]
        for n in range(0, len(at), MEASURED):
            a, b = np.divmod(at[n : n + MEASURED], len(ids))
            self.waiting.append((a + lo, ids[b], pairwise(self.metric, c[b], self.vectors[a + lo])))
            self.held += len(a)
            if self.held >= 16 * MEASURED:
                self._merge()

    def _merge(self) -> None:
        if not self.held:
            return
        a, i, d = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
        self.waiting, self.held = [], 0
        own = np.unique(a)
        a, i, d = np.concatenate([np.repeat(own, self.k), a]), np.concatenate([self.found[own].ravel(), i]), np.concatenate([self.scores[own].ravel(), d])
        some = np.isfinite(d)
        a, i, d = a[some], i[some], d[some]
        by = np.lexsort((i, d, a))
        a, i, d = a[by], i[by], d[by]
        nth = np.arange(len(a)) - np.searchsorted(a, a)
        top = nth < self.k
        self.scores[own] = np.inf
        self.scores[a[top], nth[top]], self.found[a[top], nth[top]] = d[top], i[top]
        last = self.scores[own, -1]
        full = own[np.isfinite(last)]
        last = self.scores[full, -1]
        if self.metric is Metric.L2:
            last = last * last - self.norms[full] ** 2
        elif self.metric is Metric.COSINE:
            last = last - 1
        self.limits[full] = last

    def rows(self) -> pa.RecordBatch:
        """(query_id, id, score) of the k so far."""
        some = np.isfinite(self.scores)
        return pa.record_batch([pa.array(np.repeat(self.ids, some.sum(1))), pa.array(self.found[some]), pa.array(self.scores[some])], names=["query_id", "id", "score"])


def _vectors(column: pa.Array) -> np.ndarray:
    if len(set(np.diff(np.asarray(column.offsets)).tolist())) > 1:
        raise ValueError("vectors differ in length")
    return np.asarray(column.flatten()).astype(np.float64).reshape(len(column), -1)


def _met(metric: Metric, k: int, skip_self: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, asked, own = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            cells, sides, ids = (np.asarray(batch.column(c)) for c in ("cell", "side", "id"))
            cuts = (np.flatnonzero((np.diff(cells) != 0) | (np.diff(sides) != 0)) + 1).tolist()
            for at, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if cells[at] != cell:
                    if own is not None:
                        yield own.rows()
                    cell, asked, own = cells[at], [], None
                if sides[at] and not asked:
                    continue
                v = _vectors(batch.column("vector").slice(at, end - at))
                if not sides[at]:
                    asked.append((ids[at:end], v))
                    continue
                if own is None:
                    if len({x.shape[1] for _, x in asked}) > 1:
                        raise ValueError("vectors differ in length")
                    own = Nearest(metric, np.concatenate([i for i, _ in asked]), np.concatenate([x for _, x in asked]), k, skip_self)
                own.meet(ids[at:end], v)
        if own is not None:
            yield own.rows()

    return run


def meetings(asked: DataFrame, rows: DataFrame, cells: int, k: int, metric: Metric, skip_self: bool = False) -> DataFrame:
    """(query_id, id, score, rank): for every query (query_id, vector, cell) the k nearest of the rows (id, vector, cell) of its cells.

    A cell's queries are held in one place, which its rows pass. Cells hand on k rows a
    query, which a window merges.
    """
    if k < 1:
        return asked.sparkSession.createDataFrame([], "query_id long, id long, score double, rank int")
    parts = min(cells, 8192)
    both = asked.select(F.col("query_id").alias("id"), "vector", "cell", F.lit(0).alias("side")).unionByName(rows.select("id", "vector", "cell", F.lit(1).alias("side")))
    placed = both.repartitionById(parts, F.pmod("cell", F.lit(parts)).cast("int")).sortWithinPartitions("cell", "side")
    near = placed.mapInArrow(_met(metric, k, skip_self), "query_id long, id long, score double")
    w = Window.partitionBy("query_id").orderBy("score", "id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def known(rows: DataFrame, name: str = "id") -> DataFrame:
    """(name, vector) of the rows that have both."""
    return rows.where("vector is not null and id is not null").select(F.col("id").cast("long").alias(name), "vector")


def knn_batch(rows: DataFrame, queries: DataFrame, k: int, metric: Metric | str = Metric.L2, skip_self: bool = False, block: int = BLOCK) -> DataFrame:
    """(query_id, id, score, rank): the k nearest of every query (id, vector).

    Every block of queries meets every part of the rows once, and the rows pass it as a
    stream, so neither side must fit in memory. What moves is the rows once for each
    block of queries. Vectors must be of one length; null ones are left out.
    ``skip_self`` leaves out the row that has the query's id.
    """
    asked, own = known(queries, "query_id"), known(rows)
    blocks = asked.count() // block + 1
    parts = min(-(-2 * rows.sparkSession.sparkContext.defaultParallelism // blocks), own.count() // 4096 + 1)
    block_of, part_of = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    asked = asked.withColumn("cell", F.explode(F.sequence(block_of * parts, block_of * parts + (parts - 1))))
    own = own.withColumn("cell", F.explode(F.sequence(part_of, part_of + (blocks - 1) * parts, F.lit(parts))))
    return meetings(asked, own, blocks * parts, k, Metric.parse(metric), skip_self)


def check_dim(rows: DataFrame, dim: int) -> DataFrame:
    """rows; a job over them fails at a vector of another length."""
    ok = F.when((F.size("vector") == dim) | F.col("vector").isNull(), F.col("vector"))
    return rows.withColumn("vector", ok.when(F.lit(True), F.raise_error(F.concat(F.lit(f"expected dim {dim}, got "), F.size("vector").cast("string")))))


def check_query(query: list[float], dim: int) -> list[float]:
    """The query, if it has the collection's dimension."""
    if len(query) != dim:
        raise DimMismatch(f"expected dim {dim}, got {len(query)}")
    return query


def get(rows: DataFrame, id_: int) -> DataFrame:
    """The row of one id."""
    return rows.where(F.col("id") == F.lit(id_))


def get_batch(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(pos, id, vector, payload) in the order of ids (pos, id); nulls where there is no row."""
    return ids.join(rows.select("id", "vector", "payload"), "id", "left").select("pos", "id", "vector", "payload").orderBy("pos")
