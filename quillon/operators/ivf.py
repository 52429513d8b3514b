"""Inverted file and scalar quantization. Centroids are (cluster, centroid)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.distance import EPSILON, pairwise
from ..types import InvalidArgument, Metric
from .search import BLOCK, knn, known, meetings

#: Rounds of k-means at most, and the movement of all centroids that ends it.
ROUNDS, TOLERANCE = 25, 1e-4
#: Centroids are broadcast; a table of more bytes is refused.
CENTROID_BYTES = 256 << 20


def _first(rows: DataFrame, nlist: int, order: str) -> list[list[float]]:
    return [list(r["vector"]) for r in rows.where("vector is not null").orderBy(order, "id").limit(nlist).select("vector").collect()]


def first_centroids(rows: DataFrame, nlist: int, order: str = "id") -> DataFrame:
    """The first nlist vectors by ``order`` as centroids."""
    got = [(i, [float(x) for x in v]) for i, v in enumerate(_first(rows, nlist, order))]
    return rows.sparkSession.createDataFrame(got, "cluster int, centroid array<double>")


def nearest_of(matrix: np.ndarray, metric: Metric):
    """A function of an array of vectors: the nearest centroid of each (the first of equals) and its distance."""

    def of(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = np.zeros(len(v), dtype=np.int32)
        for at in range(0, len(v), 512):
            x = v[at : at + 512]
            rough = -(x @ matrix.T)
            if metric is Metric.L2:
                rough = 2 * rough + (matrix * matrix).sum(1)[None, :]
            elif metric is Metric.COSINE:
                rough = rough / (np.sqrt((x * x).sum(1))[:, None] * np.sqrt((matrix * matrix).sum(1))[None, :] + EPSILON)
            slack = 1e-9 * (1 + np.abs(rough).max(initial=0))
            a, b = np.nonzero(rough <= rough.min(1)[:, None] + slack)
            exact = pairwise(metric, x[a], matrix[b])
            order = np.lexsort((b, exact, a))
            first = np.searchsorted(a[order], np.arange(len(x)))
            out[at : at + 512] = b[order][first]
        return out, pairwise(metric, v, matrix[out])

    return of


def _matrix(centroids: DataFrame) -> np.ndarray:
    size = centroids.agg(F.coalesce(F.sum(F.size("centroid").cast("long") * 8), F.lit(0)).alias("bytes")).first()["bytes"]
    if size > CENTROID_BYTES:
        raise InvalidArgument("too many centroids to broadcast")
    rows = sorted(centroids.collect(), key=lambda r: r["cluster"])
    return np.array([r["centroid"] for r in rows], dtype=np.float64)


def _vectors(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.float64).reshape(len(column), -1)


def assign(rows: DataFrame, centroids: DataFrame, metric: Metric | str = Metric.L2) -> DataFrame:
    """rows (id, vector, ...) with ``cluster``, the nearest centroid, and ``distance`` to it."""
    return _assigned(rows, _matrix(centroids), Metric.parse(metric))


def _assigned(rows: DataFrame, centroids: np.ndarray, metric: Metric) -> DataFrame:
    matrix = rows.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = nearest_of(matrix.value, metric)
        for batch in batches:
            if batch.num_rows:
                cluster, dist = of(_vectors(batch.column("vector")))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cluster), pa.array(dist)], names=[*batch.schema.names, "cluster", "distance"])

    some = rows.where("vector is not null")
    return some.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in some.schema), "cluster int, distance double"]))


def cluster_means(assigned: DataFrame) -> DataFrame:
    """(cluster, n, centroid): the mean vector of each cluster, summed within tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        counts: dict[int, int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            v, c = _vectors(batch.column("vector")), np.asarray(batch.column("cluster"))
            for cluster in np.unique(c).tolist():
                own = c == cluster
                sums[cluster] = sums.get(cluster, 0) + v[own].sum(0)
                counts[cluster] = counts.get(cluster, 0) + int(own.sum())
        for cluster, total in sums.items():
            yield pa.record_batch([pa.array([cluster] * len(total), pa.int32()), pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total), pa.array([counts[cluster]] * len(total), pa.int64())], names=["cluster", "at", "total", "n"])

    parts = assigned.select("cluster", "vector").mapInArrow(run, "cluster int, at int, total double, n long")
    sums = parts.groupBy("cluster", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct("at", (F.col("total") / F.col("n")).alias("mean"))))
    return sums.groupBy("cluster").agg(F.max("n").alias("n"), F.transform(pairs, lambda p: p["mean"]).alias("centroid"))


def kmeans(rows: DataFrame, nlist: int, metric: Metric | str = Metric.L2, rounds: int = ROUNDS, tolerance: float = TOLERANCE, first: str | None = None) -> DataFrame:
    """Centroids by Lloyd's rounds over all rows.

    The vectors with the smallest hashes of their ids begin, or the first by the column ``first``. A cluster that loses
    all its vectors begins anew at the largest cluster's previous centroid. Only
    centroids (nlist of them) come to the driver.
    """
    metric = Metric.parse(metric)
    begin = rows.withColumn("__h", F.xxhash64("id"))
    centroids = np.array(_first(begin, nlist, first or "__h"), dtype=np.float64)
    for _ in range(rounds if len(centroids) else 0):
        means = {r["cluster"]: (r["n"], r["centroid"]) for r in cluster_means(_assigned(rows.select("id", "vector"), centroids, metric)).collect()}
        largest = max(means, key=lambda c: (means[c][0], c))
        new = np.array([means[i][1] if i in means else centroids[largest] for i in range(len(centroids))])
        moved = float(np.sqrt(((new - centroids) ** 2).sum(1)).max())
        centroids = new
        if moved < tolerance:
            break
    return rows.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cluster int, centroid array<double>")


def probed(centroids: DataFrame, query: list[float], nprobe: int, metric: Metric | str = Metric.L2) -> list[int]:
    """The nprobe clusters nearest to the query."""
    m = _matrix(centroids)
    d = pairwise(metric, m, np.asarray(query, dtype=np.float64)) if len(m) else np.zeros(0)
    return np.lexsort((np.arange(len(d)), d))[:nprobe].tolist()


def search(assigned: DataFrame, centroids: DataFrame, query: list[float], k: int, nprobe: int, metric: Metric | str = Metric.L2, predicate: dict | Column | None = None, include_payload: bool = False) -> DataFrame:
    """(id, score): the k nearest within the nprobe nearest clusters.

    Where ``assigned`` is a table partitioned by cluster, only the probed ones are read.
    """
    return knn(assigned.where(F.col("cluster").isin(probed(centroids, query, nprobe, metric))), query, k, metric, predicate, include_payload)


def search_batch(assigned: DataFrame, centroids: DataFrame, queries: DataFrame, k: int, nprobe: int, metric: Metric | str = Metric.L2) -> DataFrame:
    """(query_id, id, score, rank): for every query (id, vector) the k nearest within its nprobe nearest clusters.

    The queries that probe a cluster are cut into blocks, and its rows pass each block as
    a stream, so neither a large cluster nor one that is often probed must fit in
    memory. Null vectors are left out.
    """
    metric, m = Metric.parse(metric), _matrix(centroids)
    matrix = assigned.sparkSession.sparkContext.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = matrix.value
        for batch in batches:
            if not batch.num_rows or not len(m):
                continue
            near = [np.lexsort((np.arange(len(m)), pairwise(metric, m, q)))[:nprobe] for q in _vectors(batch.column("vector"))]
            take = pa.array(np.repeat(np.arange(batch.num_rows), min(nprobe, len(m))))
            yield pa.record_batch([batch.column("query_id").take(take), batch.column("vector").take(take), pa.array(np.concatenate(near).astype(np.int32))], names=["query_id", "vector", "cluster"])

    asked = known(queries, "query_id")
    probes = asked.mapInArrow(run, f"query_id long, vector {dict(asked.dtypes)['vector']}, cluster int")
    blocks = asked.count() * min(nprobe, len(m)) // (max(1, len(m)) * BLOCK) + 1
    probes = probes.withColumn("cell", F.col("cluster") * blocks + F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    rows = assigned.where("id is not null").select(F.col("id").cast("long"), "vector", F.explode(F.sequence(F.col("cluster") * blocks, F.col("cluster") * blocks + (blocks - 1))).alias("cell"))
    return meetings(probes, rows, max(1, len(m)) * blocks, k, metric)


def sq8_fit(rows: DataFrame) -> DataFrame:
    """One row (low, scale): arrays with the least value of each dimension and a 255th of its range (1 if it is 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        for batch in batches:
            if batch.num_rows:
                v = _vectors(batch.column("vector"))
                low = v.min(0) if low is None else np.minimum(low, v.min(0))
                high = v.max(0) if high is None else np.maximum(high, v.max(0))
        if low is not None:
            yield pa.record_batch([pa.array(np.arange(len(low), dtype=np.int32)), pa.array(low), pa.array(high)], names=["at", "low", "high"])

    parts = rows.where("vector is not null").select("vector").mapInArrow(run, "at int, low double, high double").groupBy("at").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    scale = F.when(F.col("high") > F.col("low"), (F.col("high") - F.col("low")) / 255).otherwise(1.0)
    both = F.array_sort(F.collect_list(F.struct("at", "low", scale.alias("scale"))))
    return parts.agg(both.alias("b")).select(F.transform("b", lambda x: x["low"]).alias("low"), F.transform("b", lambda x: x["scale"]).alias("scale"))


def sq8_encoded(vector: Column, low: Column, scale: Column) -> Column:
    """Codes 0 to 255; values outside the fitted range are clamped, halves round away from zero."""
    steps = F.zip_with(F.zip_with(vector, low, lambda v, m: v.cast("double") - m), scale, lambda x, s: x / s)
    return F.transform(steps, lambda x: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.round(x))).cast("smallint"))


def sq8_decoded(codes: Column, low: Column, scale: Column) -> Column:
    """Vectors from codes."""
    return F.zip_with(low, F.zip_with(codes, scale, lambda c, s: c.cast("double") * s), lambda m, x: m + x)


def sq8_rows(rows: DataFrame, quantizer: DataFrame) -> DataFrame:
    """rows with ``codes`` and with ``vector`` as it is decoded."""
    return sq8_vectors(sq8_codes(rows, quantizer).select(*[c for c in rows.columns if c != "vector"], "codes"), quantizer).select(*rows.columns, "codes")


def sq8_codes(rows: DataFrame, quantizer: DataFrame) -> DataFrame:
    """rows with ``codes``."""
    q = rows.crossJoin(F.broadcast(quantizer))  # one row
    return q.withColumn("codes", sq8_encoded(F.col("vector"), F.col("low"), F.col("scale"))).drop("low", "scale")


def sq8_vectors(coded: DataFrame, quantizer: DataFrame) -> DataFrame:
    """coded with ``vector``, decoded from ``codes``."""
    q = coded.crossJoin(F.broadcast(quantizer))
    return q.withColumn("vector", sq8_decoded(F.col("codes"), F.col("low"), F.col("scale"))).drop("low", "scale")


class Lists:
    """Inverted lists in a folder, kept current by deltas.

        centroids/, quantizer/   as trained
        base/cluster=<c>/        (id, vector or codes, payload, lsn)
        delta/<n>/lists/...      rows written later, assigned to the same centroids
        delta/<n>/gone           (id, upto): the id's rows of an lsn up to that no longer count

    Inserts, overwrites and deletions so cost what they change, not a rebuild; the
    lists of a cluster are the base's and the deltas' rows less the gone ones.
    """

    def __init__(self, spark: SparkSession, path: str, deltas: int, sq8: bool, metric: Metric | str = Metric.L2):
        self.spark, self.path, self.deltas, self.sq8, self.metric = spark, path, deltas, sq8, Metric.parse(metric)

    @property
    def centroids(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/centroids")

    @property
    def quantizer(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/quantizer")

    def _write(self, rows: DataFrame, path: str) -> None:
        own = assign(rows, self.centroids, self.metric).drop("distance")
        if self.sq8:
            own = sq8_codes(own, self.quantizer).drop("vector")
        own.repartition("cluster").write.partitionBy("cluster").parquet(path)

    def create(self, rows: DataFrame, centroids: DataFrame, train: DataFrame | None = None) -> Lists:
        """Write the lists of rows (id, vector, payload, lsn); train: what the codes are fitted to."""
        centroids.write.parquet(f"{self.path}/centroids")
        if self.sq8:
            sq8_fit(rows if train is None else train).write.parquet(f"{self.path}/quantizer")
        self._write(rows, f"{self.path}/base")
        return self

    def append(self, changed: DataFrame, live: DataFrame, upto: int) -> Lists:
        """Add a delta: rows that are live, and ids whose rows of an lsn up to ``upto`` are gone."""
        at = f"{self.path}/delta/{self.deltas:06d}"
        self._write(live.select("id", "vector", "payload", "lsn"), f"{at}/lists")
        changed.select("id", F.lit(upto).cast("long").alias("upto")).distinct().write.parquet(f"{at}/gone")
        self.deltas += 1
        return self

    def physical(self) -> DataFrame:
        """All rows, gone ones too, with their cluster."""
        kind = "codes array<smallint>" if self.sq8 else "vector array<float>"
        read = self.spark.read.schema(f"id long, {kind}, payload string, lsn long, cluster int")
        out = read.parquet(f"{self.path}/base")
        for n in range(self.deltas):
            out = out.unionByName(read.parquet(f"{self.path}/delta/{n:06d}/lists"))
        return out

    def rows(self, clusters: list[int] | None = None, but: DataFrame | None = None) -> DataFrame:
        """(id, vector, payload, lsn, cluster) of the live rows; of some clusters only those are read. but: ids to leave out."""
        out = self.physical()
        if clusters is not None:
            out = out.where(F.col("cluster").isin(*clusters))
        if self.deltas:
            gone = self.spark.read.parquet(*[f"{self.path}/delta/{n:06d}/gone" for n in range(self.deltas)])
            gone = gone.groupBy(F.col("id").alias("gid")).agg(F.max("upto").alias("upto"))
            out = out.join(gone, (F.col("id") == F.col("gid")) & (F.col("lsn") <= F.col("upto")), "left_anti")
        if but is not None:
            out = out.join(but.select("id"), "id", "left_anti")
        return sq8_vectors(out, self.quantizer) if self.sq8 else out

    def search(self, query: list[float], k: int, nprobe: int, predicate: dict | Column | None = None, include_payload: bool = False, but: DataFrame | None = None, more: DataFrame | None = None) -> DataFrame:
        """(id, score[, payload]): the k nearest within the nprobe nearest clusters, and among ``more`` (id, vector, payload)."""
        rows = self.rows(probed(self.centroids, query, nprobe, self.metric), but).select("id", F.col("vector").cast("array<double>").alias("vector"), "payload")
        if more is not None:
            rows = rows.unionByName(more.select("id", F.col("vector").cast("array<double>").alias("vector"), "payload"))
        return knn(rows, query, k, self.metric, predicate, include_payload)
