"""The facade: a catalog of collections under one folder, and their searches."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import deep_text
from ..operators import fulltext, graph, ivf, search
from ..sources import files, tables
from ..streaming.log import ChangeLog
from ..types import CollectionExists, CollectionNotFound, CollectionSpec, Flat, Hnsw, InvalidArgument, Ivf, Metric, SourceBinding, check_k


class Collection:
    """A collection; its rows are those of its change log."""

    def __init__(self, spark: SparkSession, folder: str, spec: CollectionSpec):
        self.spark, self.folder, self.spec, self.log = spark, folder, spec, ChangeLog(spark, folder)

    def rows(self) -> DataFrame:
        """(id, vector, payload, lsn) as of now."""
        return self.log.state()

    def upsert(self, rows: DataFrame) -> int:
        """Write rows (id, vector[, payload]); without payload, the earlier one stays. Returns the last lsn."""
        payload = F.col("payload") if "payload" in rows.columns else F.lit(None).cast("string")
        own = search.check_dim(rows.select("id", "vector", payload.alias("payload")), self.spec.dim)
        return self.log.append(own.where("id is not null and vector is not null").withColumn("op", F.lit("upsert")))

    def delete(self, ids: DataFrame) -> int:
        """Delete ids (id); those that aren't there don't matter. Returns the last lsn."""
        return self.log.append(ids.select("id", F.lit("delete").alias("op"), F.lit(None).cast("array<float>").alias("vector"), F.lit(None).cast("string").alias("payload")))

    def apply(self, delta: DataFrame) -> int:
        """Apply a delta (seq, op, id, vector, payload)."""
        return self.log.append(delta)

    def get(self, id_: int) -> DataFrame:
        return search.get(self.rows(), id_)

    def get_batch(self, ids: list[int]) -> DataFrame:
        return search.get_batch(self.rows(), self.spark.createDataFrame(list(enumerate(ids)), "pos int, id long"))

    def ids(self) -> DataFrame:
        return self.rows().select("id").orderBy("id")

    def count(self) -> int:
        return self.rows().count()

    def info(self) -> dict:
        return {"name": self.spec.name, "dim": self.spec.dim, "metric": self.spec.metric.value, "index": type(self.spec.index).__name__.lower(), "fts": self.spec.fts, "count": self.count()}

    def import_parquet(self, path: str, id_column: str = "id", vector_column: str = "vector", payload_columns: tuple[str, ...] = ()) -> int:
        """Upsert all rows of Parquet files; the number of rows."""
        rows = tables.import_parquet(self.spark, path, id_column, vector_column, payload_columns)
        self.upsert(rows)
        return rows.count()

    def export_parquet(self, path: str) -> None:
        tables.export_parquet(self._searched(), path)

    def build_index(self) -> None:
        """(Re)build the index over the live rows as a new version, then point to it; this is compaction, too.

        Readers of the version before go on reading it: it is retired, and deleted
        with what the log retires.
        """
        last, index, old = self.log.last_lsn(), self.spec.index, self._pointer("_INDEX")
        at, rows = f"{self.folder}/index/{last:020d}-{uuid.uuid4().hex[:8]}", self.rows()
        if isinstance(index, Ivf):
            centroids = ivf.first_centroids(rows, index.nlist, "lsn") if index.train == "first" else ivf.kmeans(rows, index.nlist, self.spec.metric)
            train = rows.orderBy("lsn", "id").limit(index.nlist) if index.train == "first" else None
            ivf.Lists(self.spark, at, 0, index.sq8, self.spec.metric).create(rows, centroids, train)
        elif isinstance(index, Hnsw):
            graph.build(rows, index, self.spec.metric).write.parquet(f"{at}/graphs")
        self._point("_INDEX", {"path": at, "last_lsn": last, "deltas": 0}, old)
        if self.spec.fts:
            self.build_text_index()

    def build_text_index(self) -> None:
        """(Re)build the postings of the live payloads as a new version, then point to it."""
        last, old = self.log.last_lsn(), self._pointer("_TEXT")
        at = f"{self.folder}/text/{last:020d}-{uuid.uuid4().hex[:8]}"
        fulltext.write_index(_texts(self.rows()), at)
        self._point("_TEXT", {"path": at, "last_lsn": last}, old)

    def refresh_index(self) -> int:
        """Bring the inverted lists up to date by a delta, without training or rebuilding; the number of ids that changed."""
        now = self._pointer("_INDEX")
        if now is None or not isinstance(self.spec.index, Ivf):
            return 0
        changed, last = self._changed(now), self.log.last_lsn()
        if changed is None:
            return 0
        live = self.rows().join(changed, "id", "left_semi")
        lists = self._lists(now).append(changed, live, now["last_lsn"])
        self._point("_INDEX", now | {"last_lsn": last, "deltas": lists.deltas}, None)
        return changed.count()

    def tombstones(self) -> float:
        """The share of the index's rows that are no longer live, or have been written anew; 0 without an index."""
        now = self._pointer("_INDEX")
        if now is None or isinstance(self.spec.index, Flat):
            return 0.0
        live = self.rows().select("id", "lsn")
        if isinstance(self.spec.index, Ivf):
            physical = self._lists(now).physical().select("id", "lsn")
            n, left = physical.count(), physical.join(live, ["id", "lsn"], "left_semi").count()
        else:
            n = self.spark.read.parquet(f"{now['path']}/graphs").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
            left = live.where(F.col("lsn") <= now["last_lsn"]).count()
        return (n - min(n, left)) / n if n else 0.0

    def _pointer(self, name: str) -> dict | None:
        path = f"{self.folder}/{name}"
        return json.loads(files.read_text(self.spark, path)) if files.exists(self.spark, path) else None

    def _point(self, name: str, to: dict, old: dict | None) -> None:
        files.write_text(self.spark, f"{self.folder}/{name}", json.dumps(to))
        if old:
            self.log.retire([old["path"]])

    def _changed(self, now: dict) -> DataFrame | None:
        """(id): what has changed since the index; None where nothing has."""
        return self.log.log(now["last_lsn"]).select("id").distinct() if now["last_lsn"] < self.log.last_lsn() else None

    def _lists(self, now: dict) -> ivf.Lists:
        return ivf.Lists(self.spark, now["path"], now["deltas"], self.spec.index.sq8, self.spec.metric)

    def _searched(self) -> DataFrame:
        """The live rows, with vectors as the index holds them."""
        now, rows = self._pointer("_INDEX"), self.rows()
        if now and isinstance(self.spec.index, Ivf) and self.spec.index.sq8:
            return ivf.sq8_rows(rows, self._lists(now).quantizer)
        return rows

    def search(self, query: list[float], k: int = 10, filter: dict | None = None, include_payload: bool = False) -> DataFrame:  # noqa: A002
        """(id, score[, payload]); exact where no index has been built, and for rows written since."""
        check_k(k)
        return self._search(query, k, filter, include_payload)

    def _search(self, query: list[float], k: int, filter: dict | None, include_payload: bool = False) -> DataFrame:  # noqa: A002
        search.check_query(query, self.spec.dim)
        now, index, metric = self._pointer("_INDEX"), self.spec.index, self.spec.metric
        if now is None or isinstance(index, Flat):
            return search.knn(self.rows(), query, k, metric, filter, include_payload)
        changed = self._changed(now)
        more = None if changed is None else self.rows().join(changed, "id", "left_semi")
        if isinstance(index, Ivf):
            return self._lists(now).search(query, k, index.nprobe, filter, include_payload, changed, more)
        live = self.rows() if changed is None else self.rows().join(changed, "id", "left_anti")
        # graphs still hold what has changed, so more of their rows are asked for; rebuild before that is most of them
        wide = k if changed is None else k + min(changed.count(), 7 * k)
        top = graph.search(self.spark.read.parquet(f"{now['path']}/graphs"), live, query, wide, filter, index, metric)
        if more is not None:
            top = top.unionByName(search.knn(more, query, k, metric, filter)).orderBy("score", "id").limit(k)
        return search.with_payload(top, self.rows()).orderBy("score", "id") if include_payload else top

    def search_text(self, text: str, k: int = 10, filter: dict | None = None) -> DataFrame:  # noqa: A002
        """(id, score) by BM25 over the payloads' strings; no rows without full-text search. The filter applies before the top k.

        Stored postings are searched where there are any; rows written since are
        searched with them, and their earlier versions left out.
        """
        if not self.spec.fts or not text.strip():
            return self.spark.createDataFrame([], "id long, score double")
        now = self._pointer("_TEXT")
        live = self.rows() if filter is None else self.rows().where(search.matches(F.col("payload"), filter))
        if now is None or filter is not None:
            return fulltext.bm25(_texts(live), text, k)
        postings, lengths = fulltext.read_index(self.spark, now["path"])
        changed = self._changed(now)
        if changed is not None:
            new = _texts(self.rows().join(changed, "id", "left_semi"))
            own = fulltext.placed_postings(new).withColumn("bucket", fulltext._bucket(F.col("term"), fulltext.BUCKETS))
            postings = postings.join(changed, "id", "left_anti").unionByName(own)
            lengths = lengths.join(changed, "id", "left_anti").unionByName(fulltext.lengths(new))
        return fulltext.search_index(postings, lengths, text, k)

    def hybrid_search(self, query: list[float], text: str, k: int = 10, filter: dict | None = None, rrf_k: float = 60.0, filter_text: bool = False, include_payload: bool = False) -> DataFrame:  # noqa: A002
        """(id, score): the best 2k by vector and by text, fused. The filter holds for the text side only with filter_text."""
        check_k(k)
        near = self._search(query, 2 * k, filter)
        top = fulltext.hybrid(near, self.search_text(text, 2 * k, filter if filter_text else None), k, rrf_k)
        return search.with_payload(top, self.rows()).orderBy(F.desc("score"), "id") if include_payload else top


def _texts(rows: DataFrame) -> DataFrame:
    """(id, text) of the payloads."""
    return rows.where("payload is not null").select("id", deep_text("payload").alias("text"))


class Engine:
    """Creates, lists and drops collections under a folder, each described by a small file."""

    def __init__(self, spark: SparkSession, folder: str, parquet_root: str | None = None):
        self.spark, self.folder, self.parquet_root = spark, folder.rstrip("/"), parquet_root

    def _spec_path(self, name: str) -> str:
        return f"{self.folder}/{name}/_SPEC"

    def _write(self, spec: CollectionSpec) -> None:
        d = asdict(spec) | {"metric": spec.metric.value, "kind": type(spec.index).__name__}
        files.write_text(self.spark, self._spec_path(spec.name), json.dumps(d))

    def create_collection(self, name: str, dim: int, metric: Metric | str = Metric.L2, index: Flat | Ivf | Hnsw | None = None, fts: bool = False, binding: SourceBinding | None = None) -> Collection:
        spec = CollectionSpec(name, dim, Metric.parse(metric), index or Flat(), fts, binding)
        if files.exists(self.spark, self._spec_path(name)):
            raise CollectionExists(name)
        self._write(spec)
        return Collection(self.spark, f"{self.folder}/{name}", spec)

    def collection(self, name: str) -> Collection:
        CollectionSpec(name, 1)
        if not files.exists(self.spark, self._spec_path(name)):
            raise CollectionNotFound(name)
        d = json.loads(files.read_text(self.spark, self._spec_path(name)))
        kind = {"Flat": Flat, "Ivf": Ivf, "Hnsw": Hnsw}[d.pop("kind")]
        b = d["binding"]
        binding = SourceBinding(**(b | {"payload_columns": tuple(b["payload_columns"]), "namespace": tuple(b["namespace"])})) if b else None
        return Collection(self.spark, f"{self.folder}/{name}", CollectionSpec(**(d | {"metric": Metric(d["metric"]), "index": kind(**d["index"]), "binding": binding})))

    def drop_collection(self, name: str) -> None:
        self.collection(name)
        files.delete(self.spark, f"{self.folder}/{name}")

    def list_collections(self) -> list[str]:
        return [n for n in files.names(self.spark, self.folder) if files.exists(self.spark, self._spec_path(n))]

    def enable_fts(self, name: str) -> Collection:
        """Full-text search for all rows, earlier ones too; build_text_index stores their postings."""
        self._write(replace(self.collection(name).spec, fts=True))
        return self.collection(name)

    def bind_source(self, name: str, binding: SourceBinding) -> Collection:
        self._write(replace(self.collection(name).spec, binding=binding))
        return self.collection(name)

    def register_namespace(self, namespace: str, missing_ok: bool = True) -> list[str]:
        """Views of the enrichment tables that a catalog's namespace has, under their own names; which were found."""
        found = tables.register_namespace(self.spark, namespace)
        if not found and not missing_ok:
            raise InvalidArgument(f"{namespace} has none of the enrichment tables")
        return found

    def refresh(self, name: str) -> int:
        """Upsert the bound table's rows; the last lsn."""
        c = self.collection(name)
        if c.spec.binding is None:
            raise InvalidArgument("the collection has no source")
        return c.upsert(tables.import_bound(self.spark, c.spec.binding, c.spec.dim))

    def import_parquet(self, name: str, path: str, **columns) -> int:
        """Import from under the root."""
        return self.collection(name).import_parquet(tables.under_root(self.parquet_root, path), **columns)

    def export_parquet(self, name: str, path: str) -> None:
        """Export to under the root."""
        self.collection(name).export_parquet(tables.under_root(self.parquet_root, path))

    def sql(self, query: str, **args) -> DataFrame:
        """Any SQL over the session's tables and views."""
        return self.spark.sql(query, args=args or None)
