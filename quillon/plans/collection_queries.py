"""Queries through the engine: collections, their logs, staging, maintenance, indexes over later changes, and reranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicate import matches
from ..operators import ivf, ranking
from ..session import load
from ..sources.tables import rows_of
from ..streaming import staging
from ..streaming.log import ChangeLog
from ..types import Ivf, SourceBinding
from . import queries as q
from .engine import Collection, Engine
from .pipeline import Config, Pipeline, Rerank

_query, K = q._query, q.K


def _engine(spark: SparkSession) -> Engine:
    return Engine(spark, q._folder(spark, "engine"))


def _label(rows: DataFrame):
    return F.get_json_object("payload", "$.label").cast("int")


def _changed(spark: SparkSession, sf: str, index=None) -> Collection:
    """All embeddings, indexed; then label 0 is deleted, and label 1 written again without payload."""
    rows = q._rows(spark, sf)
    c = _engine(spark).create_collection("vectors", 64, index=index)
    c.upsert(rows)
    if index is not None:
        c.build_index()
    c.delete(rows.where(_label(rows) == 0))
    c.upsert(rows.where(_label(rows) == 1).select("id", "vector"))
    return c


@_query("SELECT vec_id AS id, len(embedding) AS dim, round(list_sum(embedding::DOUBLE[]), 6) + 0.0 AS total, '{\"label\":' || label || '}' AS payload FROM embeddings WHERE label <> 0")
def collection_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Upserts, deletions, and upserts that keep the payload, read back."""
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return _changed(spark, sf).rows().select("id", F.size("vector").cast("long").alias("dim"), (F.round(total, 6) + 0.0).alias("total"), "payload")


@_query(q._knn_sql(q.Metric.L2, "label <> 0"))
def collection_index_after_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Inverted lists built before the changes, all probed: later rows are searched with them, and deleted ones left out."""
    c = _changed(spark, sf, Ivf(16, 16, train="first"))
    return q._scored(c.search(q._probe(spark, sf), K))


@_query(q._knn_sql(q.Metric.L2, "label <> 0"))
def collection_refreshed_index(spark: SparkSession, sf: str) -> DataFrame:
    """The same with the changes in a delta of the lists."""
    c = _changed(spark, sf, Ivf(16, 16, train="first"))
    c.refresh_index()
    return q._scored(c.search(q._probe(spark, sf), K))


@_query("SELECT round(count(*) FILTER (label IN (0, 1)) / (count(*) + count(*) FILTER (label = 1)), 6) AS ratio FROM embeddings")
def collection_tombstones(spark: SparkSession, sf: str) -> DataFrame:
    """The share of the index's rows that are deleted or overwritten, by which maintenance rebuilds."""
    c = _changed(spark, sf, Ivf(16, 16, train="first"))
    c.refresh_index()
    return spark.createDataFrame([(round(c.tombstones(), 6),)], "ratio double")


def _texts(spark: SparkSession, sf: str) -> Collection:
    """Documents as payloads, with stored postings; then those in German are deleted."""
    docs = load(spark, sf, "documents")
    c = _engine(spark).create_collection("texts", 1, fts=True)
    c.upsert(docs.select(F.col("doc_id").alias("id"), F.array(F.lit(0.0).cast("float")).alias("vector"), F.to_json(F.struct("text")).alias("payload")))
    c.build_text_index()
    c.delete(docs.where("lang = 'de'").select(F.col("doc_id").alias("id")))
    return c


_LEFT = q._BM25.replace("FROM documents WHERE text IS NOT NULL", "FROM documents WHERE text IS NOT NULL AND lang IS DISTINCT FROM 'de'")


@_query(f"WITH {_LEFT} SELECT id, round(score, 6) AS score FROM b ORDER BY b.score DESC, id LIMIT {K}")
def collection_text_after_changes(spark: SparkSession, sf: str) -> DataFrame:
    return q._scored(_texts(spark, sf).search_text(q.WORDS, K))


@_query("SELECT DISTINCT event_type AS name FROM events")
def catalog_listing(spark: SparkSession, sf: str) -> DataFrame:
    """Collections created, listed, and dropped again."""
    engine = _engine(spark)
    names = [r[0] for r in load(spark, sf, "events").select("event_type").distinct().collect()]
    for name in [*names, "left-out"]:
        engine.create_collection(name, 1)
    engine.drop_collection("left-out")
    return spark.createDataFrame([(n,) for n in engine.list_collections()], "name string")


@_query("SELECT vec_id AS id, '{\"label\":' || label || '}' AS payload FROM embeddings")
def source_binding(spark: SparkSession, sf: str) -> DataFrame:
    """A collection that is bound to a catalog's table, and refreshed from it."""
    view = "bound_embeddings"
    load(spark, sf, "embeddings").createOrReplaceTempView(view)
    engine = _engine(spark)
    engine.create_collection("bound", 64)
    engine.bind_source("bound", SourceBinding(view, "vec_id", "embedding", ("label",)))
    engine.refresh("bound")
    return engine.collection("bound").rows().select("id", "payload")


@_query("SELECT vec_id AS id, round(list_sum(embedding::DOUBLE[]), 6) + 0.0 AS total FROM embeddings")
def collection_import_export(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors through import and export under the engine's root."""
    root = q._folder(spark, "files")
    engine = Engine(spark, q._folder(spark, "engine"), parquet_root=root.removeprefix("file://"))
    rows = rows_of(load(spark, sf, "embeddings"), "vec_id", "embedding")
    rows.write.parquet(f"{root}/in")
    for name in "ab":
        engine.create_collection(name, 64)
    engine.import_parquet("a", "in")
    engine.export_parquet("a", "out")
    engine.import_parquet("b", "out")
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return engine.collection("b").rows().select("id", (F.round(total, 6) + 0.0).alias("total"))


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    return q._log(spark, sf).select(F.col("lsn").alias("seq"), "id", "op", F.when(F.col("op") == "upsert", F.array(F.col("value").cast("float"))).alias("vector"), "payload", "collection")


@_query("SELECT user_id AS id, count(*) FILTER (event_type = 'error') AS deleted, count(*) FILTER (event_type <> 'error') AS pending FROM events GROUP BY user_id")
def wal_truncation(spark: SparkSession, sf: str) -> DataFrame:
    """A checkpoint without grace drops nothing that staging has still to read."""
    folder = q._folder(spark, "log")
    log, stage = ChangeLog(spark, f"{folder}/log"), staging.Staging(spark, f"{folder}/staging")
    log.follow_as("staging", 0)
    log.append(_changes(spark, sf))
    log.checkpoint(grace_ms=0)
    staging.flush_all(log, stage, 0, 0)
    log.checkpoint(grace_ms=0)
    if log.segments():
        raise AssertionError("segments are left that everyone has read")
    return stage.rows().groupBy("id").agg(F.count(F.when(F.col("merge_status") == "deleted", True)).alias("deleted"), F.count(F.when(F.col("merge_status") == "pending", True)).alias("pending"))


@_query(f"SELECT id, 'pending' AS merge_status, CAST(value AS FLOAT) AS x, payload FROM ({q._STATE})")
def staging_after_truncation(spark: SparkSession, sf: str) -> DataFrame:
    """Where the log was truncated before staging's first tick, the live rows are staged."""
    folder = q._folder(spark, "log")
    log, stage = ChangeLog(spark, f"{folder}/log"), staging.Staging(spark, f"{folder}/staging")
    log.append(_changes(spark, sf))
    log.checkpoint(grace_ms=0)
    staging.flush_all(log, stage, 0)
    return stage.rows().select("id", "merge_status", F.get(F.from_json("vector_json", "array<float>"), F.lit(0)).alias("x"), "payload")


_BEFORE = q._STATE.replace("FROM events)", "FROM events WHERE event_type <> 'purchase')", 1)


@_query(f"SELECT id, CAST(value AS FLOAT) AS x, payload FROM ({_BEFORE})")
def checkpoint_readers(spark: SparkSession, sf: str) -> DataFrame:
    """A reader that begins before a later commit and a checkpoint reads its version to the end."""
    log = ChangeLog(spark, q._folder(spark, "log"))
    changes = _changes(spark, sf)
    log.append(changes.where("collection <> 'purchase'"))
    log.checkpoint()
    reader = log.state()
    log.append(changes.where("collection = 'purchase'"))
    log.checkpoint()
    return reader.select("id", F.col("vector")[0].alias("x"), "payload")


@_query("SELECT vec_id AS id, '{\"label\":' || label || '}' AS payload FROM embeddings WHERE label >= 5")
def maintenance_ticks(spark: SparkSession, sf: str) -> DataFrame:
    """A versioned table followed in bounded ticks, with a version that drops rows, until nothing waits."""
    rows, folder = q._rows(spark, sf), q._folder(spark, "maintenance")
    source = staging.SnapshotTable(spark, f"{folder}/source")
    c = Engine(spark, f"{folder}/engine").create_collection("c", 64)
    config = staging.Maintenance(enabled=True, max_rows_per_tick=max(1, rows.count() // 3))
    first = source.commit(rows.where(_label(rows) < 5))
    while staging.maintain(c, source, rows.schema, config)["waiting"]:
        pass
    source.commit(rows.where(_label(rows) >= 5), removed_files=source._manifest(first)["files"])
    while staging.maintain(c, source, rows.schema, config)["waiting"]:
        pass
    return c.rows().select("id", "payload")


@_query("SELECT vec_id AS id, '{\"label\":' || label || '}' AS payload FROM embeddings WHERE label >= 5")
def maintenance_rescan(spark: SparkSession, sf: str) -> DataFrame:
    """A source that no longer descends from the version applied is scanned as a whole."""
    rows, folder = q._rows(spark, sf), q._folder(spark, "maintenance")
    source = staging.SnapshotTable(spark, f"{folder}/source")
    c = Engine(spark, f"{folder}/engine").create_collection("c", 64)
    config = staging.Maintenance(enabled=True)
    base = source.commit(rows.where("false"))
    source.commit(rows.where(_label(rows) < 5))
    staging.maintain(c, source, rows.schema, config)
    source.commit(rows.where(_label(rows) >= 5), parent=base)
    if not staging.maintain(c, source, rows.schema, config)["rescan"]:
        raise AssertionError("the source has diverged")
    return c.rows().select("id", "payload")


_RERANKED = f"""WITH {q._enriched_sql()}, {q._FUSED},
top AS (SELECT id, chunk_text, fusion_score FROM fused ORDER BY fused.fusion_score DESC, id LIMIT 50),
s AS (SELECT *, list_distinct(regexp_extract_all(lower(chunk_text), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM top),
m AS (SELECT *, len(list_filter({sorted(set(q.WORDS.split()))}, lambda x: list_contains(w, x))) / {len(set(q.WORDS.split()))} AS model FROM s),
bi AS (SELECT id, chunk_text, model AS bi_score, 0.5 * model + 0.5 * fusion_score AS fusion_score FROM m)
SELECT id, round(fusion_score, 6) AS fusion_score, round(bi_score, 6) AS bi_score, round(bi_score, 6) AS cross_score, chunk_text FROM bi ORDER BY bi.bi_score DESC, id LIMIT {K}"""


@_query(_RERANKED)
def rerank_lexical(spark: SparkSession, sf: str) -> DataFrame:
    """Both stages with the lexical model, which SQL can express."""
    model = ranking.LexicalScorer()
    out = Pipeline(q._tables(spark, sf), Config(q.AS_OF, rerank=Rerank(model, model))).run(q._candidates(spark, sf), q.WORDS, top_k=K)
    return out.withColumns({c: F.round(c, 6) for c in ("fusion_score", "bi_score", "cross_score")})


@_query(f"WITH {q._ASSIGNED}, u AS (SELECT cluster, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS dim_at FROM a), m AS (SELECT cluster, dim_at, avg(x) AS x FROM u GROUP BY cluster, dim_at), c2 AS (SELECT cluster, list(x ORDER BY dim_at) AS v FROM m GROUP BY cluster), a2 AS (SELECT vec_id, c2.cluster, row_number() OVER (PARTITION BY vec_id ORDER BY list_distance(embedding::DOUBLE[], c2.v), c2.cluster) AS nth FROM embeddings, c2 QUALIFY nth = 1) SELECT CAST(cluster AS INTEGER) AS cluster, count(*) AS n FROM a2 GROUP BY cluster")
def kmeans_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of the clusters after a round of k-means from the first vectors."""
    rows = q._rows(spark, sf)
    return ivf.assign(rows, ivf.kmeans(rows, q.NLIST, rounds=1, first="id")).groupBy("cluster").agg(F.count("*").alias("n"))


#: Payloads of several types, made of the events.
_MIXED = "CASE event_id % 5 WHEN 0 THEN '{\"x\":' || event_id % 7 || '}' WHEN 1 THEN '{\"x\":\"' || event_type || '\"}' WHEN 2 THEN '{\"x\":' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END || '}' WHEN 3 THEN '{\"x\":null}' ELSE '{\"x\":[1,2]}' END"
_TYPED: dict[str, tuple[dict, str]] = {
    "filter_string": ({"op": "eq", "field": "x", "value": "view"}, "event_id % 5 = 1 AND event_type = 'view'"),
    "filter_string_in": ({"op": "in", "field": "x", "value": ["view", "click", 3]}, "event_id % 5 = 1 AND event_type IN ('view', 'click') OR event_id % 5 = 0 AND event_id % 7 = 3"),
    "filter_bool": ({"op": "eq", "field": "x", "value": True}, "event_id % 5 = 2 AND event_id % 2 = 0"),
    "filter_null": ({"op": "eq", "field": "x", "value": None}, "event_id % 5 = 3"),
    "filter_array": ({"op": "eq", "field": "x", "value": [1, 2]}, "event_id % 5 = 4"),
    "filter_gt_mixed": ({"op": "gt", "field": "x", "value": 3}, "event_id % 5 = 0 AND event_id % 7 > 3"),
}


def _typed(predicate: dict) -> q.Query:
    return lambda spark, sf: load(spark, sf, "events").select("event_id", F.expr(_MIXED).alias("payload")).where(matches(F.col("payload"), predicate))


for _name, (_predicate, _where) in _TYPED.items():
    q._QUERIES[_name] = _typed(_predicate)
    q._SQL[_name] = f"SELECT event_id, {_MIXED} AS payload FROM events WHERE {_where}"
