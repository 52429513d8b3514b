"""The engine's operators against small goldens, sequential replays and exact search."""

import os
import random
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from quillon.functions.predicate import matches
from quillon.functions.text import deep_text
from quillon.operators import fulltext, ivf, ranking, search
from quillon.plans import queries
from quillon.plans.engine import Engine
from quillon.plans.pipeline import Config, Fusion, Pipeline, Rerank, Tables
from quillon.streaming import staging
from quillon.streaming.compaction import compact
from quillon.streaming.log import ChangeLog, frames, read_frames
from quillon.types import CollectionExists, CollectionNotFound, DimMismatch, EngineError, Hnsw, InvalidArgument, Ivf, SnapshotDiverged

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"


def ids(df):
    return [r.id for r in df.collect()]


def vectors(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v], p) for i, v, p in rows], "id long, vector array<float>, payload string")


@pytest.mark.parametrize(
    ("predicate", "want"),
    [
        ({"op": "eq", "field": "cost", "value": 17.5}, {2}),
        ({"op": "eq", "field": "rank", "value": 2}, {2}),
        ({"op": "eq", "field": "rank", "value": 2.0}, set()),
        ({"op": "ne", "field": "tag", "value": "shoes"}, {1, 3, 4, 6}),
        ({"op": "exists", "field": "cost"}, {1, 2, 3}),
        ({"op": "exists", "field": "none"}, {6}),
        ({"op": "eq", "field": "none", "value": None}, {6}),
        ({"op": "gt", "field": "cost", "value": 10}, {2, 3}),
        ({"op": "lte", "field": "text", "value": 100}, set()),
        ({"op": "in", "field": "tag", "value": ["shoes", 1]}, {2}),
        ({"op": "eq", "field": "a.b", "value": 1}, {6}),
        ({"op": "and", "filters": []}, {1, 2, 3, 4, 6}),
        ({"op": "or", "filters": []}, set()),
        ({"op": "and"}, set()),
        ({"op": "eq", "field": "tag"}, set()),
        ({"field": "tag", "value": "shoes"}, set()),
        ({"op": "eq", "field": "list", "value": [1, {"x": 2}]}, {6}),
    ],
)
def test_predicates(spark, predicate, want):
    rows = [(1, '{"cost":4.5,"tag":"hats","rank":1}'), (2, '{"cost":17.5,"tag":"shoes","rank":2}'), (3, '{"cost":31.0,"tag":"hats","rank":3}'), (4, '{"other":true}'), (5, None), (6, '{"none":null,"text":"12","a.b":1,"list":[1,{"x":2}]}')]
    df = spark.createDataFrame(rows, "id long, payload string")
    assert {r.id for r in df.where(matches(F.col("payload"), predicate)).collect()} == want


def test_knn(spark):
    rows = vectors(spark, [(i, [i, 0, 0, 0], f'{{"parity":"{["even", "odd"][i % 2]}"}}') for i in range(20)])
    assert ids(search.knn(rows, [3.2, 0, 0, 0], 3)) == [3, 4, 2]
    assert ids(search.knn(rows, [3.2, 0, 0, 0], 3, predicate={"op": "eq", "field": "parity", "value": "even"})) == [4, 2, 6]
    assert ids(search.knn(rows, [1, 0, 0, 0], 2, "dot")) == [19, 18]
    assert search.knn(rows, [1, 0, 0, 0], 0).count() == 0
    assert search.knn(rows, [0, 0, 0, 0], 99, "cosine").where("score = 1.0").count() == 20


def test_batch_equals_single(spark):
    rng = random.Random(1)
    rows = vectors(spark, [(i, [rng.random() for _ in range(8)], None) for i in range(150)] + [(200, [0.5] * 8, None), (201, [0.5] * 8, None)])
    for metric in ("l2", "cosine", "dot"):
        got = search.knn_batch(rows, rows, 5, metric, block=32).where("query_id = 7").orderBy("rank").collect()
        assert [r.id for r in got] == ids(search.knn(rows, list(rows.where("id = 7").first().vector), 5, metric))


def test_graph_recall(spark):
    exact = {(r.query_id, r.id) for r in queries.knn_batch(spark, SF).collect()}
    found = {(r.query_id, r.id) for r in queries.hnsw_search(spark, SF).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_ivf_and_codes(spark):
    rows = vectors(spark, [(i, [0.1 * i, i % 7, 0, 0], None) for i in range(100)])
    centroids = ivf.kmeans(rows, 8)
    assigned = ivf.assign(rows, centroids)
    assert ids(ivf.search(assigned, centroids, [3, 1, 0, 0], 5, 8)) == ids(search.knn(rows, [3, 1, 0, 0], 5))
    codes = vectors(spark, [(i, [i, 2 * i, 0.5, -1 + 0.1 * i], None) for i in range(8)])
    q = ivf.sq8_fit(codes)
    worst = max(q.first().scale)
    own = {r.id: r.vector for r in codes.collect()}
    for r in ivf.sq8_rows(codes, q).collect():
        assert max(abs(a - b) for a, b in zip(r.vector, own[r.id], strict=True)) <= worst


def test_text_and_fusion(spark):
    one = spark.createDataFrame([('{"metadata":{"title":"deep nested text","tags":["rust","search"]}}',), (None,), ("{",)], "p string")
    assert [r.t for r in one.select(deep_text("p").alias("t")).collect()] == ["deep nested text rust search", None, None]
    docs = spark.createDataFrame([(i, f"generic document number {i}") for i in range(60)] + [(77, "special special phrase here"), (78, "special other"), (79, None)], "id long, text string")
    assert ids(fulltext.bm25(docs, "special", 5)) == [77, 78]
    assert ids(fulltext.bm25(docs, "special -other")) == [77]
    assert ids(fulltext.bm25(docs, '"phrase here"')) == [77]
    assert ids(fulltext.bm25(docs, "generic AND 7", 3)) == [7]
    assert fulltext.bm25(docs, "  ").count() == 0
    with pytest.raises(InvalidArgument):
        fulltext.parse('"open')
    near = spark.createDataFrame([(0, 0.1), (99, 0.2), (3, 0.3)], "id long, score double")
    found = spark.createDataFrame([(1, 9.0), (99, 8.0)], "id long, score double")
    assert ids(fulltext.fuse_ranks(near, found, 4)) == [99, 0, 1, 3]


def test_log_equals_sequential_replay(spark, tmp_path):
    rng, state, log = random.Random(3), {}, []
    for lsn in range(1, 301):
        i, op = rng.randrange(12), "delete" if rng.random() < 0.3 else "upsert"
        payload = f'{{"n":{lsn}}}' if op == "upsert" and rng.random() < 0.5 else None
        log.append((lsn, i, op, [float(lsn)] if op == "upsert" else None, payload))
        if op == "delete":
            state.pop(i, None)
        else:
            state[i] = (float(lsn), payload or state.get(i, (0, None))[1])
    df = spark.createDataFrame(log, "lsn long, id long, op string, vector array<float>, payload string")
    want = {i: s for i, s in state.items()}
    read = lambda d: {r.id: (r.vector[0], r.payload) for r in d.collect()}
    assert read(compact(df.unionByName(df))) == want
    own = ChangeLog(spark, str(tmp_path / "c"))
    for part in range(3):
        own.append(df.where((F.col("lsn") > 100 * part) & (F.col("lsn") <= 100 * part + 100)).withColumn("seq", F.col("lsn")))
        if part == 1:
            own.checkpoint()
    assert own.last_lsn() == 300 and read(own.state()) == want
    stage = staging.Staging(spark, str(tmp_path / "s"))
    for _ in range(2):
        assert staging.flush(own, stage, 0) == 300
    assert stage.rows().count() == 300
    own.checkpoint(grace_ms=0)
    assert read(own.state()) == want and own.segments() == []


def test_frames():
    data = frames([b"one", b"two"])
    assert list(read_frames(data)) == list(read_frames(data + b"\x09\0")) == [b"one", b"two"]
    assert list(read_frames(data[:-1] + b"x")) == [b"one"]
    with pytest.raises(EngineError):
        list(read_frames(data[:8] + b"x" + data[9:]))


def test_snapshot_delta(spark, tmp_path):
    rows = lambda *x: vectors(spark, [(i, [i], None) for i in x])
    t = staging.SnapshotTable(spark, str(tmp_path))
    a = t.commit(rows(1, 2, 3, 4).coalesce(1))
    b = t.commit(rows(1, 3, 5), removed_files=t._manifest(a)["files"])
    schema = rows(1).schema
    assert {(r.op, r.id) for r in t.scan_delta(schema, a, b).collect()} == {("delete", 2), ("delete", 4), ("upsert", 1), ("upsert", 3), ("upsert", 5)}
    assert t.scan_delta(schema, None, b).count() == 3 and t.scan_delta(schema, b, b).count() == 0
    with pytest.raises(SnapshotDiverged):
        t.scan_delta(schema, t.commit(rows(9), parent=a), b)


@pytest.mark.parametrize("index", [None, Ivf(4, 4), Ivf(4, 4, sq8=True), Hnsw(4, 20, 20)])
def test_collection(spark, tmp_path, index):
    engine = Engine(spark, str(tmp_path), parquet_root=str(tmp_path / "files"))
    c = engine.create_collection("c", 3, index=index, fts=True)
    with pytest.raises(CollectionExists):
        engine.create_collection("c", 3)
    c.upsert(vectors(spark, [(i, [i, 1, 0], f'{{"body":"word{i} common"}}') for i in range(12)]))
    c.delete(spark.createDataFrame([(3,), (99,)], "id long"))
    c = engine.collection("c")
    assert c.count() == 11 and c.info()["dim"] == 3 and engine.list_collections() == ["c"]
    c.build_index()
    assert ids(c.search([3.2, 1, 0], 2)) == [4, 2]
    assert ids(c.search_text("word7")) == [7]
    assert ids(c.hybrid_search([7, 1, 0], "word7", 1)) == [7]
    assert [r.id for r in c.get_batch([5, 3, 4]).collect() if r.vector is not None] == [5, 4]
    engine.export_parquet("c", "out.parquet")
    d = engine.create_collection("d", 3)
    assert engine.import_parquet("d", "out.parquet", payload_columns=("payload",)) == 11
    assert ids(d.search([3.2, 1, 0], 2)) == [4, 2]
    with pytest.raises(InvalidArgument):
        engine.export_parquet("c", "../out.parquet")
    with pytest.raises(DimMismatch):
        c.search([1.0], 1)
    with pytest.raises(InvalidArgument):
        c.search([3.2, 1, 0], 1025)
    engine.drop_collection("d")
    with pytest.raises(CollectionNotFound):
        engine.collection("d")


def test_pipeline_settings_and_rerank(spark):
    for bad in (lambda: Fusion(0.9, 0.3), lambda: Fusion(decay=0), lambda: Rerank(alpha=1), lambda: Config(0, top_n=1, top_m=2)):
        with pytest.raises(InvalidArgument):
            bad()
    with pytest.raises(InvalidArgument):
        ranking.check_teams(["a'b"])
    make = spark.createDataFrame
    tables = Tables(
        make([(f"c{i}", f"d{i}", f"text {i}") for i in range(4)], "chunk_id string, doc_id string, chunk_text string"),
        make([(f"d{i}", "a1", 1.6e9) for i in range(4)], "id string, author_id string, created_at double"),
        make([("a1", 0.9, True)], "id string, reputation_score double, is_verified boolean"),
        make([("d0", "public"), ("d1", "restricted"), ("d2", "public"), ("d3", "public")], "doc_id string, sensitivity_label string"),
        make([("d0", ["eng", "ml"]), ("d1", ["eng"]), ("d2", ["ml"]), ("d3", ["eng"])], "doc_id string, allowed_teams array<string>"),
    )
    cand = make([(f"c{i}", 0.1 * i, i + 1) for i in range(4)], "id string, ann_distance double, ann_rank long")
    assert ids(Pipeline(tables, Config(1.7e9)).run(cand, "q")) == ["c0", "c2", "c3"]
    assert ids(Pipeline(tables, Config(1.7e9)).run(cand, "q", ("ml",))) == ["c0", "c2"]
    assert Pipeline(tables, Config(1.7e9)).run(cand, "q", ("data",)).count() == 0
    model = ranking.LexicalScorer()
    assert ids(Pipeline(tables, Config(1.7e9, rerank=Rerank(model, model))).run(cand, "text 3"))[0] == "c3"


def test_queries_without_the_corpus_subpackage(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns("llm", ".git", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'knn_l2' in q and not [n for n in q if n.startswith('op')]; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env={**os.environ, "PYTHONPATH": str(tmp_path / "r")})
