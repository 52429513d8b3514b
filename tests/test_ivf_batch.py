"""Approximate search with every row as a query."""

import pytest

from quillon.operators import ivf, search
from quillon.plans import queries


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_ivf_batch_recall(spark, sf):
    exact = {(r.query_id, r.id) for r in queries.queries()["knn_batch"](spark, f"/root/testdata/{sf}").collect()}
    got = queries.queries()["ivf_batch_search"](spark, f"/root/testdata/{sf}").collect()
    found = {(r.query_id, r.id) for r in got}
    assert len(found) == len(got) and {q for q, _ in found} == {q for q, _ in exact}
    recall = len(exact & found) / len(exact)
    print(sf, "recall", recall)
    assert recall >= 0.9


def test_ivf_batch_of_all_clusters_is_exact(spark):
    rows = spark.createDataFrame([(i, [0.1 * i, float(i % 7)]) for i in range(60)] + [(99, None)], "id long, vector array<double>")
    centroids = ivf.kmeans(rows, 5)
    got = sorted((r.query_id, r.rank, r.id) for r in ivf.search_batch(ivf.assign(rows, centroids), centroids, rows, 3, 5).collect())
    at = {i: (0.1 * i, i % 7) for i in range(60)}
    want = [(q, n + 1, i) for q in at for n, i in enumerate(sorted(at, key=lambda i: (sum((a - b) ** 2 for a, b in zip(at[i], at[q], strict=True)) ** 0.5, i))[:3])]
    assert len(got) == len(want) and sum(g != w for g, w in zip(got, sorted(want), strict=True)) == 0


def test_a_large_cluster_streams_past_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(ivf, "BLOCK", 16)
    rows = spark.createDataFrame([(i, [float(i % 17), 0.25 * i]) for i in range(200)], "id long, vector array<double>")
    centroids = ivf.kmeans(rows, 2)
    got = ivf.search_batch(ivf.assign(rows, centroids), centroids, rows, 3, 2)
    plan = got._jdf.queryExecution().toString()
    assert "CoGroup" not in plan and {(r.query_id, r.id) for r in got.collect()} == {(r.query_id, r.id) for r in search.knn_batch(rows, rows, 3).collect()}
