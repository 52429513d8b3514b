"""The batched exact search: no product of tables, and no loss to single precision."""

import numpy as np
import pytest

from quillon.functions.distance import pairwise
from quillon.operators import search
from quillon.types import Metric



def test_a_row_passes_each_block_of_queries_once(spark):
    rows = spark.createDataFrame([(i, [float(i % 13), float(i % 7)]) for i in range(300)], "id long, vector array<double>")
    got = search.knn_batch(rows, rows, 3, block=32)
    assert "CartesianProduct" not in got._jdf.queryExecution().toString() and got.count() == 900


@pytest.mark.parametrize("metric", list(Metric))
@pytest.mark.parametrize("scale", [1.0, 1e20, 1e-22])
def test_tiles_lose_nothing(metric, scale):
    rng = np.random.default_rng(3)
    v, ids = rng.standard_normal((500, 16)) * scale, rng.permutation(500)
    v[100:300], v[10] = v[7] * (1 + 1e-12), 0
    own = search.Nearest(metric, ids, v, 5)
    for at in range(0, 500, 90):
        own.meet(ids[at : at + 90], v[at : at + 90])
    for j in range(0, 500, 7):
        d = pairwise(metric, v, v[j])
        assert own.found[j].tolist() == ids[np.lexsort((ids, d))[:5]].tolist()
