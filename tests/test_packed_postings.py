"""Postings are made where the texts are, and moved packed."""

from quillon.operators import fulltext


def test_no_text_is_shuffled(spark):
    rows = spark.createDataFrame([(7, "a b a"), (8, None), (9, ""), (10, "b")], "id long, text string")
    got = fulltext.placed_postings(rows)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    want = [("a", 7, 3, [0, 2]), ("b", 7, 3, [1]), ("b", 10, 1, [0])]
    assert sorted(tuple(r) for r in got.collect()) == want
