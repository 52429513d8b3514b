"""The corpus pipeline, stage by stage and as a whole."""

import os
import random

import corpus_pipeline
from quillon.sources.files import shared_dir


def sentence(rng, n):
    return " ".join(f"w{rng.randrange(900)}" for _ in range(n))


def folder(spark, path, docs, labels, bench):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(9)
    row = lambda i, t: (i, t, "en", "s", len(t or ""))
    clean = {i: sentence(rng, 80) for i in range(40)}
    item, run = sentence(rng, 30), "\n".join(sentence(rng, 12) for _ in range(4))
    toxic = {100 + i: sentence(rng, 30) + " idiot scum " + sentence(rng, 30) for i in range(40)}
    docs = {**clean, **toxic, 200: clean[3], 201: clean[4] + " more", 202: sentence(rng, 60) + "\n" + run, 203: sentence(rng, 60) + "\n" + run, 204: sentence(rng, 50) + " " + item + " " + sentence(rng, 50), 205: None, 206: ""}
    labels = [(i, 1, int(i >= 100)) for i in [*clean, *toxic] if i % 100 < 30]
    path = folder(spark, str(tmp_path / "t"), [row(i, t) for i, t in docs.items()], labels, [(0, item)])
    kept = spark.read.parquet(f"{path}/documents.parquet")
    columns, seen = kept.columns, []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept, path)
        if name != "packing":
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{n}")
        kept = spark.read.parquet(f"{tmp_path}/{n}")
        seen.append({r.doc_id: r for r in kept.collect()})
    assert set(seen[0]) == set(docs) - set(toxic)
    assert run not in seen[1][203].text and run in seen[1][202].text
    assert set(seen[2]) == set(seen[1]) - {200, 201}
    assert item not in seen[3][204].text and seen[3][204].n_chars == len(seen[3][204].text)
    assert all(seen[3][i].text == t for i, t in clean.items())
    assert {i for i in seen[4]} == {i for i, r in seen[3].items() if r.text}
    made = lambda: set(os.listdir(shared_dir(spark).removeprefix("file://")))
    before = made()
    whole = corpus_pipeline.run(spark, path)
    # what the stages wrote on their way is gone
    assert {n.partition("-")[0] for n in made() - before} == {"pipeline"}
    assert sorted(whole.collect()) == sorted(kept.collect())


def test_long_texts_and_ties(spark, tmp_path):
    """A very long text passes whole; of equal texts, the one of the smaller id stays."""
    rng = random.Random(11)
    long, short = " ".join(f"w{rng.randrange(90000)}" for _ in range(200_000)), sentence(rng, 7)
    path = folder(spark, str(tmp_path / "t"), [(2, long, "en", "s", len(long)), (1, long, "en", "s", len(long)), (None, short, "en", "s", 1), (5, short, "en", "s", 1)], [], [])
    got = corpus_pipeline.run(spark, path).collect()
    assert {r.doc_id for r in got} == {None, 1} and sum(r.n_words for r in got if r.doc_id == 1) == 200_000


def test_odd_tables(spark, tmp_path):
    names = "doc_id long, text string, lang string, removed_lines int, contaminated string, spans string, n_chars int, id long, rank int"
    odd = [(None, "a b c\n\n", None, 1, "x", "y", 7, 1, 1), (1, None, "en", 1, "x", "y", None, 1, 1), (2, "", "en", None, None, None, 0, None, 1), (3, "a b", "en", 1, "x", "y", 3, 1, 1), (3, "a b", "en", 1, "x", "y", 3, 1, 1)]
    path = folder(spark, str(tmp_path / "t"), [], [], [])
    for rows, left in ((odd, 4), ([], 0)):
        kept = spark.createDataFrame(rows, names)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, kept, path)
            assert out.columns == kept.columns
            kept = out
        assert kept.count() == left
        assert all(r.removed_lines == 1 for r in kept.collect() if r.doc_id == 3)
    assert corpus_pipeline.run(spark, path).count() == 0
