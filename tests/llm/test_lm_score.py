"""The word model of op8 against its definition, in one group of documents and in many, and against its SQL."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import _text, lm_score

SF = "/root/testdata/sf0.001"
END = "\n"


def by_definition(texts):
    """Log-probabilities under the counts of all other texts, by Python dictionaries."""
    counts = [Counter(tuple(t[i : i + k]) for t in texts for i in range(len(t) - k + 1)) for k in (1, 2, 3)]
    words, vocabulary = sum(counts[0].values()), len(counts[0])
    out = []
    for t in texts:
        own = [Counter(tuple(t[i : i + k]) for i in range(len(t) - k + 1)) for k in (1, 2, 3)]
        rest = lambda g, own=own: counts[len(g) - 1][g] - own[len(g) - 1][g]

        def p(g, own=own, rest=rest, t=t):
            if len(g) == 1:
                return (rest(g) + 1) / (words - len(t) + vocabulary)
            return (rest(g) + lm_score.PRIOR * p(g[1:])) / (rest(g[:-1]) + lm_score.PRIOR)

        out.append(sum(math.log(p(tuple(t[max(0, i - 2) : i + 1]))) for i in range(len(t))))
    return out


@pytest.mark.parametrize("group_bytes", [12 << 20, 300])
def test_lm_equals_definition(spark, group_bytes):
    rng = random.Random(6)
    vocabulary = ["the", "of", "cat", "dog", "ran", "7", "été", "ete", "a", "to", "mat", "sat"]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(40)))) for i in range(40)]
    rows += [(90, None), (91, "!? "), (None, "The cat."), (92, "the cat ran " * 50), (92, "the cat ran " * 50), (93, ""), (94, "the cat ran " * 50), (95, " ".join(f"n{i}" for i in range(3000)))]
    docs = spark.createDataFrame([(i, t, 1, "g", 2) for i, t in rows], "doc_id long, text string, k int, grp string, n_words int")
    texts = [(t or "").lower().replace(".", "").replace("!?", "").split() for _, t in rows]
    weights = by_definition([[*t, END] if t else [] for t in texts])
    want = sorted((repr(i), len(t), w) for (i, _), t, w in zip(rows, texts, weights, strict=True))
    got = sorted((repr(r.doc_id), r.n_words, r.log_probability) for r in lm_score.score(docs, group_bytes=group_bytes).collect())
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], rel=1e-9, abs=1e-9)
    assert all(r.perplexity is None for r in lm_score.score(docs).where("n_words = 0").collect())
    assert lm_score.score(docs.where("false")).count() == 0


def test_arcs_of_every_state_sum_to_one():
    """p(w | c) over all words, by the traversal's own weights."""
    rng = np.random.default_rng(1)
    n1 = rng.integers(0, 9, 6)
    n2 = np.stack([rng.multinomial(n, np.ones(6) / 6) for n in n1])
    n3 = np.stack([[rng.multinomial(n, np.ones(6) / 6) for n in row] for row in n2])
    p1 = (n1 + 1) / (n1.sum() + 6)
    for u in range(6):
        for v in range(6):
            rest = [np.array([n1[u], n1[v], n1[w]], float) for w in range(6)]
            sums = [lm_score.traversed([r, np.array([0, n2[u, v], n2[v, w]], float), np.array([0, 0, n3[u, v, w]], float)], np.arange(3), np.array([p1[u], p1[v], p1[w]]), 2.0)[2] for w, r in enumerate(rest)]
            assert np.exp(sums).sum() == pytest.approx(1)


def test_copies_are_told_apart(spark):
    """What a text shares with no other costs more; what is gathered grows with new words."""
    rng = random.Random(2)
    text = lambda: " ".join(f"w{rng.randrange(500)}" for _ in range(80))
    own = [text() for _ in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(own)] + [(100 + i, own[i]) for i in range(5)], "doc_id long, text string")
    got = {r.doc_id: r.perplexity for r in lm_score.score(docs).collect()}
    assert max(got[i] for i in range(5)) < min(got[i] for i in range(5, 40)) / 5
    assert all(got[i] == pytest.approx(got[100 + i]) for i in range(5))
    assert lm_score.size_of(docs) == (45 * 81, len({w for t in own for w in t.split()}) + 1)


def test_lm_equals_sql(spark):
    import duckdb

    from quillon.llm import queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(lm_score.SQL).df()
    got = queries.op8_lm_score(spark, SF).toPandas()[want.columns]
    assert sorted(map(repr, got.values.tolist())) == sorted(map(repr, want.values.tolist()))


def test_packing_of_hashes():
    x = np.sort(_text.mix(np.arange(1000, dtype=np.uint64)))
    assert (lm_score.unpacked(pa.scalar(lm_score.packed(x))) == x).all()
    symbols, first = lm_score.tokens(pa.array(["a b", None, "?", "c"]))
    assert first.tolist() == [0, 3, 3, 3, 5] and (symbols[[2, 4]] == lm_score.END).all()
