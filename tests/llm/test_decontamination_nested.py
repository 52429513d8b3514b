"""op10: items that stand inside longer ones, letters whose lower case has another length, and odd tables."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.llm import _text, decontaminate


@pytest.mark.parametrize("shard_words", [1_000_000, 12])
def test_nested_items_equal_brute_force(spark, shard_words):
    rng = random.Random(8)
    x = [f"v{rng.randrange(30)}" for _ in range(40)]
    words = [x, x[20:30], x[5:14], [f"u{i}" for i in range(9)]]
    rows = [(1, x[19:30]), (2, ["a", *x[18:30], "b"]), (3, x[20:28]), (4, x[4:15]), (5, x[2:12]), (6, x[0:13])]
    for i in range(40):
        cuts = [(rng.randrange(35), rng.randrange(1, 13)) for _ in range(4)]
        rows.append((10 + i, [w for at, n in cuts for w in (*x[at : at + n], f"z{rng.randrange(9)}")]))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(words)], "item_id long, text string")
    got = {r.doc_id: {i for s in r.spans for i in range(s.start, s.end)} for r in decontaminate.decontaminate(docs, bench, shard_words=shard_words).collect()}
    for i, own in rows:
        gone = set()
        for item in words:
            for a in range(len(own)):
                for b in range(len(item)):
                    n = 0
                    while a + n < len(own) and b + n < len(item) and own[a + n] == item[b + n]:
                        n += 1
                    if n >= 13 or (n >= 8 and n >= 0.5 * len(item)):
                        gone |= set(range(a, a + n))
        assert got[i] == gone, i
    assert got[1] == set(range(1, 11))


def test_letters_that_grow_and_shrink():
    """Offsets are those of the original, whatever the letters of a text and of its neighbours."""
    rng = random.Random(3)
    letters = "aé\u023a\u1e9e\u0130\u212aZß\u03a3\u2c6f \u00e9-\u4e2d"
    for _ in range(1000):
        texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(12))) for _ in range(rng.randrange(1, 5))] + [None, "\u023a \u00e9 x \u00e9 \u1e9e"]
        w = _text.words(pa.array(texts))
        for d, t in enumerate(texts):
            raw = (t or "").encode()
            own = [raw[s - w.base[d] : e - w.base[d]].decode() for s, e in zip(w.starts[w.first[d] : w.first[d + 1]], w.ends[w.first[d] : w.first[d + 1]], strict=True)]
            assert own == (t or "").replace("-", " ").split()
    one, two = (_text.words(pa.array([t])).hashes.tolist() for t in ("\u00c9TÉ \u0130", "été \u0130"))
    assert one == two


def test_spans_between_odd_letters(spark):
    item = "un deux trois quatre cinq six sept huit neuf dix"
    rows = [(1, f"\u023a é {item} é \u1e9e"), (2, f"\u023a é é{item}é é \u1e9e"), (3, item.upper()), (4, None), (5, ""), (6, item), (6, item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"spans": F.lit("s"), "q_text": F.lit(1), "k0": F.lit(2)})
    bench = spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string")
    out = decontaminate.decontaminate(docs, bench, keep=("doc_id", "spans", "q_text", "k0"))
    assert out.columns == ["doc_id", "q_text", "k0", "longest_match", "removed_words", "spans", "contaminated", "text"]
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].text == "\u023a é  é \u1e9e" and got[1].removed_words == 10 and got[1].contaminated
    assert got[2].text == "\u023a é édixé é \u1e9e".replace("édixé", "éun  dixé") and got[2].longest_match == 8
    assert got[3].text == got[6].text == "" and got[4].text is None and got[5].text == "" and not got[5].contaminated
    assert decontaminate.decontaminate(docs, bench.where("false")).where("contaminated").count() == 0
    assert decontaminate.decontaminate(docs.where("false"), bench).count() == 0
