"""The corpus operators against brute force, round trips, SQL and held-out accuracy."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.llm import _text, decontaminate, line_dedup, lm_score, near_dedup, packing, quality, substring_dedup, toxicity, url_filter, warc
from quillon.llm._shared import Scratch

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, id string, tag int, h string, unit string, sig string, part string, removed_lines string, score string, n_chars long"


def frame(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", 1, "h", "u", "s", "p", "r", "q", len(t or "")) for i, t in rows], DOCS)


def sentence(rng, n):
    return " ".join(f"w{rng.randrange(400)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty texts, only punctuation, repeated rows, equal texts and a very long one."""
    long = sentence(random.Random(5), 60_000)
    return frame(spark, [(None, "one two three"), (1, None), (2, ""), (3, "a b c d"), (3, "a b c d"), (4, "a b c d"), (5, "!!! ..."), (6, long), (7, "line\n" * 5), (None, None)])


@pytest.fixture(scope="module")
def corpus(spark):
    """Copies, near copies and shared passages among texts of their own."""
    rng = random.Random(1)
    base = [sentence(rng, 120) for _ in range(12)]
    shared = sentence(rng, 70)
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(20 + i, base[i]) for i in range(3)]
    for i in range(4):
        words = base[5].split()
        words[10 * i + 3] = "changed"
        rows.append((30 + i, " ".join(words)))
    rows += [(40 + i, sentence(rng, 20 + i) + " " + shared + " " + sentence(rng, 30)) for i in range(4)]
    # 51 and 52 share more with each other than with 50, which has the passage first
    tail = sentence(rng, 40)
    rows += [(50, sentence(rng, 9) + " " + " ".join(shared.split()[:40]) + " " + sentence(rng, 9)), (51, "q " + " ".join(shared.split()[:40]) + " " + tail), (52, "r " + " ".join(shared.split()[:40]) + " " + tail)]
    rows += [(60, shared + " " + sentence(rng, 5) + " " + shared)]
    return rows


def grams(words, n):
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]


def test_substring_dedup_covers_all_repeats(spark, corpus):
    got = substring_dedup.repeated_passages(frame(spark, corpus)).collect()
    texts = {i: t.split() for i, t in corpus}
    first, expected = {}, set()
    for i in sorted(texts):
        for p, g in enumerate(grams(texts[i], 50)):
            if g in first:
                expected.update((i, p + j) for j in range(50))
            first.setdefault(g, (i, p))
    covered = set()
    for r in got:
        a, b = texts[r.doc_id], texts[r.first_doc_id]
        s, e, f = r.start_word, r.end_word, r.first_start_word
        assert e - s >= 50 and (r.first_doc_id, f) < (r.doc_id, s)
        assert a[s:e] == b[f : f + e - s]
        assert s == 0 or f == 0 or a[s - 1] != b[f - 1]
        assert e == len(a) or f + e - s == len(b) or a[e] != b[f + e - s]
        covered.update((r.doc_id, j) for j in range(s, e))
    assert covered == expected and expected


def test_substring_dedup_diagonal_of_minus_one(spark):
    rng = random.Random(3)
    p = sentence(rng, 60)
    got = substring_dedup.repeated_passages(frame(spark, [(1, "x y " + p), (2, "z " + p)])).collect()
    assert [(r.doc_id, r.start_word, r.n_words, r.first_start_word) for r in got] == [(2, 1, 60, 2)]


def test_near_duplicates_equal_brute_force(spark, corpus):
    rows = [*corpus, (70, corpus[0][1]), (71, "a b"), (72, "a b"), (73, None), (74, "?"), (75, "?")]
    docs = frame(spark, rows).withColumns({"q_id": F.lit("x"), "q_tag": F.lit("y"), "uid": F.lit(1)})
    got = {r.doc_id: (r.class_id, r.links) for r in near_dedup.near_duplicates(docs).collect()}
    ids = [i for i, t in rows if t and t != "?"]
    _, sig = near_dedup.signatures_of(pa.array([t for _, t in rows]), 64, 3)
    agree = {(a, b): int((sig[x] == sig[y]).sum()) for x, a in enumerate(ids) for y, b in enumerate(ids) if a < b}
    linked = {p: n for p, n in agree.items() if n >= near_dedup.LEAST}
    root = {i: i for i, _ in rows}
    for _ in rows:
        for a, b in linked:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {i: (root[i], sum(i in p for p in linked)) for i, _ in rows}
    # pairs of the first of each class of equal signatures
    first = {}
    for i, s in zip(ids, map(bytes, sig), strict=True):
        first.setdefault(s, []).append(i)
    firsts = {m[0]: len(m) for m in first.values()}
    pairs = {(r.doc_a, r.doc_b): (r.n_a, r.n_b, r.matches) for r in near_dedup.near_pairs(docs).collect()}
    assert pairs == {(a, b): (firsts[a], firsts[b], n) for (a, b), n in linked.items() if a in firsts and b in firsts}
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id: (r.q_id, r.q_tag, r.uid) for r in kept.collect()} == {i: ("x", "y", 1) for i, _ in rows if root[i] == i}


def test_components_of_long_chains(spark):
    """Classes are whole however far their ends are apart."""
    edges = [(i, i + 1) for i in range(40)] + [(100, 103), (101, 103), (102, 100)]
    pairs = spark.createDataFrame([(min(e), max(e)) for e in edges], "a long, b long")
    got = {r.node: r.root for r in near_dedup._components(pairs, Scratch(spark, "t")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100, 102: 100, 103: 100}
    assert near_dedup._components(pairs.where("false"), Scratch(spark, "t")).count() == 0


def test_line_dedup_equals_sql(spark):
    import duckdb

    got = line_dedup.dedup_lines(spark.read.parquet(f"{SF}/documents.parquet")).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(line_dedup.SQL).df()
    assert sorted(map(tuple, got[want.columns].values.tolist())) == sorted(map(tuple, want.values.tolist()))
    assert (want.removed_lines > 0).any()


def test_line_dedup_cases(spark):
    run = "alpha\nbeta\ngamma"
    rows = [(1, run + "\none"), (2, "two\n" + run), (3, "  alpha \n\nbeta\ngamma\r"), (4, run + "\nx\n" + run), (None, "zero\n" + run)]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert got[None].text == "zero\n" + run
    assert got[1].text == "one" and got[2].text == "two" and got[3].text == ""
    assert got[4].text == "x" and got[4].removed_lines == 6 and got[4].n_chars == 1


@pytest.mark.parametrize("name", ["op4_url_filter", "op5_quality_rules"])
def test_sql_expressible_queries(spark, name):
    import duckdb

    from quillon.llm import queries

    con = duckdb.connect()
    for t in ("pages", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, SF).toPandas()[want.columns]
    rows = lambda d: sorted(repr([x.tolist() if hasattr(x, "tolist") else x for x in r]) for r in d.itertuples(index=False))
    assert rows(got) == rows(want)


def test_url_filter_has_no_false_result(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 50}.example.com/p{i}") for i in range(3000)] + [(None, None), (-1, ""), (-2, "HTTP://WWW.h1.example.com:80/p1/?utm_x=1#f")], "page_id long, url string")
    listed = pages.where("page_id % 7 = 1").select("url")
    got = {r.page_id: r.listed for r in url_filter.flag_listed(pages, listed).collect()}
    assert got == {i: i % 7 == 1 for i in range(3000)} | {None: False, -1: False, -2: True}
    exact = {r.page_id: r.listed for r in url_filter.flag_listed(pages, listed, broadcast_bytes=1).collect()}
    assert exact == got
    # some pages pass the filter that aren't listed: the exact join removes them
    h = F.xxhash64("u")
    exact = listed.select(url_filter.canonical(F.col("url")).alias("u")).distinct()
    words = url_filter.bloom(exact.withColumnRenamed("u", "url"), exact.count() // url_filter.PER_BLOCK + 1)
    probe = pages.select(url_filter.canonical(F.col("url")).alias("u")).distinct().join(words, url_filter._block(h, exact.count() // url_filter.PER_BLOCK + 1) == F.col("block"))
    for i, salt in enumerate(url_filter.SALTS):
        probe = probe.where(F.call_function("shiftright", F.col(f"w{i}"), url_filter._bit(h, salt)).bitwiseAND(1) == 1)
    assert exact.count() < probe.count() < 1.1 * exact.count() + 200
    none = url_filter.flag_listed(pages, listed.where("false"))
    assert none.count() == 3003 and none.where("listed").count() == 0


def test_warc_round_trip(spark, tmp_path):
    rows = [(i, f"http://e.org/{i}", "<p>" + "some words again " * (i % 9) + "</p>") for i in range(60)] + [(None, None, None), (7, "", ""), (7, "", ""), (8, "u", "x" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("frame", F.lit(1)).repartition(2)
    got = warc.archive_frames(pages, archive_bytes=20_000).collect()
    archives = {}
    for r in sorted(got, key=lambda r: (r.archive, r.seq)):
        assert r.offset == len(archives.get(r.archive, b"")) and r.length == len(r.frame)
        archives[r.archive] = archives.get(r.archive, b"") + bytes(r.frame)
    records = sorted(x for a in archives.values() for x in warc.read_archive(a))
    assert records == sorted(warc.record(*r) for r in rows)
    # a dictionary that serves one record at its offset, without the others
    r = next(r for r in got if r.kind == "record")
    head = next(x for x in got if x.archive == r.archive and x.seq == 0)
    assert warc.read_archive(bytes(head.frame) + bytes(r.frame)) == [warc.record(*next(x for x in rows if x[0] == r.page_id))] or r.page_id == 7
    done = warc.write_archives(warc.archive_frames(pages, archive_bytes=20_000), str(tmp_path)).collect()
    assert sum(d.records for d in done) == len(rows)
    assert warc.archive_frames(pages.where("false")).count() == 0


def test_packing_is_valid_and_tight(spark):
    rng = random.Random(2)
    rows = [(i, sentence(rng, rng.choice([3, 40, 300, 900, 1300, 5000]))) for i in range(400)]
    places = packing.pack(frame(spark, rows), capacity=1500, rounds=300).collect()
    texts = {i: t.split() for i, t in rows}
    used, cover = {}, {}
    for r in places:
        used[r.bin] = used.get(r.bin, 0) + r.n_words
        cover.setdefault(r.doc_id, []).append((r.start_word, r.n_words))
    assert max(used.values()) <= 1500
    assert len({(r.bin, r.slot) for r in places}) == len(places)
    for i, spans in cover.items():
        at = 0
        for s, n in sorted(spans):
            assert s == at
            at += n
        assert at == len(texts[i])
    assert set(cover) == set(texts)
    # against the linear program's own lower bound, and best fit decreasing
    rooms, pieces = [], sorted((r.n_words for r in places), reverse=True)
    for p in pieces:
        fits = [i for i, x in enumerate(rooms) if x >= p]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= p
        else:
            rooms.append(1500 - p)
    bound = packing.solve({p: pieces.count(p) for p in pieces}, 1500, 300).bound
    assert bound <= len(used) <= 1.02 * min(len(rooms), bound * 1.05) + 1


def test_packing_in_parts(spark):
    """Lengths of many pieces are ranked in parts, repeated rows and short texts are packed without waste."""
    docs = frame(spark, [(i, "one two") for i in range(50)] + [(7, "x y")] * 46)
    got = packing.pack(docs, capacity=8, rounds=20, part_pieces=9).collect()
    assert len(got) == 96 and len({(r.bin, r.slot) for r in got}) == 96 and len({r.bin for r in got}) == 24


def test_packing_bound_and_pricing():
    assert packing.priced(np.array([3.0, 4.0]), np.array([2, 3]), 7) == ({0: 2, 1: 1}, 10.0)
    rng = np.random.default_rng(3)
    for _ in range(60):
        sizes = np.unique(rng.integers(1, 40, rng.integers(1, 12)))
        prices, capacity = rng.random(len(sizes)) * sizes, int(rng.integers(sizes[0], 120))
        best = np.zeros(capacity + 1)
        for c in range(1, capacity + 1):
            best[c] = max([best[c - 1], *(best[c - s] + p for s, p in zip(sizes, prices, strict=True) if s <= c)])
        config, worth = packing.priced(prices, sizes, capacity)
        assert worth == pytest.approx(best[capacity]) == pytest.approx(sum(prices[i] * n for i, n in config.items()))
        assert sum(sizes[i] * n for i, n in config.items()) <= capacity
    plan = packing.solve({6: 30, 4: 30, 5: 20}, 10, 200)
    assert plan.bound <= 40 + 1e-6 and plan.bins <= 42
    assert packing.solve({}, 10).bins == 0


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(4)
    items = [sentence(rng, n) for n in (30, 12, 16, 5)]
    words = [i.split() for i in items]
    rows = [(1, sentence(rng, 40)), (2, "a " + items[0] + " b"), (3, "x, " + " ".join(words[1][:8]).upper() + " y"), (4, " ".join(words[0][:10]) + " z"), (5, items[3] + " " + items[3]), (6, None), (7, ""), (8, sentence(rng, 5) + " " + " ".join(words[2][3:12]) + " and " + items[1])]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate([*items, None, ""])], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(frame(spark, rows), bench).collect()}
    for i, text in rows:
        own = (text or "").lower().replace(",", "").split()
        gone, longest = set(), 0
        for item in (w for w in words if len(w) >= 8):
            for a in range(len(own)):
                for b in range(len(item)):
                    n = 0
                    while a + n < len(own) and b + n < len(item) and own[a + n] == item[b + n]:
                        n += 1
                    if n >= 8:
                        longest = max(longest, n)
                    if n >= 13 or (n >= 8 and n >= 0.5 * len(item)):
                        gone |= set(range(a, a + n))
        assert got[i].removed_words == len(gone), i
        assert got[i].longest_match == longest
        assert {x for s in got[i].spans for x in range(s.start, s.end)} == gone
    assert got[2].text == "a  b" and got[3].text == "x,  y" and got[6].text is None and got[1].text == rows[0][1]


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    fitted = labels.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) > 0)
    model = toxicity.fit(docs, fitted)
    test = labels.join(fitted, "doc_id", "left_anti").select("doc_id", F.col("toxic").alias("truth"))
    got = {(r.toxic, r.truth): r["count"] for r in toxicity.score(docs, model).join(test, "doc_id").groupBy("toxic", "truth").count().collect()}
    recall = got[True, 1] / (got[True, 1] + got.get((False, 1), 0))
    precision = got[True, 1] / (got[True, 1] + got.get((True, 0), 0))
    assert recall > 0.7 and precision > 0.8
    assert len(model.index) < 20_000


def test_toxicity_without_labels(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.fit(odd, labels) is None
    assert toxicity.score(odd, None).where("toxic").count() == 0
    assert toxicity.score(odd, None, passing=True).columns == odd.columns


def test_quality_rules(spark):
    rows = [(1, None), (2, ""), (3, "the cat is on the mat " * 10), (4, "#$% " * 40), (5, "- a\n" * 40)]
    got = {r.doc_id: r for r in quality.judge(frame(spark, rows)).collect()}
    assert got[1].failed == got[2].failed == ["few_words"]
    assert "symbols" in got[4].failed and "bullets" in got[5].failed and "symbols" not in got[3].failed


def test_odd_rows_and_empty_tables(spark, odd):
    bench = spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9")], "item_id long, text string")
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 1), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    every = {
        "packing": lambda d: packing.pack(d, rounds=50),
        "substring": substring_dedup.repeated_passages,
        "lines": line_dedup.dedup_lines,
        "near": near_dedup.near_duplicates,
        "near_drop": near_dedup.drop_near_duplicates,
        "lm": lm_score.score,
        "toxicity": lambda d: toxicity.score(d, toxicity.fit(d, labels)),
        "quality": quality.judge,
        "leaks": lambda d: decontaminate.decontaminate(d, bench),
    }
    n = {name: f(odd).count() for name, f in every.items()}
    assert n["lines"] == n["lm"] == n["toxicity"] == n["quality"] == n["leaks"] == 10
    assert n["near"] == 9 and n["near_drop"] == 8 and n["substring"] == 0
    assert n["packing"] == 1 + 2 + 1 + 1 + 30 + 1
    assert {name: f(odd.where("false")).count() for name, f in every.items()} == dict.fromkeys(every, 0)


def test_words_across_texts_and_blocks():
    w = _text.words(pa.array(["Ab cd", None, "", "ab", "ÉTÉ été"]))
    assert np.diff(w.first).tolist() == [2, 0, 0, 1, 2]
    assert w.hashes[0] == w.hashes[2] and w.hashes[3] == w.hashes[4]
    long = _text.words(pa.array(["x" * ((1 << 20) - 3) + " straddling " + "y" * 99, "straddling"]))
    assert long.hashes[1] == long.hashes[3]
