"""LM scoring: a weighted backoff automaton over all words of the corpus.

The symbols are the words of the corpus (see :mod:`._text`) and an end of text,
so the vocabulary and the n-grams grow with the input; nothing is cut off. Every
document is scored by the model of all *other* documents: its own occurrences
are taken out of the counts first, so that a text is predicted, not recalled.

With n' for counts so reduced, V words in the vocabulary and N in the corpus,
the smoothed probabilities are those of a hierarchical Dirichlet prior::

    p(w)     = (n'(w) + 1) / (N' + V)
    p(w | c) = (n'(c w) + PRIOR * p(w | c less its first word)) / (n'(c) + PRIOR)

Each context c is a state; an arc for every word that n' knows after c carries
log p(w | c), and the failure arc to the state of c less its first word carries
log(PRIOR / (n'(c) + PRIOR)), which makes the arcs of every state sum to 1. A
text is traversed once from left to right: each word follows failure arcs until
there is an arc for it, adds up their weights, and leaves the next state.

The automaton of a whole corpus fits nowhere, so it is sharded by documents: a
group of some MB of text needs only the n-grams that it holds. Groups send them
as sorted blocks of hashes, one for each range of hashes; a range is merged in
one place and answers every block with the counts in the whole corpus, in the
block's own order. What moves is proportional to the text, a frequent n-gram
once for each group, and nothing is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._shared import pieces

#: Order of the model, weight of the shorter context's probability, bytes of text in a group, and in what a task packs at a time.
ORDER, PRIOR, GROUP_BYTES, PACK_BYTES = 3, 2.0, 8 << 20, 32 << 20
#: Bits of an n-gram's hash.
BITS = 60
#: Stands for the end of a text.
END = np.uint64(0x0123456789ABCDEF)
_MUL = np.uint64(0x9E3779B97F4A7C15)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, first of each text): the words' hashes, and END after those of a text that has any."""
    w = _text.words(column)
    n = np.diff(w.first)
    some = n > 0
    out = np.insert(w.hashes, w.first[1:][some], END)
    return out, np.concatenate([[0], np.cumsum(n + some)])


def grams(symbols: np.ndarray, order: int) -> list[np.ndarray]:
    """For each order from 1 the hash of the n-gram that ends at each symbol, whatever text it begins in.

    Hashes have BITS bits: of 10^13 different n-grams, 9 in a million share theirs.
    """
    out = [_text.mix(symbols)]
    for _ in range(1, order):
        before = np.concatenate([np.zeros(min(1, len(symbols)), np.uint64), out[-1][:-1]])
        out.append(_text.mix(before * _MUL + symbols))
    return [x >> np.uint64(64 - BITS) for x in out]


def _place(sizes: np.ndarray) -> np.ndarray:
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def packed(x: np.ndarray) -> bytes:
    """The bytes by significance, which compresses better."""
    return zstandard.compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(len(x), 8).T).tobytes(), 1)


def unpacked(raw: pa.Scalar) -> np.ndarray:
    """Undoes :func:`packed`, of a binary scalar."""
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(raw.as_buffer()), np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _sorted_block(known: np.ndarray) -> bytes:
    return packed(np.diff(known, prepend=np.uint64(0)))


def _known(raw: pa.Scalar) -> np.ndarray:
    return np.cumsum(unpacked(raw), dtype=np.uint64)


def _part(known: np.ndarray, parts: int) -> np.ndarray:
    return ((known >> np.uint64(BITS - 32)) * np.uint64(parts)) >> np.uint64(32)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, grp) as (grp, chunk): the rows of a group that a task has, compressed."""
    held: list[pa.RecordBatch] = []
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        grp = np.asarray(table.column("grp"))
        by = np.argsort(grp, kind="stable")
        cut = np.flatnonzero(np.diff(grp[by], prepend=-1))
        table = table.drop_columns(["grp"])
        for at, end in zip(cut, np.append(cut[1:], len(by)), strict=True):
            sink = pa.BufferOutputStream()
            own = table.take(pa.array(by[at:end])).combine_chunks()
            with pa.ipc.new_stream(sink, own.schema) as writer:
                writer.write_table(own)
            yield pa.record_batch([pa.array([grp[by[at]]]), pa.array([zstandard.compress(sink.getvalue(), 3)], pa.binary())], names=["grp", "chunk"])

    for batch in pieces(batches, "text"):
        held.append(batch)
        size += batch.nbytes
        if size > PACK_BYTES:
            yield from out()
            held, size = [], 0
    if held:
        yield from out()


def _texts(chunks: pa.ChunkedArray) -> Iterator[pa.Table]:
    for c in chunks:
        yield pa.ipc.open_stream(zstandard.decompress(c.as_buffer())).read_all()


def _symbols(columns: Iterator[pa.ChunkedArray]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, symbols of each text) of several columns of texts."""
    symbols, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for c in columns:
        for own in pieces(pa.table([c], names=["text"]).to_batches(), "text"):
            got, first = tokens(own.column("text"))
            symbols.append(got)
            sizes.append(np.diff(first))
    return np.concatenate(symbols), np.concatenate(sizes)


def _counting(order: int, parts: int):
    """The n-grams of a group: (grp, k, part, grams, counts), sorted, with the differences of the hashes."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        symbols, sizes = _symbols(t.column("text") for t in _texts(table.column("chunk")))
        place, rows = _place(sizes), []
        for k, g in enumerate(grams(symbols, order), 1):
            known, n = np.unique(g[place >= k - 1], return_counts=True)
            edge = np.searchsorted(_part(known, parts), np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(edge)).tolist():
                own = slice(edge[p], edge[p + 1])
                rows.append((k, p, _sorted_block(known[own]), packed(n[own])))
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.table([pa.array([key[0].as_py()] * len(rows), pa.int64()), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["grp", "k", "part", "grams", "counts"])

    return run


def _merged(key: tuple, table: pa.Table) -> pa.Table:
    """Answers the blocks of a range: (grp, k, part, counts), the counts in the whole corpus, in the blocks' order."""
    own = [_known(b) for b in table.column("grams")]
    known, at = np.unique(np.concatenate(own), return_inverse=True)
    total = np.zeros(len(known), dtype=np.int64)
    np.add.at(total, at, np.concatenate([unpacked(b) for b in table.column("counts")]).astype(np.int64))
    answers = [packed(total[a]) for a in np.split(at, np.cumsum([len(x) for x in own])[:-1])]
    return pa.table([table.column("grp"), table.column("k"), table.column("part"), pa.array(answers, pa.binary())], names=["grp", "k", "part", "counts"])


def _own_counts(gram: np.ndarray, doc: np.ndarray, kinds: int) -> np.ndarray:
    """How often the document of each occurrence has its n-gram."""
    _, at, n = np.unique(doc * max(1, kinds) + gram, return_inverse=True, return_counts=True)
    return n[at]


def traversed(rest: list[np.ndarray], place: np.ndarray, p: np.ndarray, prior: float) -> np.ndarray:
    """The weight that each symbol adds on its way through the automaton.

    rest: for each order the n' of the n-gram that ends at each symbol; p: the
    probabilities of the symbols by themselves.
    """
    arcs, falls = [np.log(p)], [np.zeros(len(p))]
    for k in range(1, len(rest)):
        context = np.concatenate([np.zeros(min(1, len(p))), rest[k - 1][:-1]])
        p = (rest[k] + prior * p) / (context + prior)
        arcs.append(np.log(p))
        falls.append(np.log(prior / (context + prior)))
    total, waiting = np.zeros(len(p)), np.ones(len(p), dtype=bool)
    for k in range(len(rest) - 1, -1, -1):
        here = waiting & (place >= k)
        found = here & ((rest[k] > 0) | (k == 0))
        total[found] += arcs[k][found]
        waiting &= ~found
        failed = here & ~found
        total[failed] += falls[k][failed]
    return total


def _scoring(order: int, prior: float, words: int, vocabulary: int):
    def run(key: tuple, chunks: pa.Table, answers: pa.Table) -> pa.Table:
        texts = list(_texts(chunks.column("chunk")))
        ids = pa.concat_tables(t.select(["doc_id"]) for t in texts).column("doc_id")
        symbols, size = _symbols(t.column("text") for t in texts)
        del texts
        place, doc = _place(size), np.repeat(np.arange(len(size)), size)
        ks, parts = (np.asarray(answers.column(c)) for c in ("k", "part"))
        rest = []
        for k, g in enumerate(grams(symbols, order), 1):
            at = place >= k - 1
            known, gram = np.unique(g[at], return_inverse=True)
            mine = np.flatnonzero(ks == k)
            counts = [unpacked(answers.column("counts")[int(i)]) for i in mine[np.argsort(parts[mine])]]
            total = np.concatenate([np.zeros(0, np.uint64), *counts]).astype(np.float64)
            left = np.zeros(len(symbols))
            left[at] = total[gram] - _own_counts(gram, doc[at], len(known))
            rest.append(left)
        p = (rest[0] + 1) / (words - size[doc] + vocabulary)
        weight = np.bincount(doc, weights=traversed(rest, place, p, prior), minlength=len(size))
        return pa.table([ids, pa.array(np.maximum(size - 1, 0)), pa.array(weight)], names=["doc_id", "n_words", "log_probability"])

    return run


def size_of(docs: DataFrame) -> tuple[int, int]:
    """(symbols, different symbols) of all texts."""
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, size, total = np.zeros(0, np.uint64), [], 0, 0

        def blocks() -> pa.RecordBatch:
            edge = np.searchsorted(_part(known, parts), np.arange(parts + 1))
            some = np.flatnonzero(np.diff(edge))
            own = [_sorted_block(known[edge[p] : edge[p + 1]]) for p in some]
            return pa.record_batch([pa.array(some.astype(np.int32)), pa.array(own, pa.binary()), pa.array(np.where(np.arange(len(some)) == 0, total, 0))], names=["part", "block", "n"])

        for batch in pieces(batches, "text"):
            held.append(grams(tokens(batch.column("text"))[0], 1)[0])
            size, total = size + len(held[-1]), total + len(held[-1])
            if size > 1_000_000:
                known, held, size = np.unique(np.concatenate([known, *held])), [], 0
                if len(known) > 4_000_000:
                    yield blocks()
                    known, total = np.zeros(0, np.uint64), 0
        known = np.unique(np.concatenate([known, *held]))
        if len(known):
            yield blocks()

    def merged(key: tuple, table: pa.Table) -> pa.Table:
        different = len(np.unique(np.concatenate([_known(b) for b in table.column("block")])))
        return pa.table({"n": [pa.compute.sum(table.column("n")).as_py()], "v": [different]})

    blocks = docs.select("text").mapInArrow(run, "part int, block binary, n long")
    got = blocks.groupBy("part").applyInArrow(merged, "n long, v long").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    return got["n"] or 0, got["v"] or 0


def score(docs: DataFrame, order: int = ORDER, prior: float = PRIOR, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Log-probability of every document under the word model of all other documents.

    Returns (doc_id, n_words, log_probability, perplexity): natural logarithm of
    the words and the end of the text, and perplexity per symbol of these. A text
    without a word (null, empty, only punctuation) has log-probability 0 and a
    null perplexity, and isn't part of the model. Rows are documents: repeated
    ones are counted and scored as often as they stand there, and know each
    other. Texts of any length are scored whole, equal texts alike. A null doc_id
    is kept; other columns, whatever their names, play no part; an empty table
    gives no rows.
    """
    rows = docs.select("doc_id", "text")
    kind = dict(rows.dtypes)["doc_id"]
    words, vocabulary = size_of(rows)
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()["bytes"]
    groups, parts = total // group_bytes + 1, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blank = F.coalesce("text", F.lit("")) == ""
    grouped = rows.where(~blank).withColumn("grp", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)))
    # both uses are the same exchange: the texts move once
    chunks = grouped.mapInArrow(_chunks, "grp long, chunk binary")
    blocks = chunks.groupBy("grp").applyInArrow(_counting(order, parts), "grp long, k int, part int, grams binary, counts binary")
    answers = blocks.groupBy("k", "part").applyInArrow(_merged, "grp long, k int, part int, counts binary")
    scored = chunks.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(_scoring(order, prior, words, vocabulary), f"doc_id {kind}, n_words long, log_probability double")
    none = rows.where(blank).select("doc_id", F.lit(0).cast("long").alias("n_words"), F.lit(0.0).alias("log_probability"))
    return scored.unionByName(none).withColumn("perplexity", F.when(F.col("n_words") > 0, F.exp(-F.col("log_probability") / (F.col("n_words") + 1))))


#: What the query gives for documents, as SQL; a word is a run of what _text.separators doesn't name.
SQL = f"""
WITH w AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\\x{{AA}}\\x{{B5}}\\x{{BA}}\\x{{C0}}-\\x{{1FFF}}\\x{{2080}}-\\x{{2FFF}}\\x{{3040}}-\\x{{10FFFF}}]+') AS ws FROM documents),
t AS (SELECT rid, unnest(list_append(ws, chr(10))) AS sym, generate_subscripts(list_append(ws, chr(10)), 1) AS pos FROM w WHERE len(ws) > 0),
g AS (SELECT rid, pos, md5(sym) AS g1, CASE WHEN pos > 1 THEN md5(lag(sym) OVER o || ' ' || sym) END AS g2,
  CASE WHEN pos > 2 THEN md5(lag(sym, 2) OVER o || ' ' || lag(sym) OVER o || ' ' || sym) END AS g3 FROM t WINDOW o AS (PARTITION BY rid ORDER BY pos)),
c AS (SELECT rid, pos, count(*) OVER (PARTITION BY rid) AS size,
  count(*) OVER (PARTITION BY g1) - count(*) OVER (PARTITION BY rid, g1) AS n1,
  CASE WHEN pos > 1 THEN count(*) OVER (PARTITION BY g2) - count(*) OVER (PARTITION BY rid, g2) END AS n2,
  CASE WHEN pos > 2 THEN count(*) OVER (PARTITION BY g3) - count(*) OVER (PARTITION BY rid, g3) END AS n3 FROM g),
z AS (SELECT count(*) AS n, count(DISTINCT sym) AS v FROM t),
a AS (SELECT rid, pos, n2, n3, (n1 + 1) / (z.n - size + z.v) AS p1, lag(n1) OVER o AS c2, lag(n2) OVER o AS c3 FROM c, z WINDOW o AS (PARTITION BY rid ORDER BY pos)),
b AS (SELECT *, CASE WHEN pos > 1 THEN (n2 + {PRIOR} * p1) / (c2 + {PRIOR}) ELSE p1 END AS p2 FROM a),
x AS (SELECT rid, count(*) - 1 AS n_words, sum(ln(CASE WHEN pos > 2 THEN (n3 + {PRIOR} * p2) / (c3 + {PRIOR}) ELSE p2 END)) AS lp FROM b GROUP BY rid)
SELECT doc_id, coalesce(n_words, 0) AS n_words, round(coalesce(lp, 0.0), 4) + 0.0 AS log_probability, round(exp(-lp / (n_words + 1)), 4) AS perplexity FROM w LEFT JOIN x USING (rid)
"""
