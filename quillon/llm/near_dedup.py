"""MinHash near-dedup: an inverted join over signature coordinates.

A signature is a set of m (coordinate, value) tokens; two documents match when
at least ``least`` of them agree. Tokens are ordered from rare to frequent over
the whole corpus. Two documents that match must share a token among the first
``m - least + 1`` of each, so only these prefixes are posted and merged; the
long postings at the end of the order are skipped and, for the pairs that the
prefixes meet in, looked up in the signatures. Nothing is capped: what the
order skips can't be the only thing a matching pair has in common.

Documents with equal signatures agree in every coordinate. They are collapsed
to one before posting and never expanded again: results are one row for each
document, with its class and the number of documents that it matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text
from ._shared import Scratch, fresh, known, pieces, unknown

#: Signature length, words in a shingle, coordinates that must agree (0.53 of 64).
COORDINATES, SHINGLE, LEAST = 64, 3, 34


def signatures_of(column: pa.Array, coordinates: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents with words, their signatures); short texts are one shingle."""
    w = _text.words(column)
    count = np.diff(w.first)
    some = np.flatnonzero(count)
    width = np.minimum(count, shingle)
    grams = np.zeros(len(w.hashes), dtype=np.uint64)
    doc = w.doc
    for n in range(1, shingle + 1):
        g = _text.gram_hashes(w.hashes, n)
        take = width[doc[: len(g)]] == n
        grams[: len(g)][take] = g[take]
    keep = np.arange(len(grams)) + width[doc] <= w.first[1:][doc]
    grams, doc = grams[keep], doc[keep]
    starts = np.searchsorted(doc, some)
    rng = np.random.default_rng(20250101)
    factors = rng.integers(1, 2**63, coordinates, dtype=np.uint64) | np.uint64(1)
    terms = rng.integers(0, 2**63, coordinates, dtype=np.uint64)
    out = np.zeros((len(some), coordinates), dtype=np.uint32)
    if len(some):
        for j in range(coordinates):
            out[:, j] = np.minimum.reduceat((grams * factors[j] + terms[j]) >> np.uint64(32), starts)
    return some, out


def _signatures(coordinates: int, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            some, sig = signatures_of(batch.column("text"), coordinates, shingle)
            # texts without a word have no signature
            has = np.zeros(batch.num_rows, dtype=bool)
            has[some] = True
            offsets = np.concatenate([[0], np.cumsum(has) * coordinates]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(~has, False)), pa.array(sig.ravel().view(np.int32)))
            yield pa.record_batch([batch.column("id"), batch.column("tag"), lists], names=["id", "tag", "sig"])

    return run


def _matched(docs: DataFrame, scratch: Scratch, coordinates: int, shingle: int, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (id, tag, uid), classes of equal signatures (uid, sig, r, n) and their matching pairs (a, b, matches).

    r is the first (id, tag) of a class, n the number of its documents; a and b
    are uids, a < b. A document without a word has a null uid and is in no class.
    """
    rows = docs.select(known("doc_id").alias("id"), F.xxhash64("text").alias("tag"), "text")
    signed = scratch.table(rows.mapInArrow(_signatures(coordinates, shingle), "id long, tag long, sig array<int>").withColumn("uid", F.when(F.col("sig").isNotNull(), F.xxhash64("sig"))), "signed")
    members = scratch.table(signed.select("id", "tag", "uid").distinct(), "members")
    place = F.struct("id", "tag")
    sizes = members.where("uid is not null").groupBy("uid").agg(F.min(place).alias("r"), F.count("*").alias("n"))
    unique = scratch.table(signed.where("uid is not null").groupBy("uid").agg(F.first("sig").alias("sig")).join(sizes, "uid"), "unique")

    token = F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR(F.col("value").cast("long").bitwiseAND(0xFFFFFFFF))
    posted = unique.select("uid", F.posexplode("sig").alias("at", "value")).select("uid", token.alias("token"))
    counts = posted.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    shared = posted.join(counts, "token")
    own = Window.partitionBy("uid")
    ranked = shared.withColumn("rank", F.row_number().over(own.orderBy("n", "token"))).withColumn("all", F.count("*").over(own))
    # tokens that occur once come first in the order, so they use up part of the prefix
    prefix = scratch.table(ranked.where(F.col("rank") <= F.col("all") - (least - 1)).select("uid", "token"), "prefix")
    a, b = prefix.select("token", F.col("uid").alias("a")), prefix.select("token", F.col("uid").alias("b"))
    met = a.join(b, "token").where("a < b").groupBy("a", "b").agg(F.count("*").alias("met"))
    one, two = unique.select(F.col("uid").alias("a"), F.col("sig").alias("sa")), unique.select(F.col("uid").alias("b"), F.col("sig").alias("sb"))
    agree = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    pairs = scratch.table(met.join(one, "a").join(two, "b").select("a", "b", agree.alias("matches")).where(F.col("matches") >= least), "pairs")
    for name in ("signed", "prefix"):
        scratch.drop(name)
    return members, unique, pairs


def near_pairs(docs: DataFrame, coordinates: int = COORDINATES, shingle: int = SHINGLE, least: int = LEAST) -> DataFrame:
    """Matching pairs between the first documents of classes of equal signatures.

    Returns (doc_a, doc_b, n_a, n_b, matches, similarity), doc_a before doc_b, with
    the numbers of documents in both classes. Edge cases as in :func:`near_duplicates`.
    """
    scratch = Scratch(docs.sparkSession, "nearpairs")
    _, unique, pairs = _matched(docs, scratch, coordinates, shingle, least)
    one, two = (unique.select(F.col("uid").alias(u), F.col("r").alias(f"r{u}"), F.col("n").alias(f"n{u}")) for u in "ab")
    both = pairs.join(one, "a").join(two, "b")
    turned = F.col("ra") > F.col("rb")
    first, second = F.least("ra", "rb"), F.greatest("ra", "rb")
    out = both.select(first["id"].alias("ida"), second["id"].alias("idb"), F.when(turned, F.col("nb")).otherwise(F.col("na")).alias("n_a"), F.when(turned, F.col("na")).otherwise(F.col("nb")).alias("n_b"), "matches")
    return out.select(unknown("ida").alias("doc_a"), unknown("idb").alias("doc_b"), "n_a", "n_b", "matches", (F.col("matches") / coordinates).alias("similarity"))


def _classed(docs: DataFrame, scratch: Scratch, coordinates: int, shingle: int, least: int) -> DataFrame:
    """(id, tag, first, links): every document with the first (id, tag) of its class and the number of its matches."""
    members, unique, pairs = _matched(docs, scratch, coordinates, shingle, least)
    roots = _components(pairs, scratch)
    size = unique.select("uid", "r", "n")
    ways = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = ways.join(size.select(F.col("uid").alias("b"), "n"), "b").groupBy(F.col("a").alias("uid")).agg(F.sum("n").alias("more"))
    placed = size.join(roots.select(F.col("node").alias("uid"), "root"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    firsts = placed.groupBy("root").agg(F.min("r").alias("first"))
    classes = placed.join(firsts, "root").join(linked, "uid", "left").select("uid", "first", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("links"))
    out = members.join(scratch.table(classes, "classes"), "uid", "left")
    for name in ("unique", "pairs"):
        scratch.drop(name)
    return out.select("id", "tag", F.coalesce("first", F.struct("id", "tag")).alias("first"), F.coalesce("links", F.lit(0)).alias("links"))


def near_duplicates(docs: DataFrame, coordinates: int = COORDINATES, shingle: int = SHINGLE, least: int = LEAST) -> DataFrame:
    """Every document with its class of near duplicates and the number of documents it matches.

    Two documents match where their MinHash signatures agree in at least
    ``least`` coordinates; classes are the connected components of that relation.
    Returns (doc_id, class_id, links): class_id is the first doc_id of the class,
    links the number of other documents that match this one, copies included. A
    document that matches no other is its own class, with no links.

    Texts without a word (null, empty, only punctuation) match nothing. A text
    shorter than a shingle is one shingle; texts of any length are taken whole.
    Rows equal in doc_id and text count once; rows of one doc_id with different
    texts are different documents. doc_id is an integer; a null one sorts first
    and, where it is the first of a class, gives a null class_id. Columns other
    than doc_id and text are ignored; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "near")
    out = _classed(docs, scratch, coordinates, shingle, least)
    return out.select(unknown("id").alias("doc_id"), F.col("first.id").alias("own"), "links").select("doc_id", unknown("own").alias("class_id"), "links")


def _components(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node that isn't its component's smallest.

    Large-star and small-star steps in turn, until the edges no longer change.
    Edges go from the greater to the smaller node.
    """

    def linked(edges: DataFrame, both: bool) -> DataFrame:
        ways = edges.select("u", "v")
        if both:
            ways = ways.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        out = ways.join(low, "u")
        if both:
            return out.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        return out.select(F.col("v").alias("x"), "m").where("x != m").select(F.col("x").alias("u"), F.col("m").alias("v")).unionByName(low.where("u != m").select("u", F.col("m").alias("v"))).distinct()

    edges, turn, before = pairs.select(F.col("b").alias("u"), F.col("a").alias("v")).distinct(), 0, None
    while True:
        edges = scratch.table(linked(scratch.table(linked(edges, True), f"large{turn}"), False), f"small{turn}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        if turn > 1:
            scratch.drop(f"small{turn - 2}")
            scratch.drop(f"large{turn - 2}")
        before, turn = now, turn + 1


def drop_near_duplicates(docs: DataFrame, coordinates: int = COORDINATES, shingle: int = SHINGLE, least: int = LEAST) -> DataFrame:
    """docs with one document, the first by doc_id, of each class of :func:`near_duplicates`.

    Of rows that are equal in doc_id and text one is kept, whichever Spark meets
    first where they differ in other columns. Texts without a word are kept, but
    for such repeats of a text that isn't empty. The columns are those of docs,
    whatever their names; an empty table stays empty.
    """
    scratch = Scratch(docs.sparkSession, "neardrop")
    gone = _classed(docs, scratch, coordinates, shingle, least).where("first.id != id or first.tag != tag")
    id_, tag, nth, apart = fresh(docs, "q_id", "q_tag", "q_nth", "q_apart")
    gone = gone.select(F.col("id").alias(id_), F.col("tag").alias(tag))
    # blank texts are kept as they are, so that they don't meet in one window
    blank = F.coalesce("text", F.lit("")) == ""
    rows = docs.withColumns({id_: known("doc_id"), tag: F.xxhash64("text"), apart: F.when(blank, F.monotonically_increasing_id())})
    left = rows.join(gone, [id_, tag], "left_anti")
    same = Window.partitionBy(id_, tag, apart).orderBy(id_)
    return left.withColumn(nth, F.row_number().over(same)).where(F.col(nth) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
