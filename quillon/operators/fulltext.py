"""BM25 over postings, and reciprocal-rank fusion with vector results."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.distance import rrf_term
from ..functions.text import tokens
from ..types import InvalidArgument

K1, B = 1.2, 0.75
#: Folders that a stored index's terms are spread over.
BUCKETS = 64
#: Words whose postings are packed together.
PACKED = 2_000_000


@dataclass(frozen=True)
class Clause:
    """Terms of a query; must: + or AND, must_not: - or NOT. More than one term is a phrase."""

    terms: tuple[str, ...]
    must: bool = False
    must_not: bool = False
    boost: float = 1.0


def parse(text: str) -> list[Clause]:
    """Clauses of a query: terms (OR by default), +term, -term, AND, OR, NOT, "a phrase", and term^2."""
    if text.count('"') % 2:
        raise InvalidArgument("a quote isn't closed")
    out: list[Clause] = []
    both = negate = False
    for sign, phrase, word, boost in re.findall(r'([+-]?)(?:"([^"]*)"|([^\s"^]+))(?:\^([0-9.]+))?', text):
        if word in ("AND", "OR", "NOT") and not sign:
            both, negate = word == "AND" or (both and word == "NOT"), negate != (word == "NOT")
            if both and out and not out[-1].must_not:
                out[-1] = Clause(out[-1].terms, True, False, out[-1].boost)
            continue
        terms = tuple(t for t in re.split(r"[\W_]+", (phrase or word).lower()) if t and len(t.encode()) <= 40)
        if terms:
            not_ = sign == "-" or negate
            out.append(Clause(terms, (sign == "+" or both) and not not_, not_, float(boost or 1)))
        both = negate = False
    return out


def postings(rows: DataFrame) -> DataFrame:
    """(term, id, tf, dl) of rows (id, text). Null texts aren't indexed."""
    docs = rows.where("text is not null").select("id", tokens(F.col("text")).alias("t"))
    return docs.select("id", F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def statistics(rows: DataFrame) -> DataFrame:
    """One row (n, avgdl)."""
    docs = rows.where("text is not null").select(F.size(tokens(F.col("text"))).alias("dl"))
    return docs.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def placed_postings(rows: DataFrame) -> DataFrame:
    """(term, id, dl, positions) of rows (id, text), a row for each id: postings that phrases can be found in."""
    return _unpacked(_packed(rows).where("term is not null"))


def _packed(rows: DataFrame) -> DataFrame:
    """(term, ids, dls, positions): a term's postings in some of the rows (id, text), as arrays that belong together.

    The lines of term null have the ids and lengths of all texts. Nothing is shuffled:
    the postings of a text are made where it is, in one pass.
    """
    docs = rows.where("text is not null").select("id", tokens(F.col("text")).alias("t"))
    return docs.mapInArrow(_pack, f"term string, ids array<{dict(rows.dtypes)['id']}>, dls array<int>, positions array<array<int>>")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column("id"), batch.column("t")
        ends = np.asarray(texts.offsets).astype(np.int64)
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, ends[at] + PACKED, side="right")) - 1)
            yield _pack_texts(ids.slice(at, end - at), texts.slice(at, end - at))
            at = end


def _pack_texts(ids: pa.Array, texts: pa.ListArray) -> pa.RecordBatch:
    n, dl = len(ids), np.diff(np.asarray(texts.offsets)).astype(np.int32)
    words = texts.flatten().dictionary_encode()
    # a posting is a term and a text; its positions follow each other after the sort
    key = np.asarray(words.indices).astype(np.int64) * n + np.repeat(np.arange(n), dl)
    by = np.argsort(key, kind="stable")
    positions = by.astype(np.int32) - np.repeat((np.cumsum(dl) - dl).astype(np.int32), dl)[by]
    key = key[by]
    new = np.flatnonzero(np.diff(key, prepend=-1))
    term, text = key[new] // n, key[new] % n
    first = np.flatnonzero(np.diff(term, prepend=-1))

    def lists(values: pa.Array, starts: np.ndarray, end: int) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.append(starts, end).astype(np.int32)), values)

    # the lengths' line comes first
    starts = np.concatenate([[0], first + n])
    each = np.concatenate([np.arange(n), text])
    placed = lists(pa.array(positions), np.concatenate([np.zeros(n, np.int64), new]), len(key))
    terms = pa.concat_arrays([pa.nulls(1, pa.string()), words.dictionary.take(pa.array(term[first])).cast(pa.string())])
    return pa.record_batch([terms, lists(ids.take(pa.array(each)), starts, len(each)), lists(pa.array(dl[each]), starts, len(each)), lists(placed, starts, len(each))], names=["term", "ids", "dls", "positions"])


def _unpacked(packed: DataFrame) -> DataFrame:
    """(term, id, dl, positions[, bucket]) of packed postings."""
    each = F.inline(F.arrays_zip("ids", "dls", "positions")).alias("id", "dl", "positions")
    return packed.select("term", each, *[c for c in packed.columns if c == "bucket"])


def lengths(rows: DataFrame) -> DataFrame:
    """(id, dl) of rows (id, text) whose text isn't null."""
    return rows.where("text is not null").select("id", F.size(tokens(F.col("text"))).alias("dl"))


def write_index(rows: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Store postings by term, so that a search reads its terms' folders alone, and the texts' lengths in folder -1.

    The rows are read once, and what is shuffled is packed postings; a folder that would
    be too much for one task is written by several.
    """
    own = _packed(rows).withColumn("bucket", F.coalesce(_bucket(F.col("term"), buckets), F.lit(-1)))
    own.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/postings")


def _bucket(term: Column, buckets: int) -> Column:
    return F.when(term.isNotNull(), F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int"))


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(postings, lengths) as stored."""
    packed = spark.read.parquet(f"{path}/postings")
    return _unpacked(packed.where("bucket >= 0")), packed.where("bucket = -1").select(F.inline(F.arrays_zip("ids", "dls")).alias("id", "dl"))


def search_index(postings_: DataFrame, lengths_: DataFrame, text: str, k: int | None = None, k1: float = K1, b: float = B, buckets: int = BUCKETS) -> DataFrame:
    """As :func:`bm25`, from postings (term, id, dl, positions[, bucket]) and lengths (id, dl)."""
    clauses = parse(text)
    terms = sorted({t for c in clauses for t in c.terms})
    if not any(not c.must_not for c in clauses) or k == 0:
        return postings_.sparkSession.createDataFrame([], f"id {dict(postings_.dtypes)['id']}, score double")
    own = postings_.where(F.col("term").isin(*terms))
    if "bucket" in postings_.columns:
        at = postings_.sparkSession.range(1).select(*[_bucket(F.lit(t), buckets) for t in terms]).first()
        own = own.where(F.col("bucket").isin(*set(at)))
    found = own.groupBy("id").agg(F.max("dl").alias("dl"), *[F.max(F.when(F.col("term") == t, F.col("positions"))).alias(f"at{i}") for i, t in enumerate(terms)])
    place = {t: F.col(f"at{i}") for i, t in enumerate(terms)}
    phrases = {c.terms: f"p{i}" for i, c in enumerate(c for c in clauses if len(c.terms) > 1)}
    counted = found.select("id", "dl", *[F.coalesce(F.size(place[t]), F.lit(0)).alias(f"tf{i}") for i, t in enumerate(terms)], *[F.coalesce(_follow(p, place), F.lit(False)).alias(name) for p, name in phrases.items()])
    counted = counted.withColumns({f"tf{i}": F.greatest(F.col(f"tf{i}"), F.lit(0)) for i in range(len(terms))})
    df = own.groupBy().agg(*[F.count(F.when(F.col("term") == t, True)).alias(f"df{i}") for i, t in enumerate(terms)])
    stats = lengths_.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).crossJoin(F.broadcast(df))  # one row each
    return _scored(counted, stats, clauses, terms, phrases, k, k1, b)


def _follow(phrase: tuple[str, ...], place: dict[str, Column]) -> Column:
    """Whether the terms stand one after the other somewhere."""
    return F.exists(place[phrase[0]], lambda p: _all([F.array_contains(place[t], p + i) for i, t in enumerate(phrase)]))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _count(term: str) -> Column:
    return F.size(F.filter("t", lambda x: x == term))


def bm25(rows: DataFrame, text: str, k: int | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """(id, score) by BM25, best first, ties by id; k None gives all matches.

    One pass over the texts finds the query's terms, so no index need be there;
    the statistics are one row and the terms as many as the query has. A blank
    query gives no rows.
    """
    clauses = parse(text)
    terms = sorted({t for c in clauses for t in c.terms})
    empty = rows.sparkSession.createDataFrame([], f"id {dict(rows.dtypes)['id']}, score double")
    if not any(not c.must_not for c in clauses) or k == 0:
        return empty
    docs = rows.where("text is not null").select("id", tokens(F.col("text")).alias("t"))
    phrases = {c.terms: f"p{i}" for i, c in enumerate(c for c in clauses if len(c.terms) > 1)}
    counted = docs.select("id", F.size("t").alias("dl"), *[_count(t).alias(f"tf{i}") for i, t in enumerate(terms)], *[F.contains(F.concat(F.lit(" "), F.array_join("t", " "), F.lit(" ")), F.lit(f" {' '.join(p)} ")).alias(name) for p, name in phrases.items()])
    stats = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))])
    return _scored(counted, stats, clauses, terms, phrases, k, k1, b)


def _scored(counted: DataFrame, stats: DataFrame, clauses: list[Clause], terms: list[str], phrases: dict[tuple[str, ...], str], k: int | None, k1: float, b: float) -> DataFrame:
    """Scores of (id, dl, a tf for each term, a flag for each phrase), with stats, one row (n, avgdl, a df for each term)."""
    joined = counted.crossJoin(F.broadcast(stats))
    at = {t: i for i, t in enumerate(terms)}

    def has(c: Clause):
        return F.col(phrases[c.terms]) if len(c.terms) > 1 else F.col(f"tf{at[c.terms[0]]}") > 0

    def weight(t: str):
        tf, df, n = F.col(f"tf{at[t]}"), F.col(f"df{at[t]}"), F.col("n")
        idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
        return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))

    score, any_, keep = F.lit(0.0), F.lit(False), F.lit(True)
    for c in clauses:
        if c.must_not:
            keep = keep & ~has(c)
            continue
        any_ = any_ | has(c)
        if c.must:
            keep = keep & has(c)
        for t in c.terms:
            score = score + F.when(has(c), weight(t) * c.boost).otherwise(0.0)
    out = joined.where(keep & any_).select("id", score.alias("score"))
    return out.orderBy(F.desc("score"), "id").limit(k) if k is not None else out


def fuse_ranks(near: DataFrame, found: DataFrame, k: int, rrf_k: float = 60.0) -> DataFrame:
    """(id, score): reciprocal-rank fusion of two lists (id, score), near with low scores first, found with high."""
    a = near.withColumn("rank", F.row_number().over(Window.orderBy("score", "id")))
    b = found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
    both = a.select("id", rrf_term(F.col("rank"), rrf_k).alias("r")).unionByName(b.select("id", rrf_term(F.col("rank"), rrf_k).alias("r")))
    return both.groupBy("id").agg(F.sum("r").alias("score")).orderBy(F.desc("score"), "id").limit(k)


def hybrid(near: DataFrame, found: DataFrame, k: int, rrf_k: float = 60.0) -> DataFrame:
    """As fuse_ranks. Callers hand in the best 2k of each list, k being at most MAX_K, so at most 4 * MAX_K rows meet in a window."""
    return fuse_ranks(near, found, k, rrf_k)
