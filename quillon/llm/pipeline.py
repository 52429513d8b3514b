"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept,
and returns a DataFrame; all but the last return the columns of docs. run()
writes each stage's result as Parquet in the shared folder and reads it again
as the next one's docs, so that a lost executor costs no finished stage; what a
stage leaves behind is deleted when its result is written.

For every stage: columns other than doc_id, text and n_chars pass through
whatever their names; a null doc_id is kept as an id of its own; texts of any
length are worked on whole; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, line_dedup, near_dedup, packing, toxicity
from ._shared import Scratch, dropping


def _plain(docs: DataFrame) -> DataFrame:
    """docs with other columns' names out of the operators' way."""
    return docs.toDF(*[c if c in ("doc_id", "text", "n_chars") else f"__c{i}" for i, c in enumerate(docs.columns)])


def _restored(out: DataFrame, docs: DataFrame) -> DataFrame:
    """out with the columns of docs, under their names."""
    return out.select(*[F.col(p).alias(c) for p, c in zip(_plain(docs).columns, docs.columns, strict=True)])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, doesn't reject.

    Null and empty texts stay. Rows are judged by themselves, so repeated ones
    share a verdict; a score equal to the threshold is toxic. Without labels
    all stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    plain = _plain(docs)
    return _restored(toxicity.score(plain, toxicity.fit(plain, labels), passing=True), docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeats of runs of lines; those of which nothing is left go.

    Null and empty texts stay. Rows equal in doc_id and text count once and are
    cut alike; at one place of one doc_id, different texts tie and keep their lines.
    """
    out = line_dedup.dedup_lines(_plain(docs))
    return _restored(out.where((F.col("removed_lines") == 0) | F.col("text").rlike(r"\S")), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document, by doc_id, of each group of near duplicates.

    Texts without a word stay. Of rows equal in doc_id and text one stays; of
    different texts of one doc_id that are near duplicates, the one whose hash is least.
    """
    return _restored(near_dedup.drop_near_duplicates(_plain(docs)), docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the spans they share with test items; those of which nothing is left go.

    Null and empty texts stay. Rows are cleaned by themselves, repeated ones
    alike. Without test items all stay as they are.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    plain = _plain(docs)
    out = decontaminate.decontaminate(plain, benchmark, keep=tuple(c for c in plain.columns if c != "text"))
    out = out.where(~F.col("contaminated") | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("contaminated"), F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return _restored(out, docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents in bins: (doc_id, piece, start_word, n_words, bin, slot).

    Null, empty and blank texts have no place. Repeated rows are packed one by
    one; pieces of one length are exchangeable.
    """
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]

#: The fitted classifier, MinHash and the linear program are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result for documents."""
    scratch = Scratch(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with dropping():
            docs = scratch.table(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs
