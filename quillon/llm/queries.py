"""Queries of the corpus operators, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, line_dedup, lm_score, near_dedup, packing, pipeline, quality, substring_dedup, toxicity, url_filter, warc

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame of the archives of all pages."""
    return warc.archive_frames(_table(spark, sf_dir, "pages"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that stand at an earlier place, too."""
    return substring_dedup.repeated_passages(_table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every piece of every document."""
    return packing.pack(_table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its canonical URL, and whether it is listed."""
    pages = _table(spark, sf_dir, "pages")
    return url_filter.flag_listed(pages, url_filter.listed_of(pages))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its metrics and the rules that it fails."""
    return quality.judge(_table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated runs of lines."""
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of near duplicates and number of matches."""
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log-probability and perplexity under the model of all others, rounded to 4 places."""
    out = lm_score.score(_table(spark, sf_dir, "documents"))
    return out.withColumns({c: F.round(c, 4) + F.lit(0.0) for c in ("log_probability", "perplexity")})


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score and verdict."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without what it shares with the test items."""
    return decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Query]:
    """All queries of this subpackage, the pipeline among them."""
    ops = (op1_warc, op2_substring_dedup, op3_packing, op4_url_filter, op5_quality_rules, op6_line_dedup, op7_near_dedup, op8_lm_score, op9_toxicity, op10_decontamination)
    return {**{f.__name__: f for f in ops}, "pipeline": pipeline.run}


def oracle_sql() -> dict[str, str]:
    """SQL for those that SQL can express; the others are tested against brute force."""
    return {"op4_url_filter": url_filter.SQL, "op5_quality_rules": quality.SQL, "op6_line_dedup": line_dedup.SQL, "op8_lm_score": lm_score.SQL}
