"""Counters, histograms and percentiles of measured values."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import shared_dir


def percentiles(rows: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(by, n, a column for each share): the value of rank floor(n * share), counted from 0, at most the last.

    Equal values are counted first. The counted values are then ranked in ranges
    of all of them, with the ranges' totals before them, so that no task holds
    all of a frequent key. Null values don't count.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(F.col(by).alias("k"), F.col(value).alias("v")).agg(F.count("*").alias("c"))
    spark, path = rows.sparkSession, f"{shared_dir(rows.sparkSession)}/ranks-{uuid.uuid4().hex}"
    # written, so that both uses see the same ranges
    counted.repartitionByRange("k", "v").withColumn("part", F.spark_partition_id()).write.parquet(path)
    ranged = spark.read.parquet(path)
    # a row for each key and range
    totals = ranged.groupBy("k", "part").agg(F.sum("c").alias("own"))
    before = totals.select("k", "part", (F.coalesce(F.sum("own").over(Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("before"), F.sum("own").over(Window.partitionBy("k")).alias("n"))
    ranks = ranged.join(before, ["k", "part"]).withColumn("upto", F.col("before") + F.sum("c").over(Window.partitionBy("k", "part").orderBy("v")))
    at = {name: F.least(F.floor(F.col("n") * share), F.col("n") - 1) for name, share in shares.items()}
    return ranks.groupBy(F.col("k").alias(by)).agg(F.max("n").alias("n"), *[F.min(F.when(F.col("upto") > rank, F.col("v"))).alias(name) for name, rank in at.items()])


def histogram(rows: DataFrame, by: str, value: str, buckets: tuple[float, ...], time: str, failed: str) -> DataFrame:
    """(by, n, errors, per_second, total, le_<bucket>...): counts up to each bucket's bound, by one aggregation.

    per_second is over the time between the first and the last row, null if there is none between.
    """
    span = F.unix_micros(F.max(time)) - F.unix_micros(F.min(time))
    return rows.groupBy(by).agg(
        F.count("*").alias("n"),
        F.count(F.when(F.col(failed), True)).alias("errors"),
        (F.count("*") / F.when(span > 0, span / 1e6)).alias("per_second"),
        F.sum(value).alias("total"),
        *[F.count(F.when(F.col(value) <= b, True)).alias(f"le_{b}") for b in buckets],
    )
