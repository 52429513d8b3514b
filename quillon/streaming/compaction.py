"""The change log's meaning: which rows are live, and with what.

A log is (lsn, id, op, vector, payload), op being upsert or delete. The last
change counts; an upsert without payload keeps the earlier payload, unless the
row was deleted in between. The result depends on lsn alone, not on the order
of rows or on repeats, so replaying a log twice changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compact(log: DataFrame, values: tuple[str, ...] = ("vector",)) -> DataFrame:
    """(id, *values, payload, lsn): live rows, by one aggregation with partial sums."""
    up, down, has = F.col("op") == "upsert", F.col("op") == "delete", F.col("payload").isNotNull()
    lsn = F.col("lsn")
    latest = log.groupBy("id").agg(
        F.max(F.when(down, lsn)).alias("__d"),
        F.max(F.when(up, lsn)).alias("lsn"),
        F.max(F.when(up & has, lsn)).alias("__p"),
        *[F.max_by(v, F.when(up, lsn)).alias(v) for v in values],
        F.max_by("payload", F.when(up & has, lsn)).alias("payload"),
    )
    gone = F.coalesce("__d", F.lit(-(2**63)))
    return latest.where(F.col("lsn") > gone).select("id", *values, F.when(F.col("__p") > gone, F.col("payload")).alias("payload"), "lsn")


def as_log(state: DataFrame) -> DataFrame:
    """A compacted state as a log, to be compacted with later changes."""
    return state.select("lsn", "id", F.lit("upsert").alias("op"), "vector", "payload")


def after(log: DataFrame, watermark: int) -> DataFrame:
    """Changes later than the watermark."""
    return log.where(F.col("lsn") > F.lit(watermark))


def by_collection(log: DataFrame) -> DataFrame:
    """(collection, n, last_lsn) of a log of several collections."""
    return log.groupBy("collection").agg(F.count("*").alias("n"), F.max("lsn").alias("last_lsn"))
