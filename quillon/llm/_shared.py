"""The folder that all executors share, tables written to it, and batch helpers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import shared_dir

#: Stands for a null doc_id while documents are matched; it sorts before every other id.
NO_ID = -(2**63)
#: Bytes of text that a Python worker holds in vectors at a time.
SLICE_BYTES = 2 << 20


_TRACKED: list[list[Scratch]] = []


class Scratch:
    """Tables that cut lineage: Parquet in the shared folder, so a lost executor loses nothing."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        if _TRACKED:
            _TRACKED[-1].append(self)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """df, written and read again."""
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        """Delete one table, or all."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def dropping() -> Iterator[None]:
    """Drops the tables of every Scratch made within, when what was made of them is written."""
    _TRACKED.append([])
    try:
        yield
    finally:
        for scratch in _TRACKED.pop():
            scratch.drop()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores before them as keep them apart from df's columns (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def known(column: str) -> Column:
    """A long id that is never null."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def unknown(column: str) -> Column:
    """Undoes :func:`known`."""
    return F.when(F.col(column) != NO_ID, F.col(column))


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most limit bytes in the string column, or one row."""
    for batch in batches:
        array = batch.column(column)
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(array), 0)).astype(np.int64)
        total = np.cumsum(sizes)
        at = 0
        while at < len(sizes):
            done = int(total[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(total, done + limit, side="right")))
            yield batch.slice(at, end - at)
            at = end
