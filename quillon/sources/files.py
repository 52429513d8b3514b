"""Small files and folders in any file system that Spark's Hadoop client knows."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN: list[str] = []


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a file or folder."""
    fs, p = _fs(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """Sorted names in a folder; none if it isn't there."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def signature(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of a file, or of a folder's files."""
    fs, p = _fs(spark, path)
    return (path, *sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(p)))


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small file: a reader sees the old or the new one, whole."""
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(jvm.java.net.URI.create(path if "://" in path else f"file://{path}"), spark.sparkContext._jsc.hadoopConfiguration())
    fs, p = _fs(spark, path)
    fs.mkdirs(p.getParent())
    own = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(own)
    stream.write(bytearray(text.encode()))
    stream.close()
    option = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(option, 1)
    options[0] = option.OVERWRITE
    context.rename(own, p, options)


def rename(spark: SparkSession, source: str, target: str) -> bool:
    """Move a folder; false where the target is there already."""
    fs, p = _fs(spark, source)
    to = _fs(spark, target)[1]
    return not fs.exists(to) and fs.rename(p, to)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder."""
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset and Spark is local (tests), a folder of this process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="quillon-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return "file://" + _OWN[0]
