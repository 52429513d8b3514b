"""A collection's folder: log segments, checkpoints and the pointer to the current one.

    log/<first lsn>-<last lsn>/   one Parquet folder for each commit, moved into place when whole
    state/<version>/              compacted states
    consumers/<name>              JSON {last_lsn}: how far a follower, such as staging, has read
    _CURRENT                      JSON {version, path, last_lsn}
    _RETIRED                      JSON {path: time}: what no new reader needs

A reader takes the pointer's state and the segments after its last_lsn, so it
sees one version throughout, whatever is written meanwhile: what a checkpoint
replaces is retired, and deleted only when it has been so for a time of grace
and every follower has read it.
"""

from __future__ import annotations

import json
import struct
import time
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import files
from ..types import EngineError
from .compaction import after, as_log, compact

#: Milliseconds for which readers may still use what a checkpoint has replaced.
GRACE_MS = 3_600_000
LOG = "lsn long, id long, op string, vector array<float>, payload string"


class ChangeLog:
    """The log and checkpoints under one folder, with one writer and any number of readers."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def current(self) -> dict:
        """The pointer; version 0 where nothing is checkpointed."""
        path = f"{self.folder}/_CURRENT"
        return json.loads(files.read_text(self.spark, path)) if files.exists(self.spark, path) else {"version": 0, "path": None, "last_lsn": 0}

    def segments(self) -> list[tuple[int, int, str]]:
        """(first lsn, last lsn, path) of the segments that are whole."""
        out = []
        for name in files.names(self.spark, f"{self.folder}/log"):
            first, _, last = name.partition("-")
            if first.isdigit() and last.isdigit():
                out.append((int(first), int(last), f"{self.folder}/log/{name}"))
        return sorted(out)

    def last_lsn(self) -> int:
        """The last lsn that is written."""
        return max([self.current()["last_lsn"], *(s[1] for s in self.segments())])

    def append(self, changes: DataFrame) -> int:
        """Commit changes (id, op, vector, payload[, seq]) and return the last lsn.

        They are numbered in the order of seq, or of id. The batch is written aside
        and moved into place, so it is there as a whole or not at all.
        """
        seq = "seq" if "seq" in changes.columns else "id"
        first = self.last_lsn() + 1
        tmp = f"{self.folder}/.tmp-{uuid.uuid4().hex}"
        ordered = changes.select(F.col(seq).alias("__seq"), F.col("id").cast("long").alias("id"), "op", F.col("vector").cast("array<float>").alias("vector"), F.col("payload").cast("string").alias("payload"))
        # numbered by range partition, so that no single task sorts everything
        ranged = ordered.sort("__seq", "id", "op").withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
        ranged.write.parquet(f"{tmp}/ranged")
        rows = self.spark.read.parquet(f"{tmp}/ranged")
        counts = {r["__part"]: r["n"] for r in rows.groupBy("__part").agg(F.count("*").alias("n")).collect()}
        if not counts:
            files.delete(self.spark, tmp)
            return first - 1
        offsets, total = [], 0
        for part in sorted(counts):
            offsets.append((part, first + total))
            total += counts[part]
        base = self.spark.createDataFrame(offsets, "__part int, __base long")
        nth = F.row_number().over(Window.partitionBy("__part").orderBy("__at")) - 1
        log = rows.withColumn("__nth", nth).join(F.broadcast(base), "__part").select((F.col("__base") + F.col("__nth")).alias("lsn"), "id", "op", "vector", "payload")
        log.write.parquet(f"{tmp}/log")
        target = f"{self.folder}/log/{first:020d}-{first + total - 1:020d}"
        files.write_text(self.spark, f"{self.folder}/log/.keep", "")
        if not files.rename(self.spark, f"{tmp}/log", target):
            raise EngineError("another writer has committed")
        files.delete(self.spark, tmp)
        return first + total - 1

    def log(self, watermark: int = 0) -> DataFrame:
        """All changes later than the watermark; whole segments before it aren't read."""
        paths = [p for _, last, p in self.segments() if last > watermark]
        if not paths:
            return self.spark.createDataFrame([], LOG)
        return after(self.spark.read.schema(LOG).parquet(*paths), watermark)

    def state(self) -> DataFrame:
        """(id, vector, payload, lsn) as of now."""
        now = self.current()
        rest = self.log(now["last_lsn"])
        if now["path"]:
            rest = as_log(self.spark.read.parquet(now["path"])).unionByName(rest)
        return compact(rest)

    def followers(self) -> dict[str, int]:
        """The last lsn that each follower has read."""
        return {n: json.loads(files.read_text(self.spark, f"{self.folder}/consumers/{n}"))["last_lsn"] for n in files.names(self.spark, f"{self.folder}/consumers") if "." not in n}

    def follow_as(self, name: str, last_lsn: int) -> None:
        """Note that a follower has read up to last_lsn: later segments stay until it says more."""
        files.write_text(self.spark, f"{self.folder}/consumers/{name}", json.dumps({"last_lsn": last_lsn}))

    def unfollow(self, name: str) -> None:
        """Forget a follower, so that nothing waits for it."""
        files.delete(self.spark, f"{self.folder}/consumers/{name}")

    def first_lsn(self) -> int:
        """The first lsn from which on the log is whole."""
        first = self.current()["last_lsn"] + 1
        for low, high, _ in reversed(self.segments()):
            if high < first - 1:
                break
            first = min(first, low)
        return first

    def checkpoint(self, grace_ms: int = GRACE_MS, now_ms: int | None = None) -> dict:
        """Write the state as a new version and point to it; retire what it replaces, and delete what has been retired for long."""
        now, last = self.current(), self.last_lsn()
        if not now["path"] or last > now["last_lsn"]:
            version = now["version"] + 1
            path = f"{self.folder}/state/{version:06d}-{uuid.uuid4().hex[:8]}"
            self.state().write.parquet(path)
            old, now = now["path"], {"version": version, "path": path, "last_lsn": last}
            files.write_text(self.spark, f"{self.folder}/_CURRENT", json.dumps(now))
            if old:
                self.retire([old], now_ms)
        self.truncate(last, grace_ms, now_ms)
        return now

    def checkpoint_if_due(self, changes: int, grace_ms: int = GRACE_MS) -> bool:
        """One tick of periodic checkpoints: whether there were that many changes since the last, so that one was made."""
        due = self.last_lsn() - self.current()["last_lsn"] >= max(1, changes)
        if due:
            self.checkpoint(grace_ms)
        return due

    def _retired(self) -> dict[str, int]:
        path = f"{self.folder}/_RETIRED"
        return json.loads(files.read_text(self.spark, path)) if files.exists(self.spark, path) else {}

    def retire(self, paths: list[str], now_ms: int | None = None) -> dict[str, int]:
        """Note folders that no new reader needs; those that are noted, with the times."""
        have = self._retired()
        now_ms = int(time.time() * 1000) if now_ms is None else now_ms
        have.update({p: now_ms for p in paths if p not in have})
        files.write_text(self.spark, f"{self.folder}/_RETIRED", json.dumps(have))
        return have

    def truncate(self, watermark: int, grace_ms: int = GRACE_MS, now_ms: int | None = None) -> int:
        """Retire the segments that the checkpoint holds and every follower has read, and delete
        what has been retired for longer than the grace; the number of folders deleted."""
        safe = min([watermark, self.current()["last_lsn"], *self.followers().values()])
        now_ms = int(time.time() * 1000) if now_ms is None else now_ms
        have = self.retire([p for _, last, p in self.segments() if last <= safe], now_ms)
        gone = [p for p, at in have.items() if now_ms - at >= grace_ms]
        for p in gone:
            files.delete(self.spark, p)
        files.write_text(self.spark, f"{self.folder}/_RETIRED", json.dumps({p: t for p, t in have.items() if p not in gone}))
        return len(gone)


def frames(entries: list[bytes]) -> bytes:
    """Entries framed for a byte log: length, CRC-32, bytes."""
    return b"".join(struct.pack("<II", len(e), zlib.crc32(e)) + e for e in entries)


def read_frames(data: bytes) -> Iterator[bytes]:
    """The entries of a byte log; a torn end is ignored, damage before the end is an error."""
    at = 0
    while at + 8 <= len(data):
        size, crc = struct.unpack_from("<II", data, at)
        entry = data[at + 8 : at + 8 + size]
        if len(entry) < size:
            return
        if zlib.crc32(entry) != crc:
            if at + 8 + size >= len(data):
                return
            raise EngineError(f"damaged entry at byte {at}")
        yield entry
        at += 8 + size
