"""Staging tables, versioned snapshots of source tables, and the streams that keep collections current."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import files
from ..types import InvalidArgument, SnapshotDiverged
from .log import ChangeLog

STAGING = "id long, vector_json string, payload string, lsn long, merge_status string, ingested_at_ms long"


@dataclass(frozen=True)
class Maintenance:
    """Settings of incremental maintenance; off unless enabled. 0 rows a tick: no bound."""

    enabled: bool = False
    interval_s: int = 60
    tombstone_threshold: float = 0.2
    full_rescan_rows: int = 1_000_000
    max_rows_per_tick: int = 0

    @classmethod
    def of(cls, settings: dict) -> Maintenance:
        """From a dict; unknown keys are refused."""
        unknown = set(settings) - {f.name for f in fields(cls)}
        if unknown:
            raise InvalidArgument(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(**settings)


def staged(log: DataFrame, now_ms: int) -> DataFrame:
    """Staging rows of a log; deletions have the vector []."""
    down = F.col("op") == "delete"
    return log.select("id", F.when(down, F.lit("[]")).otherwise(F.to_json("vector")).alias("vector_json"), F.when(~down, F.col("payload")).alias("payload"), "lsn", F.when(down, "deleted").otherwise("pending").alias("merge_status"), F.lit(now_ms).cast("long").alias("ingested_at_ms"))


def pending(staging: DataFrame) -> DataFrame:
    """Rows that wait to be merged, as a log in the order of lsn; a vector that isn't JSON is empty."""
    waiting = staging.where(F.col("merge_status").isin("pending", "deleted"))
    v = F.coalesce(F.from_json("vector_json", "array<float>"), F.array().cast("array<float>"))
    return waiting.select("lsn", "id", F.when(F.col("merge_status") == "deleted", "delete").otherwise("upsert").alias("op"), v.alias("vector"), "payload").orderBy("lsn")


class Staging:
    """A staging table in a folder, with the watermark of the last lsn that it holds."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def create(self) -> Staging:
        """Make the table if it isn't there: no rows, watermark 0."""
        if not files.exists(self.spark, f"{self.folder}/_WATERMARK"):
            files.write_text(self.spark, f"{self.folder}/data/.keep", "")
            files.write_text(self.spark, f"{self.folder}/_WATERMARK", json.dumps({"last_lsn": 0}))
        return self

    def watermark(self) -> int:
        path = f"{self.folder}/_WATERMARK"
        return json.loads(files.read_text(self.spark, path))["last_lsn"] if files.exists(self.spark, path) else 0

    def append(self, log: DataFrame, now_ms: int, last_lsn: int) -> int:
        """Add the log's rows after the watermark, then move it; a batch that comes twice adds nothing."""
        mark = self.watermark()
        if last_lsn > mark:
            target = f"{self.folder}/data/{mark + 1:020d}"
            tmp = f"{self.folder}/.tmp-{uuid.uuid4().hex}"
            staged(log.where(F.col("lsn") > mark), now_ms).write.parquet(tmp)
            if files.exists(self.spark, target):
                files.delete(self.spark, target)  # left by a run that ended before it moved the watermark
            files.write_text(self.spark, f"{self.folder}/data/.keep", "")
            files.rename(self.spark, tmp, target)
            files.write_text(self.spark, f"{self.folder}/_WATERMARK", json.dumps({"last_lsn": last_lsn}))
        return max(mark, last_lsn)

    def rows(self) -> DataFrame:
        """All staging rows that the watermark vouches for."""
        parts = [f"{self.folder}/data/{n}" for n in files.names(self.spark, f"{self.folder}/data") if n.isdigit() and int(n) <= self.watermark()]
        return self.spark.read.schema(STAGING).parquet(*parts) if parts else self.spark.createDataFrame([], STAGING)


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    """(collection_name, snapshot_blob, written_at_ms): the last of each collection."""
    last = snapshots.groupBy("collection_name").agg(F.max_by(F.struct("snapshot_blob", "written_at_ms"), "written_at_ms").alias("s"))
    return last.select("collection_name", "s.snapshot_blob", "s.written_at_ms")


def write_snapshot(state: DataFrame, folder: str, collection: str, now_ms: int) -> None:
    """Add a collection's state (id, vector, payload, lsn) to a table of snapshots, a row for at most 10,000
    vectors: (collection_name, part, snapshot_blob, written_at_ms)."""
    body = F.to_json(F.collect_list(F.struct("id", "vector", "payload", "lsn")))
    parts = state.withColumn("part", F.floor(F.monotonically_increasing_id() / 10_000)).groupBy("part").agg(F.encode(body, "UTF-8").alias("snapshot_blob"))
    out = parts.select(F.lit(collection).alias("collection_name"), "part", "snapshot_blob", F.lit(now_ms).cast("long").alias("written_at_ms"))
    out.write.mode("append").parquet(folder)


def read_snapshot(snapshots: DataFrame, collection: str) -> DataFrame:
    """(id, vector, payload, lsn) of the last snapshot of a collection."""
    own = snapshots.where(F.col("collection_name") == collection)
    last = own.agg(F.max("written_at_ms").alias("last"))
    blobs = own.join(F.broadcast(last), F.col("written_at_ms") == F.col("last"))  # one row
    rows = F.from_json(F.decode("snapshot_blob", "UTF-8"), "array<struct<id:long,vector:array<float>,payload:string,lsn:long>>")
    return blobs.select(F.explode(rows).alias("r")).select("r.id", "r.vector", "r.payload", "r.lsn")


class SnapshotTable:
    """A versioned table of Parquet files: each version names its files and its parent."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _manifest(self, version: int) -> dict:
        return json.loads(files.read_text(self.spark, f"{self.folder}/manifests/{version}.json"))

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in files.names(self.spark, f"{self.folder}/manifests") if n.endswith(".json"))

    def commit(self, added: DataFrame | None = None, removed_files: list[str] = (), parent: int | None = None) -> int:
        """A new version: the parent's files without the removed ones, and those of the added rows."""
        have = self.versions()
        parent = parent if parent is not None else (have[-1] if have else None)
        kept = [f for f in (self._manifest(parent)["files"] if parent is not None else []) if f not in set(removed_files)]
        version = (have[-1] if have else 0) + 1
        if added is not None:
            path = f"{self.folder}/data/{version}"
            added.write.parquet(path)
            kept += [f"data/{version}/{n}" for n in files.names(self.spark, path) if n.endswith(".parquet")]
        files.write_text(self.spark, f"{self.folder}/manifests/{version}.json", json.dumps({"parent": parent, "files": kept}))
        return version

    def rows(self, names: list[str], schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{n}" for n in names]) if names else self.spark.createDataFrame([], schema)

    def scan_delta(self, schema, start: int | None, end: int) -> DataFrame:
        """(seq, op, id, vector, payload): changes from start to end, by commit, deletions first.

        start None: everything as upserts. Raises SnapshotDiverged where start
        isn't an ancestor of end. Only the files that a commit adds or drops are
        read; an id that a commit drops and adds again is an upsert alone.
        """
        chain = [end]
        while chain[-1] != start and (parent := self._manifest(chain[-1])["parent"]) is not None:
            chain.append(parent)
        if start is not None and chain[-1] != start:
            raise SnapshotDiverged(f"{start} isn't an ancestor of {end}")
        steps = [(None, end)] if start is None else list(zip(chain[::-1], chain[::-1][1:], strict=False))
        out = None
        for n, (a, b) in enumerate(steps):
            before, now = set(self._manifest(a)["files"]) if a is not None else set(), set(self._manifest(b)["files"])
            new, old = self.rows(sorted(now - before), schema), self.rows(sorted(before - now), schema)
            up = new.select(F.lit(2 * n + 1).alias("seq"), F.lit("upsert").alias("op"), "id", "vector", "payload")
            gone = old.select("id").distinct().join(new.select("id"), "id", "left_anti")
            down = gone.select(F.lit(2 * n).alias("seq"), F.lit("delete").alias("op"), "id", F.lit(None).cast(up.schema["vector"].dataType).alias("vector"), F.lit(None).cast("string").alias("payload"))
            both = down.unionByName(up)
            out = both if out is None else out.unionByName(both)
        return out if out is not None else self.spark.createDataFrame([], "seq int, op string, id long, vector array<float>, payload string")


def flush(log: ChangeLog, staging: Staging, now_ms: int, limit: int = 500, name: str = "staging") -> int:
    """One tick of the flusher: at most ``limit`` changes after the watermark go to staging; the new watermark.

    The log is told how far staging has come, so that a checkpoint drops nothing
    that staging hasn't read. Where changes are gone already (checkpoints before
    the first tick), the live rows are staged instead, and deletions of the
    staged ids that aren't live.
    """
    mark = staging.watermark()
    if name not in log.followers():
        log.follow_as(name, mark)
    now = log.current()["last_lsn"]
    if mark + 1 < log.first_lsn():
        live = log.state()
        up = live.where(F.col("lsn") > mark).select("lsn", "id", F.lit("upsert").alias("op"), "vector", "payload")
        have = staging.rows().groupBy("id").agg(F.max_by("merge_status", "lsn").alias("s")).where("s != 'deleted'")
        down = have.join(live.select("id"), "id", "left_anti").select(F.lit(log.last_lsn()).cast("long").alias("lsn"), "id", F.lit("delete").alias("op"), F.lit(None).cast("array<float>").alias("vector"), F.lit(None).cast("string").alias("payload"))
        done = staging.append(up.unionByName(down), now_ms, max(now, log.last_lsn()))
    else:
        last = min(log.last_lsn(), mark + limit) if limit else log.last_lsn()
        done = staging.append(log.log(mark).where(F.col("lsn") <= last), now_ms, last)
    log.follow_as(name, done)
    return done


def flush_all(log: ChangeLog, staging: Staging, now_ms: int, limit: int = 500, name: str = "staging") -> int:
    """Ticks of the flusher until staging has all of the log; the watermark."""
    done = -1
    while done < log.last_lsn():
        done = flush(log, staging, now_ms, limit, name)
    return done


def run_flusher(log: ChangeLog, staging: Staging, stop: Callable[[], bool], tick_s: float = 0.1, limit: int = 500, checkpoint_s: float = 300.0) -> int:
    """Flush every tick_s and checkpoint every checkpoint_s until stop() says so; then all that is left. The watermark.

    The first checkpoint comes after checkpoint_s, the last at the end. A tick
    that fails leaves the watermark where it was, so the next one repeats it.
    """
    due = time.monotonic() + checkpoint_s
    while not stop():
        if staging.watermark() < log.last_lsn():
            flush(log, staging, int(time.time() * 1000), limit)
        else:
            time.sleep(tick_s)
        if time.monotonic() >= due:
            log.checkpoint_if_due(1)
            due = time.monotonic() + checkpoint_s
    done = flush_all(log, staging, int(time.time() * 1000), 0)
    log.checkpoint_if_due(1)
    return done


def follow(changes: DataFrame, log: ChangeLog, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """A stream that commits a streaming DataFrame (seq, id, op, vector, payload) to the log, each batch once.

    The number of the last batch is kept beside the log; a batch that is given
    again after a failure is passed over if it was committed.
    """
    mark = f"{log.folder}/_BATCH"

    def commit(batch: DataFrame, number: int) -> None:
        done = json.loads(files.read_text(log.spark, mark)) if files.exists(log.spark, mark) else {"batch": -1, "last_lsn": 0}
        started = json.loads(files.read_text(log.spark, f"{mark}.next")) if files.exists(log.spark, f"{mark}.next") else None
        if number <= done["batch"]:
            return
        if not (started and started["batch"] == number and log.last_lsn() > started["before"]):
            files.write_text(log.spark, f"{mark}.next", json.dumps({"batch": number, "before": log.last_lsn()}))
            log.append(batch)
        files.write_text(log.spark, mark, json.dumps({"batch": number, "last_lsn": log.last_lsn()}))

    return changes.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def tick(delta: DataFrame, done: int, config: Maintenance) -> DataFrame:
    """The next rows of a numbered delta (n, ...) after ``done``, as many as a tick may apply; none if disabled."""
    if not config.enabled:
        return delta.where("false")
    rows = delta.where(F.col("n") > done)
    return rows.where(F.col("n") <= done + config.max_rows_per_tick) if config.max_rows_per_tick else rows


def maintain(collection, source: SnapshotTable, schema, config: Maintenance) -> dict:
    """One tick of maintenance of a collection that follows a versioned table.

    The table's changes since the version last applied (kept beside the log) go
    to the collection, at most ``max_rows_per_tick`` of them at a time; the rest
    waits for the next tick. A source that no longer descends from that version,
    or a delta of more than ``full_rescan_rows``, is scanned as a whole, and ids
    that it doesn't have are deleted. An index with more than
    ``tombstone_threshold`` of its rows gone is rebuilt. Returns what was done.
    """
    out = {"applied": 0, "waiting": 0, "rescan": False, "rebuilt": False}
    versions = source.versions()
    if not config.enabled or not versions:
        return out
    spark, path = collection.spark, f"{collection.folder}/_APPLIED"
    at = json.loads(files.read_text(spark, path)) if files.exists(spark, path) else {"version": None, "to": None, "rescan": False}
    end = at["to"] or versions[-1]
    if at["version"] != end:
        rescan = at["rescan"]
        try:
            delta = source.scan_delta(schema, None if rescan else at["version"], end)
            rescan = rescan or (at["version"] is not None and delta.count() > config.full_rescan_rows)
        except SnapshotDiverged:
            rescan = True
        if rescan:
            delta = source.scan_delta(schema, None, end)
            gone = collection.rows().select("id").join(delta.select("id"), "id", "left_anti")
            delta = gone.select(F.lit(0).alias("seq"), F.lit("delete").alias("op"), "id", F.lit(None).cast(delta.schema["vector"].dataType).alias("vector"), F.lit(None).cast("string").alias("payload")).unionByName(delta)
        # a bound on a tick is small, so its rows are the first of one sort
        limit, order = config.max_rows_per_tick, ["seq", "id", "op"]
        if at.get("last"):
            delta = delta.where(F.struct(*order) > F.struct(F.lit(at["last"][0]), F.lit(at["last"][1]).cast("long"), F.lit(at["last"][2])))
        left = delta.count()
        rows = delta.orderBy(*order).limit(limit) if limit else delta
        last = rows.orderBy(F.desc("seq"), F.desc("id"), F.desc("op")).first() if limit and limit < left else None
        collection.apply(rows)
        out |= {"applied": min(limit, left) if limit else left, "waiting": max(0, left - limit) if limit else 0, "rescan": rescan}
        now = {"version": at["version"], "to": end, "rescan": rescan, "last": list(last[c] for c in order)} if last else {"version": end, "to": None, "rescan": False}
        files.write_text(spark, path, json.dumps(now))
    if collection.tombstones() > config.tombstone_threshold:
        collection.build_index()
        out["rebuilt"] = True
    return out


def run_maintenance(collection, source: SnapshotTable, schema, config: Maintenance, stop: Callable[[], bool]) -> int:
    """Ticks every ``interval_s`` until stop() says so; the number of rows applied."""
    applied = 0
    while config.enabled and not stop():
        done = maintain(collection, source, schema, config)
        applied += done["applied"]
        if not done["waiting"]:
            time.sleep(config.interval_s)
    return applied


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) of events (ts, event_type, value), batch or stream, by tumbling windows."""
    marked = events.withWatermark("ts", late)
    by = marked.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return by.select(F.col("w.start").alias("start"), "event_type", "n", "total")
