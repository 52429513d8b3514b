"""Seed and extend: repeated runs of units (words or lines) across documents.

Documents are sequences of 64-bit unit hashes. Winnowed k-grams are anchors;
the occurrences of an anchor are joined with its first occurrence (by document
id, then position), never with each other, so a passage that n documents share
makes n - 1 pairs. Each pair's documents are compared unit by unit, both ways
from the anchor, to the full extent of the match.

A match with the first occurrence alone can hide a longer one: B and C may
agree where both differ from the first. So the runs of ``least = k + w - 1``
units around an anchor that its match doesn't cover are hashed as a whole, and
joined with their own first occurrence. A run whose first occurrence is not
that of its anchor is among those in both documents, because the winnowed
anchor of a run depends on nothing else. One more extension is thus enough:

* every reported run is a match of at least ``least`` units with an earlier
  place that can't be extended to either side, and
* every run of ``least`` units that also occurs at an earlier place lies within
  the union of its document's reported runs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text
from ._shared import SLICE_BYTES, Scratch

Units = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]
_OUT = pa.schema([("kind", pa.int8()), ("id", pa.int64()), ("tag", pa.int64()), ("rid", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("c", pa.int32()), ("h", pa.int64())])
_OUT_SQL = "kind tinyint, id long, tag long, rid long, a int, b int, c int, h long"


def word_units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of texts."""
    w = _text.words(column)
    return w.hashes, w.first


def list_units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ready-made unit hashes in a column of lists."""
    column = column.cast(pa.large_list(pa.int64()))
    first = np.asarray(column.offsets).astype(np.int64)
    values = np.asarray(column.values).view(np.uint64)[first[0] : first[-1]] if len(column) else np.zeros(0, np.uint64)
    return values, first - (first[0] if len(first) else 0)


def _sized(batches: Iterator[pa.RecordBatch], columns: list[str], limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = sum(np.diff(np.asarray(_offsets(batch.column(c)))) for c in columns) if batch.num_rows else np.zeros(0)
        total, at = np.cumsum(sizes), 0
        while at < len(sizes):
            done = int(total[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(total, done + limit, side="right")))
            yield batch.slice(at, end - at)
            at = end


def _offsets(column: pa.Array) -> np.ndarray:
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        return _text.utf8(column)[0]
    return np.asarray(column.offsets).astype(np.int64) * 8


def _anchors(units: Units, k: int, w: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sized(batches, ["unit"]):
            values, first = units(batch.column("unit"))
            at, hashes = _text.winnow(values, first, k, w)
            doc = np.searchsorted(first, at, side="right") - 1
            ids = np.asarray(batch.column("id"))
            yield pa.record_batch([pa.array(hashes.view(np.int64)), pa.array(ids[doc]), pa.array((at - first[doc]).astype(np.int32))], names=["h", "id", "pos"])

    return run


def _run_length(x: np.ndarray, y: np.ndarray) -> int:
    """Length of the common prefix."""
    n, at, step = min(len(x), len(y)), 0, 32
    while at < n:
        end = min(n, at + step)
        differ = x[at:end] != y[at:end]
        if differ.any():
            return at + int(differ.argmax())
        at, step = end, step * 4
    return n


def _extended(x: np.ndarray, y: np.ndarray, own: bool, pos: np.ndarray, rpos: np.ndarray, k: int, least: int) -> list[tuple[int, int, int]]:
    """(start, end, start in y) of the matches of at least ``least`` units around the seeds, which are sorted."""
    out, at = [], {}
    best = (0, 0, 0)
    for p, r in zip(pos.tolist(), rpos.tolist(), strict=True):
        d = p - r
        s, e = at.get(d, (0, 0))
        if s <= p and p + k <= e:
            continue
        if p + k > len(x) or r + k > len(y) or (own and p <= r) or not np.array_equal(x[p : p + k], y[r : r + k]):
            continue
        bs, be, bd = best
        if bs <= max(0, p + k - least) and min(len(x), p + least) <= be and (be == len(x) or be - bd == len(y) or x[be] != y[be - bd]):
            # all around the seed is covered, so what matches here is inside or reaches on from another seed
            if p + k < be and _run_length(x[p + k : be], y[r + k :]) < be - p - k:
                continue
        e = p + _run_length(x[p:], y[r:])
        s = p - _run_length(x[:p][::-1], y[:r][::-1])
        at[d] = (s, e)
        if e - s > be - bs or p >= be:
            best = (s, e, d)
        if e - s >= least:
            out.append((s, e, s - d))
    return out


def _open_starts(n: int, pos: np.ndarray, matches: list[tuple[int, int, int]], k: int, least: int) -> np.ndarray:
    """Starts of the runs of ``least`` units that hold a seed and lie in no match."""
    if n < least:
        return np.zeros(0, np.int64)
    edge = np.zeros(n + 2, dtype=np.int32)
    np.add.at(edge, np.clip(pos + k - least, 0, n - least + 1), 1)
    np.add.at(edge, np.clip(pos + 1, 0, n - least + 1), -1)
    open_ = np.cumsum(edge[: n - least + 1]) > 0
    for s, e, _ in matches:
        open_[s : e - least + 1] = False
    return np.flatnonzero(open_)


def _extend(units: Units, k: int, least: int, open_runs: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sized(batches, ["unit", "runit"], SLICE_BYTES * 2):
            v, first = units(batch.column("unit"))
            rv, rfirst = units(batch.column("runit"))
            ids, tags, rids = (np.asarray(batch.column(c)) for c in ("id", "tag", "rid"))
            seeds = batch.column("seeds")
            offsets = np.asarray(seeds.offsets)
            pos, rpos = (np.asarray(seeds.values.field(f)) for f in ("pos", "rpos"))
            rows: list[tuple] = []
            runs: list[tuple[int, np.ndarray, np.ndarray]] = []
            for i in range(batch.num_rows):
                x, y = v[first[i] : first[i + 1]], rv[rfirst[i] : rfirst[i + 1]]
                lo, hi = offsets[i], offsets[i + 1]
                order = np.lexsort((rpos[lo:hi], pos[lo:hi])) + lo
                top, kept = -1, []
                for m in sorted(set(_extended(x, y, ids[i] == rids[i], pos[order], rpos[order], k, least)), key=lambda m: (m[0], -m[1], m[2])):
                    if m[1] > top:
                        top = m[1]
                        kept.append(m)
                        rows.append((0, ids[i], tags[i], rids[i], *m, 0))
                if open_runs and len(starts := _open_starts(len(x), pos[order], kept, k, least)):
                    for part in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
                        runs.append((i, part, _text.gram_hashes(x[part[0] : part[-1] + least], least)))
            cols = list(zip(*rows, strict=True)) or [[]] * len(_OUT)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, _OUT, strict=True)], schema=_OUT)
            if runs:
                i = np.repeat([r[0] for r in runs], [len(r[1]) for r in runs])
                start, h = np.concatenate([r[1] for r in runs]).astype(np.int32), np.concatenate([r[2] for r in runs]).view(np.int64)
                none = np.zeros(len(i), np.int32)
                yield pa.record_batch([pa.array(np.ones(len(i), np.int8)), pa.array(ids[i]), pa.array(tags[i]), pa.array(rids[i]), pa.array(start), pa.array(none), pa.array(none), pa.array(h)], schema=_OUT)

    return run


def _paired(occurrences: DataFrame) -> DataFrame:
    """(id, rid, seeds): each occurrence of h but the first, with the first, by pair of documents."""
    place = F.struct("id", "pos")
    firsts = occurrences.groupBy("h").agg(F.min(place).alias("r"), F.max(place).alias("z")).where("r != z").select(F.col("h").alias("g"), F.col("r.id").alias("rid"), F.col("r.pos").alias("rpos"))
    joined = occurrences.join(firsts, F.col("h") == F.col("g")).where("id != rid or pos != rpos")
    return joined.groupBy("id", "rid").agg(F.collect_set(F.struct("pos", "rpos")).alias("seeds"))


def find_repeats(docs: DataFrame, units: Units, k: int, w: int, scratch: Scratch) -> DataFrame:
    """Repeated runs of at least ``k + w - 1`` units.

    docs: (id long not null, tag long, unit): tag tells rows of the same id
    apart, unit is what ``units`` turns into hashes. Rows that are repeated as a
    whole count once. Returns (id, tag, start, end, rid, rstart): units start to
    end of the document also stand at rstart of document rid, an earlier place.
    Of runs that lie within another of their document, only the outer is kept.
    """
    least = k + w - 1
    docs = docs.select("id", "tag", "unit")
    found = docs.select("id", "unit").mapInArrow(_anchors(units, k, w), "h long, id long, pos int")
    pairs = scratch.table(_paired(found), "pairs")
    needed = pairs.select("id").union(pairs.select("rid")).distinct().withColumnRenamed("id", "need")
    texts = scratch.table(docs.join(needed, F.col("id") == F.col("need"), "left_semi").dropDuplicates(["id", "tag"]), "texts")
    others = texts.select(F.col("id").alias("other"), F.col("unit").alias("runit"))

    def extended(pairs: DataFrame, k: int, open_runs: bool, name: str) -> DataFrame:
        full = pairs.join(texts, "id").join(others, F.col("rid") == F.col("other")).select("id", "tag", "rid", "unit", "runit", "seeds")
        return scratch.table(full.mapInArrow(_extend(units, k, least, open_runs), _OUT_SQL), name)

    out = extended(pairs, k, True, "extended")
    again = extended(scratch.table(_paired(out.where("kind = 1").select("h", "id", F.col("a").alias("pos"))), "open"), least, False, "again")
    for name in ("pairs", "texts", "open"):
        scratch.drop(name)
    matches = out.where("kind = 0").unionByName(again.where("kind = 0")).select("id", "tag", F.col("a").alias("start"), F.col("b").alias("end"), "rid", F.col("c").alias("rstart"))
    before = Window.partitionBy("id", "tag").orderBy("start", F.desc("end"), "rid", "rstart").rowsBetween(Window.unboundedPreceding, -1)
    return matches.withColumn("__top", F.max("end").over(before)).where("__top is null or end > __top").drop("__top")
