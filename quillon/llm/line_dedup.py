"""Line dedup: winnowing over line hashes; later repeats of a run of lines go.

Two kinds of fingerprints make sure that no repeat is missed. Grams of short
lines are winnowed, so that every run of three lines that two documents share
has a common window minimum; the matches are extended both ways. A long line is
a run by itself: each is its own window, and is joined with its first place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text
from ._repeats import find_repeats, list_units
from ._shared import Scratch, fresh, known, pieces

#: Lines in a fingerprinted gram, and grams in a window: runs of GRAM + WINDOW - 1 = 3 lines are found.
GRAM, WINDOW = 2, 2
#: A line of so many bytes of UTF-8, without the white space around it, is found alone.
LONG_LINE = 80


def line_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, line numbers, bytes, first of each text) of the lines that aren't blank.

    Spaces, tabs and carriage returns around a line don't count.
    """
    base, data = _text.utf8(column)
    n = len(data)
    breaks = np.flatnonzero(data == 10)
    # every text has one line more than it has line breaks
    per = np.diff(np.searchsorted(breaks, base)) + 1
    first = np.concatenate([[0], np.cumsum(per)])
    doc = np.repeat(np.arange(len(per)), per)
    starts = _line_starts(base, breaks, per, first)
    ends = np.empty_like(starts)
    if len(starts):
        ends[:-1] = starts[1:] - 1
        last = first[1:] - 1
        ends[last] = base[1:]
    ink = np.ones(n + 1, dtype=bool)
    ink[:n] = ~np.isin(data, np.frombuffer(b" \t\r\n", np.uint8))
    at = np.flatnonzero(ink[:n])
    lo = np.searchsorted(at, starts)
    hi = np.searchsorted(at, ends)
    full = hi > lo
    begin, stop = at[lo[full]], at[hi[full] - 1] + 1
    number = np.arange(len(starts)) - first[doc]
    counts = np.bincount(doc[full], minlength=len(per))
    return _text.span_hashes(data, begin, stop), number[full], stop - begin, np.concatenate([[0], np.cumsum(counts)])


def _line_starts(base: np.ndarray, breaks: np.ndarray, per: np.ndarray, first: np.ndarray) -> np.ndarray:
    starts = np.empty(int(first[-1]), dtype=np.int64)
    opening = np.zeros(len(starts), dtype=bool)
    opening[first[:-1]] = True
    starts[opening] = base[:-1]
    starts[~opening] = breaks + 1
    return starts


def _lines(long_line: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            hashes, number, size, first = line_hashes(batch.column("text"))
            offsets = pa.array(first.astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (hashes.view(np.int64), number.astype(np.int32), size >= long_line)]
            yield pa.record_batch([batch.column("id"), batch.column("tag"), *lists], names=["id", "tag", "unit", "number", "long"])

    return run


def later_runs(docs: DataFrame, scratch: Scratch, gram: int = GRAM, window: int = WINDOW, long_line: int = LONG_LINE) -> DataFrame:
    """(id, tag, cut): the line numbers ``[s, e)`` of each document's runs that occur earlier."""
    rows = docs.select(known("doc_id").alias("id"), F.xxhash64("text").alias("tag"), "text")
    least = gram + window - 1
    found = rows.mapInArrow(_lines(long_line), "id long, tag long, unit array<long>, number array<int>, long array<boolean>")
    lines = scratch.table(found.where((F.size("unit") >= least) | F.array_contains("long", F.lit(True))), "lines")
    runs = find_repeats(lines.where(F.size("unit") >= least), list_units, gram, window, scratch).select("id", "tag", "start", "end")
    spots = lines.select("id", "tag", "number").dropDuplicates(["id", "tag"])
    span = F.struct(F.element_at("number", F.col("start") + 1).alias("s"), (F.element_at("number", F.col("end")) + 1).alias("e"))
    many = runs.join(spots, ["id", "tag"]).select("id", "tag", span.alias("cut"))
    # long lines by themselves: each but the first is cut, in documents of any number of lines
    alone = lines.select("id", "tag", F.explode(F.filter(F.arrays_zip("unit", "number", "long"), lambda x: x["long"])).alias("x")).select("id", "tag", F.col("x.unit").alias("h"), F.col("x.number").alias("nr"))
    place = F.struct("id", "nr")
    firsts = alone.groupBy("h").agg(F.min(place).alias("r"), F.max(place).alias("z")).where("r != z").select("h", F.col("r.id").alias("rid"), F.col("r.nr").alias("rnr"))
    single = alone.join(firsts, "h").where("id != rid or nr != rnr").select("id", "tag", F.struct(F.col("nr").alias("s"), (F.col("nr") + 1).alias("e")).alias("cut"))
    cuts = scratch.table(many.unionByName(single).groupBy("id", "tag").agg(F.collect_set("cut").alias("cut")), "cuts")
    for name in ("lines", "extended", "again"):
        scratch.drop(name)
    return cuts


def _kept(text: Column, cut: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda _, i: ~F.exists(cut, lambda c: (i >= c["s"]) & (i < c["e"]))), "\n")


def dedup_lines(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, long_line: int = LONG_LINE) -> DataFrame:
    """docs with text less its repeated runs of lines, and removed_lines.

    A run of at least ``gram + window - 1`` successive lines that also occurs at
    an earlier place (smaller doc_id, or earlier in the document) is deleted,
    with the blank lines inside it, and so is a line of at least ``long_line``
    bytes by itself. Blank lines are not counted as lines; lines are compared
    without the white space around them. What stays is unchanged.

    All rows and columns stay, whatever the columns' names (one of docs named
    removed_lines is replaced; n_chars, where there is one, is set to the new
    length where lines go). A document may be left with an empty text. Null and
    empty texts stay as they are; texts of any length are searched whole. Rows
    that are equal in doc_id and text count as one document and get the same
    cut; rows of one doc_id with different texts tie where they have the same
    line at the same number, and both keep it. doc_id is an integer; a null one
    sorts first. An empty table stays empty.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    id_, tag, cut, new = fresh(docs, "q_id", "q_tag", "q_cut", "q_text")
    cuts = later_runs(docs, scratch, gram, window, long_line).select(F.col("id").alias(id_), F.col("tag").alias(tag), F.col("cut").alias(cut))
    own = [c for c in docs.columns if c.lower() != "removed_lines"]
    rows = docs.select(*[F.col(f"`{c}`") for c in own], known("doc_id").alias(id_), F.xxhash64("text").alias(tag))
    # the same plan at every size: the texts move once, however few of them are cut
    out = rows.join(cuts.hint("merge"), [id_, tag], "left")
    out = out.withColumn(new, F.when(F.col(cut).isNull(), F.col("text")).otherwise(_kept(F.col("text"), F.col(cut))))
    lines = F.size(F.split("text", "\n", -1)) - F.when(F.col(new) == "", 0).otherwise(F.size(F.split(new, "\n", -1)))
    made = {"text": F.col(new)}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(F.col(cut).isNull(), F.col("n_chars")).otherwise(F.length(new).cast(dict(docs.dtypes)["n_chars"]))
    columns = [made[c].alias(c) if c in made else F.col(f"`{c}`") for c in own]
    return out.select(*columns, F.when(F.col(cut).isNull(), 0).otherwise(lines).alias("removed_lines"))


#: What dedup_lines gives for documents, as SQL.
SQL = f"""
WITH raw AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS nr FROM raw),
n AS (SELECT doc_id, trim(line, ' ' || chr(9) || chr(13)) AS line, nr, row_number() OVER (PARTITION BY doc_id ORDER BY nr) AS pos
      FROM l WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''),
g AS (SELECT doc_id, pos, nr, lead(nr, 2) OVER w AS upto, md5(line) || md5(lead(line) OVER w) || md5(lead(line, 2) OVER w) AS gram
      FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
f AS (SELECT *, row_number() OVER (PARTITION BY gram ORDER BY doc_id, pos) AS nth FROM g WHERE gram IS NOT NULL),
alone AS (SELECT doc_id, nr, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS nth FROM n WHERE strlen(line) >= {LONG_LINE}),
gone AS (SELECT f.doc_id, l.nr FROM f JOIN l ON l.doc_id = f.doc_id AND l.nr BETWEEN f.nr AND f.upto WHERE nth > 1
         UNION SELECT doc_id, nr FROM alone WHERE nth > 1),
kept AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.nr) AS text FROM l ANTI JOIN gone USING (doc_id, nr) GROUP BY l.doc_id),
cut AS (SELECT doc_id, count(*) AS removed_lines FROM gone GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN cut.doc_id IS NULL THEN d.text ELSE coalesce(kept.text, '') END AS text, d.lang, d.source,
       CASE WHEN cut.doc_id IS NULL THEN d.n_chars ELSE length(coalesce(kept.text, '')) END AS n_chars,
       CAST(coalesce(removed_lines, 0) AS INTEGER) AS removed_lines
FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN cut USING (doc_id)
"""
