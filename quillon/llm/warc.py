"""WARC: a writer of dictionary-compressed archives.

An archive is a Zstandard file of many frames: a skippable frame (magic
0x184D2A5D) that holds the dictionary, then one frame for each record, each
compressed by itself with that dictionary. A reader that has the leading frame
can read any record at its offset.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs  # noqa: F401 - as pa.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of records in an archive, of its dictionary at most, and the level.
ARCHIVE_BYTES, DICTIONARY_BYTES, LEVEL = 16 << 20, 112 << 10, 6
SKIPPABLE = 0x184D2A5D
#: Every record's date, so that the same pages give the same bytes.
DATE = "2025-01-01T00:00:00Z"
SCHEMA = "archive string, seq int, page_id long, kind string, offset long, length long, frame binary"
_ARROW = pa.schema([("archive", pa.string()), ("seq", pa.int32()), ("page_id", pa.int64()), ("kind", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("frame", pa.binary())])
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def record(page_id: int | None, url: str | None, html: str | None, date: str = DATE) -> bytes:
    """A WARC/1.1 resource record. No URL: no WARC-Target-URI; no page: an empty block."""
    body = (html or "").encode()
    name = uuid.uuid5(_NAMESPACE, f"{page_id}\n{url}")
    head = ["WARC/1.1", "WARC-Type: resource", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {date}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    if url is not None:
        head.insert(3, "WARC-Target-URI: " + "".join(url.split()))
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def dictionary_of(records: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary trained on all records; from too little to train on, their own bytes."""
    total = sum(map(len, records))
    try:
        return zstandard.train_dictionary(min(size, max(256, total // 8)), records, k=512, d=8, f=18, accel=2).as_bytes()
    except zstandard.ZstdError:
        return b"".join(records)[-size:]


def frames(records: list[bytes], dictionary: bytes, level: int = LEVEL) -> Iterator[bytes]:
    """The leading frame with the dictionary, then each record's frame."""
    packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
    yield struct.pack("<II", SKIPPABLE, len(packed)) + packed
    use = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True, write_checksum=True)
    for r in records:
        yield use.compress(r)


def read_archive(data: bytes) -> list[bytes]:
    """The records of an archive."""
    magic, size = struct.unpack_from("<II", data)
    if magic != SKIPPABLE:
        raise ValueError("the archive doesn't begin with a dictionary")
    dictionary = zstandard.ZstdDecompressor().decompress(data[8 : 8 + size])
    out, rest = [], data[8 + size :]
    while rest:
        d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).decompressobj()
        out.append(d.decompress(rest))
        rest = d.unused_data
    return out


def _archive(name: str, rows: list[tuple[int | None, bytes]], size: int, level: int) -> Iterator[pa.RecordBatch]:
    records = [r for _, r in rows]
    offset, out, held = 0, [], 0
    for seq, frame in enumerate(frames(records, dictionary_of(records, size), level)):
        out.append((name, seq, rows[seq - 1][0] if seq else None, "record" if seq else "dictionary", offset, len(frame), frame))
        offset += len(frame)
        held += len(frame)
        if held > 4 << 20:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ARROW, strict=True)], schema=_ARROW)
            out, held = [], 0
    if out:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ARROW, strict=True)], schema=_ARROW)


def archive_frames(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES, dictionary_bytes: int = DICTIONARY_BYTES, level: int = LEVEL) -> DataFrame:
    """All frames of the archives of all pages (page_id, url, html).

    Returns (archive, seq, page_id, kind, offset, length, frame). The frames of an
    archive, joined in the order of seq, are its file; seq 0 is the dictionary,
    which is trained on all of the archive's records. A task's pages make one
    archive for each ``archive_bytes`` of records, in the order they are read, so
    nothing is shuffled and a task that is run again gives the same bytes.

    A null or empty page makes a record with an empty block, a null URL one
    without a target; every row, repeated ones too, has its record; pages of any
    length are one record. Ties play no part. page_id is an integer. Other
    columns, whatever their names, are ignored; an empty table gives no archive.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, rows, held = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for page, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append((page, record(page, url, html)))
                held += len(rows[-1][1])
                if held >= archive_bytes:
                    yield from _archive(f"part-{part:05d}-{number:04d}.warc.zst", rows, dictionary_bytes, level)
                    number, rows, held = number + 1, [], 0
        if rows:
            yield from _archive(f"part-{part:05d}-{number:04d}.warc.zst", rows, dictionary_bytes, level)

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, SCHEMA)


def write_archives(frames_: DataFrame, folder: str) -> DataFrame:
    """Write the archives as files of ``folder``, which all executors share; returns (archive, bytes, records).

    folder is a path or a URI of any file system that Arrow knows (file, s3, gs, hdfs).
    A file is written under a name of the task's own and renamed when it is whole,
    so lost and repeated tasks leave no torn or double file.
    """
    uri = folder if "://" in folder else f"file://{folder}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pa.fs.FileSystem.from_uri(uri)
        fs.create_dir(path, recursive=True)
        name, out, size, records, tmp = None, None, 0, 0, ""
        done: list[tuple[str, int, int]] = []

        def close() -> None:
            if out is not None:
                out.close()
                fs.move(tmp, f"{path}/{name}")
                done.append((name, size, records))

        for batch in batches:
            frame = batch.column("frame")
            for i, archive in enumerate(batch.column("archive").to_pylist()):
                if archive != name:
                    close()
                    name, size, records = archive, 0, -1
                    tmp = f"{path}/.{archive}.{uuid.uuid4().hex}"
                    out = fs.open_output_stream(tmp)
                out.write(frame[i].as_buffer())
                size, records = size + len(frame[i].as_buffer()), records + 1
        close()
        if done:
            yield pa.record_batch([pa.array(c) for c in zip(*done, strict=True)], names=["archive", "bytes", "records"])

    placed = frames_.repartition("archive").sortWithinPartitions("archive", "seq")
    return placed.select("archive", "frame").mapInArrow(run, "archive string, bytes long, records long")
