"""WARC archives with a two-level capture index.

Writing: each task writes archives (a gzip member a record) under names of its partition
and attempt, and names them in its captures, so of a task that runs twice only the files
of the attempt that Spark commits are ever read. Of records with equal payloads the one
with the largest page_id is a response; the others are revisits that refer to it and hold
headers only.

Index: one line a capture, sorted by the key of its URL with the host reversed, packed
into compressed blocks; each file of blocks ends with its sparse directory, the first and
last key and the place of each block. The table of files, one row a partition like the
bounds that Spark's own range partitioning keeps in the driver, has the first and last key
and the directory's place of each. A lookup bisects the files, then in each file's
directory the blocks, reads one range of the file for each block, and then one range of
the archive for each capture. It is the same for one URL and for all.

Files are read and written through pyarrow's file systems, so the folder can be any URI
they know (file, s3, gs, hdfs); it has to be one that all executors share.

Edge cases: a null html is an empty payload; a null or odd url has itself (null: "-") as
key; a null page_id is written as "-" and is never preferred as the response; rows
that share the largest page_id and the payload are all responses; payloads of any length
are kept whole; an empty table gives an empty archive; extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, pick, scratch

_CAPTURE = "key string, page string, file string, offset long, length long"
_FILE = "first string, last string, path string, offset long, length long, blocks long, captures long"
_RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, url string"
_URI = "urn:page:"


@dataclass(frozen=True)
class Archive:
    """Where an archive lies: folder, its captures (one row each, unsorted) and the index files."""

    folder: str
    captures: DataFrame
    files: DataFrame


def url_key(url: Column) -> Column:
    """The host reversed and lower-cased, then port, path and query: ``com,example,www)/a?b``; tabs and line breaks are escaped."""
    parts = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)(.*)$"
    host = F.array_join(F.reverse(F.split(F.lower(F.regexp_extract(url, parts, 1)), r"\.")), ",")
    key = F.coalesce(F.when(url.rlike(parts), F.concat(host, F.lit(")"), F.regexp_extract(url, parts, 2))).otherwise(url), F.lit("-"))
    for sign, escaped in (("\t", "%09"), ("\n", "%0A"), ("\r", "%0D")):
        key = F.replace(key, F.lit(sign), F.lit(escaped))
    return key


def with_representatives(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, refers_to): refers_to is null for responses.

    The largest id of each payload is found by an aggregate that combines before its
    shuffle; the join back is an ordinary one, whose hot payload adaptive execution splits.
    """
    rows = pick(pages, "page_id", "url", "html").withColumn("html", F.coalesce("html", F.lit("")))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    best = rows.groupBy("sha").agg(F.max("page_id").alias("best"))
    later = (F.col("page_id").isNull() & F.col("best").isNotNull()) | (F.col("page_id") < F.col("best"))
    return rows.join(best, "sha").select("page_id", "url", "html", F.when(later, F.col("best")).alias("refers_to"))


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: str, url: str, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{_URI}{page}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {' '.join(url.split())}",
        f"WARC-Payload-Digest: sha1:{_digest(payload)}",
        f"WARC-Block-Digest: sha1:{_digest(body)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{_URI}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return gzip.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n", 6, mtime=0)


def parse(member: bytes) -> dict:
    """The fields of one record; the digest of a response is computed from what was read."""
    head, body = gzip.decompress(member).split(b"\r\n\r\n", 1)
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    body = body[: int(fields["Content-Length"])]
    http, payload = body.split(b"\r\n\r\n", 1)
    length = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
    number = lambda uri: None if (x := uri[len(_URI) + 1 : -1]) == "-" else int(x)
    response = fields["WARC-Type"] == "response"
    digest = _digest(payload) if response else fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if response and (digest != fields["WARC-Payload-Digest"].removeprefix("sha1:") or len(payload) != length):
        raise ValueError(f"record {fields['WARC-Record-ID']} doesn't match its digest")
    return {
        "page_id": number(fields["WARC-Record-ID"]), "payload_bytes": length, "payload_digest": digest,
        "record_type": fields["WARC-Type"], "refers_to": None if response else number(fields["WARC-Refers-To"]),
        "payload": payload if response else None, "url": fields["WARC-Target-URI"],
    }


class _Out:
    """A file that appears under its name when it is whole."""

    def __init__(self, folder: str, name: str) -> None:
        self.fs, base = pa.fs.FileSystem.from_uri(folder)
        self.path, self.part = f"{base}/{name}", f"{base}/.{name}"
        self.fs.create_dir(base, recursive=True)
        self.to, self.at = self.fs.open_output_stream(self.part, compression=None), 0

    def write(self, data: bytes) -> int:
        at = self.at
        self.to.write(data)
        self.at += len(data)
        return at

    def close(self) -> None:
        self.to.close()
        self.fs.move(self.part, self.path)


def _task() -> str:
    """A name for what this attempt of this task writes, which no other attempt has."""
    task = TaskContext.get()
    return f"{task.partitionId():06d}-{task.taskAttemptId()}"


def _uri(folder: str) -> str:
    return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"


def _batches(rows: Iterator[dict], schema: str, size: int = 256) -> Iterator[pa.RecordBatch]:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    arrow = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))])
    part: list[dict] = []
    for x in rows:
        part.append(x)
        if len(part) == size:
            yield pa.RecordBatch.from_pylist(part, arrow)
            part = []
    if part:
        yield pa.RecordBatch.from_pylist(part, arrow)


def write_archive(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", block: int = 1000, file_bytes: int = 1 << 30) -> Archive:
    """Write the records of ``pages`` and their index below ``folder``."""
    folder = _uri(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def captures() -> Iterator[dict]:
            out, files, task = None, 0, _task()
            for b in batches:
                for key, page, url, html, refers in zip(*[b.column(i).to_pylist() for i in range(5)], strict=True):
                    if out is None:
                        out, files = _Out(f"{folder}/archive", name := f"{task}-{files:04d}.warc.gz"), files + 1
                    page = "-" if page is None else str(page)
                    member = record(page, url or "-", html.encode("utf-8", "surrogatepass"), refers, date)
                    yield {"key": key, "page": page, "file": name, "offset": out.write(member), "length": len(member)}
                    if out.at >= file_bytes:
                        out.close()
                        out = None
            if out is not None:
                out.close()

        return _batches(captures(), _CAPTURE, 4096)

    rows = with_representatives(pages).select(url_key(F.col("url")).alias("key"), "page_id", "url", "html", "refers_to")
    captures = materialize(rows.mapInArrow(write, _CAPTURE), "captures")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def files() -> Iterator[dict]:
            out, lines, blocks, count = None, [], [], 0
            name = f"{_task()}.idx"

            def packed(rows: list[list[str]]) -> bytes:
                return zlib.compress("\n".join("\t".join(x) for x in rows).encode("utf-8", "surrogatepass"), 6)

            def full() -> None:
                data = packed(lines)
                blocks.append([lines[0][0], lines[-1][0], str(out.write(data)), str(len(data))])
                lines.clear()

            for b in batches:
                for x in zip(*[b.column(i).to_pylist() for i in range(5)], strict=True):
                    out = out or _Out(f"{folder}/index", name)
                    lines.append(list(map(str, x)))
                    count += 1
                    if len(lines) == block:
                        full()
            if out is not None:
                if lines:
                    full()
                directory = packed(blocks)
                at = out.write(directory)
                out.close()
                yield {"first": blocks[0][0], "last": blocks[-1][1], "path": name, "offset": at, "length": len(directory), "blocks": len(blocks), "captures": count}

        return _batches(files(), _FILE)

    ordered = captures.repartitionByRange("key", "file", "offset").sortWithinPartitions("key", "file", "offset")
    return Archive(folder, captures, materialize(ordered.mapInArrow(pack, _FILE), "index-files"))


def _lines(f, offset: int, length: int) -> list[list[str]]:
    f.seek(offset)
    return [x.split("\t") for x in zlib.decompress(f.read(length)).decode("utf-8", "surrogatepass").split("\n")]


def _capture(line: list[str]) -> dict:
    key, page, file, offset, length = line
    return {"key": key, "page": page, "file": file, "offset": int(offset), "length": int(length)}


def index_captures(archive: Archive) -> DataFrame:
    """Every capture, read from the blocks of every index file."""
    folder = archive.folder

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pa.fs.FileSystem.from_uri(f"{folder}/index")

        def captures() -> Iterator[dict]:
            for b in batches:
                for x in b.to_pylist():
                    with fs.open_input_file(f"{base}/{x['path']}") as f:
                        for _, _, at, size in _lines(f, x["offset"], x["length"]):
                            yield from map(_capture, _lines(f, int(at), int(size)))

        return _batches(captures(), _CAPTURE, 4096)

    return archive.files.repartition(F.col("path")).mapInArrow(read, _CAPTURE)


def lookup(archive: Archive, urls: DataFrame) -> DataFrame:
    """The captures of the URLs in column ``url``, each once, by bisection of the index and range reads."""
    folder, spark = archive.folder, archive.files.sparkSession
    files = sorted(map(tuple, archive.files.select("first", "last", "path", "offset", "length").collect()))  # one row a partition
    shared = spark.sparkContext.broadcast(files)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = shared.value
        lasts = [x[1] for x in files]

        def places() -> Iterator[dict]:
            for b in batches:
                for key in b.column(0).to_pylist():
                    k = bisect_left(lasts, key)
                    while k < len(files) and files[k][0] <= key:
                        yield {"number": k, "key": key}
                        k += 1

        return _batches(places(), "number long, key string", 4096)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pa.fs.FileSystem.from_uri(f"{folder}/index")
        files = shared.value

        def captures() -> Iterator[dict]:
            number, f, read, lines = None, None, None, []
            for b in batches:
                for n, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if n != number:
                        if f is not None:
                            f.close()
                        number, read = n, None
                        f = fs.open_input_file(f"{base}/{files[n][2]}")
                        blocks = _lines(f, *files[n][3:])
                        lasts = [x[1] for x in blocks]
                    k = bisect_left(lasts, key)
                    while k < len(blocks) and blocks[k][0] <= key:
                        if read != k:  # keys come in order, so a block is read once for all of its keys
                            read, lines = k, _lines(f, int(blocks[k][2]), int(blocks[k][3]))
                        i = bisect_left(lines, key, key=lambda x: x[0])
                        while i < len(lines) and lines[i][0] == key:
                            yield _capture(lines[i])
                            i += 1
                        k += 1
            if f is not None:
                f.close()

        return _batches(captures(), _CAPTURE, 4096)

    keys = pick(urls, "url").select(url_key(F.col("url")).alias("key")).distinct()
    placed = keys.mapInArrow(place, "number long, key string")
    return placed.repartitionByRange("number", "key").sortWithinPartitions("number", "key").mapInArrow(find, _CAPTURE)


def read_records(archive: Archive, captures: DataFrame, payload: bool = True, part_bytes: int = 1 << 27) -> DataFrame:
    """The records at the captures' ranges; neighbours in one archive are read by one task in order."""
    folder = archive.folder

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pa.fs.FileSystem.from_uri(f"{folder}/archive")

        def records() -> Iterator[dict]:
            name, f = None, None
            for b in batches:
                for x in b.select(["file", "offset", "length"]).to_pylist():
                    if x["file"] != name:
                        if f is not None:
                            f.close()
                        name, f = x["file"], fs.open_input_file(f"{base}/{x['file']}")
                    f.seek(x["offset"])
                    yield parse(f.read(x["length"])) | ({} if payload else {"payload": None})
            if f is not None:
                f.close()

        return _batches(records(), _RECORD)

    # By the bytes that are to be read, as the rows that name them are tiny.
    written = archive.captures.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    parts = max(captures.sparkSession.sparkContext.defaultParallelism, -(-written // part_bytes))
    places = captures.select("file", "offset", "length").repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")
    return places.mapInArrow(read, _RECORD)


def archive_digests(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write the pages as an archive in the shared folder, look their URLs up in its index and read the records back."""
    archive = write_archive(pages, scratch(spark, "warc"))
    return read_records(archive, lookup(archive, pages), payload=False).drop("payload")
