"""WARC writing with revisit records, and a salvage reader.

Writing: a Python data source writes one gzip member for each record, and rolls over to a new archive after
``archive_bytes``. Every task attempt writes files of its own; only those of attempts that Spark accepted are
moved into the folder, so lost executors and repeated attempts leave no stray archive.

Reading: Spark lists the archives, and each task streams its own from the file system, so no more than one record is
held; a record of more than ``max_record_bytes`` counts as damaged. At each place the reader expects a gzip member
or, in plain archives, a version line. A member must inflate, pass its CRC, hold one well-formed record and match
the record's block digest. After a failed check the reader searches for the next valid member or version line, goes
on from there, and returns the bytes between as a ``gap`` row with the reason: nothing is skipped silently.

Null payload counts as empty. Rows with equal payloads of at least ``min_revisit_bytes`` bytes: those with the
smallest id are responses, the others revisit it (rows that repeat the smallest id are all responses; a null id
revisits, unless all ids of the group are null). Line ends and other control characters in a URL become
``%XX``. An empty table gives no record.
"""

from __future__ import annotations

import base64
import hashlib
import io
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from tracelane.llm.common import tidy

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE_BYTES, MAX_RECORD_BYTES = 16 << 20, 512 << 20
CHUNK, HEADER_BYTES = 1 << 16, 1 << 20
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [*headers, ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, first_id: int | None, revisit: bool, date: str) -> bytes:
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:x-page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", date), ("WARC-Target-URI", target), ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"), ("X-Payload-Length", str(len(payload))),
    ]
    http = HTTP + f"Content-Length: {len(payload)}\r\n\r\n".encode()
    if revisit:
        return record([*head, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:x-page:{first_id}>")], http)
    return record(head, http + payload)


def member(data: bytes, level: int = 3) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class WarcWriter(DataSourceArrowWriter):
    """Writes batches of id, url, payload, first_id and revisit as WARC archives."""

    def __init__(self, path: str, archive_bytes: int, date: str) -> None:
        self.path, self.archive_bytes, self.date = path, archive_bytes, date

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _fs(self.path)
        fs.create_dir(posixpath.join(root, "_attempts"), recursive=True)
        paths: list[str] = []
        out, size = None, 0
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None:
                        paths.append(posixpath.join(root, "_attempts", f"{uuid.uuid4().hex}.warc.gz"))
                        out, size = fs.open_output_stream(paths[-1], compression=None), 0
                        size += out.write(member(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", self.date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")))
                    size += out.write(member(page_record(row["id"], row["url"], row["payload"], row["first_id"], row["revisit"], self.date)))
                    if size >= self.archive_bytes:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return Written(paths)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _fs(self.path)
        for m in messages:
            for p in m.paths if m else []:
                fs.move(p, posixpath.join(root, posixpath.basename(p)))
        if fs.get_file_info(posixpath.join(root, "_attempts")).is_file is False:
            fs.delete_dir(posixpath.join(root, "_attempts"))

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = _fs(self.path)
        for m in messages:
            for p in m.paths if m else []:
                fs.delete_file(p)
        if fs.get_file_info(posixpath.join(root, "_attempts")).is_file is False:
            fs.delete_dir(posixpath.join(root, "_attempts"))


class WarcSource(DataSource):
    """``df.write.format("warc")``: options path, archive_bytes and date."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options.get("archive_bytes", ARCHIVE_BYTES)), self.options.get("date", DATE))


def revisits(df: DataFrame, key: str, payload: str, min_revisit_bytes: int = 0) -> DataFrame:
    """id, url, payload, first_id and revisit of each row. Only ids and digests are grouped by digest, where one may have
    very many rows; payloads meet their verdict by id and digest."""
    body = F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary")
    rows = df.select(F.col(key).cast("long").alias("id"), F.col("url").cast("string").alias("url"), body.alias("payload"), F.sha1(body).alias("digest"))
    pairs = df.select(F.col(key).cast("long").alias("id"), F.sha1(body).alias("digest"), F.octet_length(body).alias("size")).distinct()
    firsts = pairs.groupBy("digest").agg(F.min("id").alias("first_id"))
    other = F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id")) & (F.col("size") >= min_revisit_bytes)
    verdicts = pairs.join(firsts, "digest").select(F.col("id").alias("id_"), F.col("digest").alias("digest_"), "first_id", other.alias("revisit"))
    return rows.join(verdicts, F.col("id").eqNullSafe(F.col("id_")) & (F.col("digest") == F.col("digest_"))).select("id", "url", "payload", "first_id", "revisit")


def write_warc(df: DataFrame, path: str, key: str = "page_id", payload: str = "html", min_revisit_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, date: str = DATE) -> None:
    spark = df.sparkSession
    spark.dataSource.register(WarcSource)
    _, root = _fs(path)
    _fs(path)[0].create_dir(root, recursive=True)
    revisits(df, key, payload, min_revisit_bytes).write.format("warc").option("path", path).option("archive_bytes", archive_bytes).option("date", date).mode("append").save()


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], int, int]:
    """Headers, block start and record end of the record at a place; ValueError with the reason if it is unsound."""
    if not _VERSION.match(data, at):
        raise ValueError("no version line")
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        raise ValueError("headers don't end")
    headers = {}
    for line in data[data.find(b"\r\n", at) + 2 : stop].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("malformed header")
        headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    length = headers.get("content-length", "")
    if not re.fullmatch(r"\d{1,18}", length):
        raise ValueError("no content length")
    end = stop + 4 + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("block cut short")
    digest = headers.get("warc-block-digest", "")
    if digest.startswith("sha1:") and digest[5:] != base32_sha1(data[stop + 4 : end]):
        raise ValueError("block digest differs")
    return headers, stop + 4, end + 4


class Archive:
    """An archive to be read at any place, whose size is known."""

    def __init__(self, data: bytes | BinaryIO, size: int | None = None, max_record_bytes: int = MAX_RECORD_BYTES) -> None:
        self.file = io.BytesIO(data) if isinstance(data, bytes) else data
        self.size = len(data) if isinstance(data, bytes) else size
        self.most = max_record_bytes

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def inflate(self, at: int) -> tuple[bytes, int]:
        """The gzip member at a place and where it ends; ValueError if it is cut short, too large or fails its checks."""
        d, parts, held = zlib.decompressobj(31), [], 0
        self.file.seek(at)
        try:
            while not d.eof and (chunk := self.file.read(CHUNK)):
                at += len(chunk)
                while chunk and not d.eof:
                    parts.append(d.decompress(chunk, 1 << 22))
                    held += len(parts[-1])
                    if held > self.most:
                        raise ValueError("gzip: too large")
                    chunk = d.unconsumed_tail
        except zlib.error as e:
            raise ValueError(f"gzip: {e}") from None
        if not d.eof:
            raise ValueError("gzip: cut short")
        return b"".join(parts), at - len(d.unused_data)

    def plain(self, at: int) -> bytes:
        """The bytes of the record at a place, by its own length."""
        head = self.read(at, HEADER_BYTES)
        if not _VERSION.match(head):
            raise ValueError("no version line")
        stop, size = head.find(b"\r\n\r\n"), HEADER_BYTES
        while stop < 0 and len(head) == size and size < self.most:  # long headers: read on, each time twice as much
            size = min(2 * size, self.most)
            head = self.read(at, size)
            stop = head.find(b"\r\n\r\n")
        length = re.search(rb"\r\ncontent-length:[ \t]*(\d{1,18})[ \t]*\r\n", head[: stop + 2], re.IGNORECASE)
        if stop < 0:
            raise ValueError("headers don't end")
        if not length:
            raise ValueError("no content length")
        if int(length[1]) > self.most:
            raise ValueError("block too large")
        return self.read(at, stop + 8 + int(length[1]))

    def sound(self, at: int) -> tuple[int, dict[str, str], bytes]:
        """End, headers and block of the record at a place; ValueError with the reason if it is unsound."""
        if self.read(at, 3) == b"\x1f\x8b\x08":
            whole, end = self.inflate(at)
            headers, block, stop = parse_record(whole)
            if stop != len(whole):
                raise ValueError("more than one record in a member")
            return end, headers, whole[block : stop - 4]
        data = self.plain(at)
        headers, block, stop = parse_record(data)
        return at + stop, headers, data[block : stop - 4]

    def next_mark(self, at: int) -> int:
        """The first place from here on where a member or a version line may begin, else the end."""
        while at < self.size:
            data = self.read(at, 1 << 20)
            found = _MARK.search(data)
            if found:
                return at + found.start()
            if at + len(data) >= self.size or not data:
                break
            at += len(data) - 6  # a mark may lie across
        return self.size


_MARK = re.compile(rb"\x1f\x8b\x08|WARC/1\.")


def read_archive(data: bytes | BinaryIO, size: int | None = None, max_record_bytes: int = MAX_RECORD_BYTES) -> Iterator[tuple[int, int, dict[str, str] | None, bytes, str]]:
    """(offset, length, headers, block, "") of each sound record, (offset, length, None, b"", reason) of each gap."""
    archive = Archive(data, size, max_record_bytes)
    at, gap, reason = 0, None, ""
    while at < archive.size:
        try:
            end, headers, block = archive.sound(at)
        except ValueError as e:
            if gap is None:
                gap, reason = at, str(e)
            at = archive.next_mark(at + 1)
            continue
        if gap is not None:
            yield gap, at - gap, None, b"", reason
            gap = None
        yield at, end - at, headers, block, ""
        at = end
    if gap is not None:
        yield gap, archive.size - gap, None, b"", reason


READ = "archive string, offset long, length long, kind string, reason string, record_id string, record_type string, target_uri string, payload_digest string, payload_length long, refers_to string, payload binary"


def read_warc(spark: SparkSession, path: str, payloads: bool = True, max_record_bytes: int = MAX_RECORD_BYTES) -> DataFrame:
    """A row for each record and each quarantined gap (kind record or gap) of all archives below a path.

    payload_digest and payload_length are computed from a response's own bytes; a revisit's are its headers'.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in READ.split(", ")]
        for batch in batches:
            for name, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
                rows, held = [], 0
                fs, place = _fs(name)
                with fs.open_input_file(place) as file:
                    for at, size, headers, block, reason in read_archive(file, length, max_record_bytes):
                        if headers is None:
                            rows.append((name, at, size, "gap", reason, *[None] * 7))
                            continue
                        kind = headers.get("warc-type", "")
                        payload = block.partition(b"\r\n\r\n")[2] if headers.get("content-type", "").startswith("application/http") else block
                        digest, n = base32_sha1(payload), len(payload)
                        if kind == "revisit":
                            digest, n = headers.get("warc-payload-digest", "")[5:], int(headers.get("x-payload-length") or 0)
                        rows.append((name, at, size, "record", "", headers.get("warc-record-id"), kind, headers.get("warc-target-uri"), digest, n, headers.get("warc-refers-to"), payload if payloads and kind != "revisit" else None))
                        held += len(payload)
                        if held > 1 << 22:
                            yield _batch(rows, names)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows, names)

    # path and length alone: Spark lists the files but doesn't read them; each is a task of its own at most
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length").mapInArrow(tidy(read), READ)


_KINDS = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [_KINDS[f.split()[1]] for f in READ.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def page_number(urn: str | Column) -> Column:
    """The page id in a record's urn."""
    return F.try_to_number(F.nullif(F.regexp_extract(urn, r"urn:x-page:(-?\d*)", 1), F.lit("")), F.lit("S9999999999999999999")).cast("long")
