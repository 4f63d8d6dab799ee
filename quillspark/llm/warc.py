"""Operator 7, WARC: archives of one gzip member per record, written and read back in sequence.

The reader decompresses a member at a time with zlib, frames the record by its Content-Length and checks
its digests. Pages with equal payloads share one response; the others are revisits of it.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import uuid
import zlib
from datetime import UTC, datetime
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import matched, scratch, written

#: Fixed values of the WARC format (ISO 28500).
VERSION = b"WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = datetime(1970, 1, 1, tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
CHUNK = 1 << 20


def digest(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id, payload_digest: str) -> str:
    """The id of a page's record; pages of one page_id with different payloads have different ones."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{payload_digest}')}>"


def one_line(value) -> str:
    """value without line ends, which would end a header."""
    return "".join(" " if c in "\r\n" else c for c in str(value))


def record(kind: str, headers: list[tuple[str, object]], block: bytes) -> bytes:
    """One WARC record as one gzip member."""
    lines = [("WARC-Type", kind), *headers, ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Length", len(block))]
    head = VERSION + b"\r\n" + b"".join(f"{k}: {one_line(v)}\r\n".encode() for k, v in lines) + b"\r\n"
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress(head + block + b"\r\n\r\n") + pack.flush()


def page_record(page_id, url, payload: bytes, refers_to, refers_url=None) -> bytes:
    """A page as a response, or as a revisit of the page refers_to, which stands without its payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    full = digest(payload)
    headers = [
        ("WARC-Record-ID", record_id(page_id, full)), ("WARC-Date", EPOCH), ("WARC-Target-URI", url or ""),
        ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{full}"), ("X-Page-ID", page_id),
    ]
    if refers_to is None:
        return record("response", headers, http + payload)
    more = [("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id(refers_to, full)), ("X-Refers-To-Page-ID", refers_to)]
    return record("revisit", headers + more, http)


class Member:
    """One gzip member of a stream, decompressed by pieces of CHUNK bytes at most; rest is what was read beyond it."""

    def __init__(self, stream, rest: bytes):
        self.stream, self.unpack, self.rest, self.buffer = stream, zlib.decompressobj(31), rest, b""

    def more(self) -> bytes:
        """The next bytes of the member; none at its end."""
        while not self.unpack.eof:
            if not self.rest:
                self.rest = self.stream.read(CHUNK)
                if not self.rest:
                    raise ValueError("the archive ends inside a gzip member")
            out = self.unpack.decompress(self.rest, CHUNK)
            self.rest = self.unpack.unused_data if self.unpack.eof else self.unpack.unconsumed_tail
            if out:
                return out
        return b""

    def until(self, mark: bytes) -> bytes:
        """What stands before a mark, which is passed over."""
        while (at := self.buffer.find(mark)) < 0:
            got = self.more()
            if not got or len(self.buffer) > CHUNK:
                raise ValueError("a member is no WARC record")
            self.buffer += got
        out, self.buffer = self.buffer[:at], self.buffer[at + len(mark) :]
        return out

    def pieces(self, n: int):
        """The next n bytes."""
        while n:
            if not self.buffer:
                self.buffer = self.more()
                if not self.buffer:
                    raise ValueError("a record's length isn't its Content-Length")
            out, self.buffer = self.buffer[:n], self.buffer[n:]
            n -= len(out)
            yield out

    def end(self) -> bytes:
        """All that is left."""
        out = self.buffer
        while got := self.more():
            out += got
        self.buffer = b""
        return out


def read_records(stream):
    """Of each record of an archive: its headers by lower-case name, and its block, after verification.

    A member is decompressed piece by piece: its header first, then as many bytes as the header says, whose digest grows
    with them.
    """
    rest = stream.read(CHUNK)
    while rest:
        member = Member(stream, rest)
        lines = member.until(b"\r\n\r\n").split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError("a member is no WARC record")
        headers = {k.strip().lower().decode(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines[1:])}
        sha, parts = hashlib.sha1(), []
        for piece in member.pieces(int(headers["content-length"])):
            sha.update(piece)
            parts.append(piece)
        if member.end() != b"\r\n\r\n":
            raise ValueError("a record's length isn't its Content-Length")
        if headers["warc-block-digest"] != f"sha1:{base64.b32encode(sha.digest()).decode()}":
            raise ValueError("a record's block doesn't match its digest")
        yield headers, b"".join(parts)
        rest = member.rest or stream.read(CHUNK)


def parsed(headers: dict[str, str], block: bytes) -> tuple:
    """(page_id, url, payload or None, payload_bytes, payload_digest, record_type, refers_to) of a page's record."""
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, full = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
    n = next(int(x.split(b":")[1]) for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:"))
    if kind == "response" and (len(payload) != n or digest(payload) != full):
        raise ValueError("a response's payload doesn't match its digest")
    refers = headers.get("x-refers-to-page-id")
    page = headers["x-page-id"]
    return (None if page == "None" else int(page), headers["warc-target-uri"], payload if kind == "response" else None, n, full, kind, int(refers) if refers is not None else None)


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or plain path, and the path in it."""
    return pafs.FileSystem.from_uri(path) if urlsplit(path).scheme else (pafs.LocalFileSystem(), path)


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Writes a WARC record for each page (page_id, url, html); returns the archives (path, records).

    Of payloads of at least `least` bytes that are equal, the one with the smallest page_id becomes the
    response and the others its revisits; where that page_id repeats with the payload, each of its rows is a
    response, as a revisit can't refer to its own page_id. A null html is an empty payload, a null url an empty one; a null
    page_id is written as none and counts as the largest. Each task writes one archive under a name of
    its own attempt, so that a task run twice spoils nothing; only archives that the returned table
    names count. Tables without rows give no archives.
    """
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    html = F.col("html")
    key = F.coalesce("page_id", F.lit(2**63 - 1))
    # narrow rows decide the revisits; payloads aren't dealt by digest, so a common one makes no large task
    pages = pages.withColumn("d", F.unhex(F.sha1(F.encode(html, "UTF-8"))))
    by = pages.where(F.octet_length(html) >= least).select("page_id", "d")
    firsts = by.groupBy("d").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    again = by.join(firsts, "d").where(key > F.col("first")).select("page_id", "d", F.col("first").alias("refers_to")).distinct()
    rows = matched(pages, again, ["page_id", "d"], "left")
    fs, root = opened(folder)
    fs.create_dir(root, recursive=True)

    def run(batches):
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        out, n = None, 0
        fs, root = opened(folder)
        path = posixpath.join(root, name)
        for b in batches:
            if out is None and b.num_rows:
                out = fs.open_output_stream(path, compression=None)
            for page, url, html, refers in zip(*[b.column(c) for c in ("page_id", "url", "html", "refers_to")], strict=True):
                out.write(page_record(page.as_py(), url.as_py(), html.as_py().encode(), refers.as_py()))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [posixpath.join(folder, name)], "records": pa.array([n], pa.int64())})

    return written(rows.select("page_id", "url", "html", "refers_to").mapInArrow(run, "path string, records bigint"), "warc-archives")


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The pages of archives (path, records), in the shape of parsed(); without the payloads if not asked for.

    An archive is read by one task from start to end. A damaged record, a wrong digest or a missing record
    is an error.
    """
    schema = "page_id bigint, url string, " + "payload binary, " * payloads + "payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    keep = [0, 1, *([2] if payloads else []), 3, 4, 5, 6]
    types = [pa.int64(), pa.string(), *([pa.binary()] if payloads else []), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = [x.split()[0] for x in schema.split(", ")]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in zip(keep, types, strict=True)], names=names)

    def run(batches):
        for b in batches:
            for path, records in zip(b.column("path"), b.column("records"), strict=True):
                fs, at = opened(path.as_py())
                rows, n, held = [], 0, 0
                with fs.open_input_stream(at, compression=None) as stream:
                    for headers, block in read_records(stream):
                        rows.append(parsed(headers, block))
                        n, held = n + 1, held + len(block)
                        if len(rows) >= 2000 or held >= CHUNK * 8:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)
                if n != records.as_py():
                    raise ValueError(f"{path}: {n} records, {records} written")

    n = archives.count()
    return archives.repartition(max(1, n), "path").mapInArrow(run, schema)


def op7(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    archives = write_archives(pages, scratch(spark, "warc"))
    return read_archives(archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
