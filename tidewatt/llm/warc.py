"""WARC archives with a two-level capture index.

An archive is a folder of ``.warc.gz`` files in which each record is a gzip
member, so any WARC reader opens them.  The index has one line per capture,
sorted by reversed-host URL key and id, and packed into compressed blocks, one
after the other in a few index files.  Each index file has a sparse directory:
the first line's key and id of each block, and where the block is.  A look-up
finds its index file among the first keys of all, binary-searches the file's
directory, reads the byte range of one block, binary-searches its lines, and
then reads byte ranges of the archive.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_arrow, open_folder, stage, staging_folder

#: A task starts another archive file after so many bytes.
FILE_BYTES = 1 << 30
#: Captures of an index block, and of an index file; the driver holds one key for each file.
BLOCK_CAPTURES, INDEX_CAPTURES = 256, 1 << 20
#: Ranges of one file that lie no further apart are read at once, up to so many bytes; a task reads about ``CHUNK`` bytes of a file.
APART, AT_ONCE, CHUNK = 1 << 16, 1 << 22, 1 << 26
DATE = "2024-01-01T00:00:00Z"


def url_key(url: str | None) -> str:
    """``http://www.example.com:80/a?b`` as ``com,example,www)/a?b``; scheme and port do not count."""
    if not url:
        return ")"
    try:
        parts = urlsplit(url if "//" in url else f"//{url}")
        host = (parts.hostname or "").lower()
    except ValueError:
        return f"){url}"
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def packed(content: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(content) + packer.flush()


def information() -> bytes:
    """The record that opens a file."""
    content = b"software: tidewatt\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {DATE}", "Content-Type: application/warc-fields", f"Content-Length: {len(content)}", "", ""]
    return packed("\r\n".join(head).encode() + content + b"\r\n\r\n")


def record(kind: str, page_id: str | None, url: str | None, digest: str, size: int, body: bytes, refers_to: str | None = None) -> bytes:
    """One WARC record as a gzip member."""
    name = lambda i: hashlib.md5(f"{i}:{digest}".encode()).hexdigest()
    form = lambda h: f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {form(name(page_id))}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}", "Content-Type: application/http;msgtype=response"]
    head += ([] if page_id is None else [f"X-Page-ID: {quote(page_id)}"]) + ([] if url is None else [f"WARC-Target-URI: {_clean(url)}"])
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {form(name(refers_to))}", f"X-Refers-To-Page-ID: {quote(refers_to)}"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    content = http + body
    return packed("\r\n".join([*head, f"Content-Length: {len(content)}", "", ""]).encode() + content + b"\r\n\r\n")


@dataclass
class Capture:
    headers: dict[str, str]
    payload: bytes


def parse(member: bytes) -> Capture:
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    content = rest[: int(headers["Content-Length"])]
    return Capture(headers, content.partition(b"\r\n\r\n")[2])


CAPTURES = "key string, id string, file string, start long, size long"
CAPTURE = pa.schema([("key", pa.string()), ("id", pa.string()), ("file", pa.string()), ("start", pa.int64()), ("size", pa.int64())])


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


class Appender:
    """A new file of a shared folder, written from start to end by one attempt of a task."""

    def __init__(self, folder: str, stem: str, ending: str):
        system, path = open_folder(folder)
        self.name, self.at = f"{stem}-{TaskContext.get().taskAttemptId()}{ending}", 0
        self.stream = system.open_output_stream(f"{path}/{self.name}", compression=None)

    def add(self, data: bytes) -> int:
        """Append, and say where it starts."""
        start, self.at = self.at, self.at + len(data)
        self.stream.write(data)
        return start


def write_archive(df: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write a record per row to WARC files in ``folder``; returns the captures: ``key, id, file, start, size``.

    Of equal payloads of at least ``revisit_bytes`` bytes the record with the
    largest id is a response and the others revisit it.  Rows that repeat the
    largest id are responses too; so are records whose payload comes with null
    ids only.  A null id beside others revisits.  Null html is empty, a null
    url has the empty key.  Ids may be of any type that has an order and a
    text; captures hold them as text.  An empty table writes no file.

    The join on the digest moves payloads that are already compressed, and
    Spark splits it where many payloads are equal.  A file that a lost task
    has left behind has no captures.
    """
    spark = df.sparkSession
    folder = folder or staging_folder(spark, "warc")
    name = F.col(f"`{id_col}`")
    pages = df.select(name.alias("page_id"), name.cast("string").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"))

    def respond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sha, sizes, members = [], [], []
            for page_id, url, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = text.encode()
                sha.append(hashlib.sha1(payload).digest())
                sizes.append(len(payload))
                members.append(record("response", page_id, url, base64.b32encode(sha[-1]).decode(), len(payload), payload))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sha, pa.binary()), pa.array(sizes, pa.int64()), pa.array(members, pa.binary())], ["id", "url", "sha", "size", "member"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, part = None, TaskContext.get().partitionId()
        for batch in batches:
            captures = []
            for page_id, url, sha, size, member, owner in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "sha", "size", "member", "owner")), strict=True):
                if owner is not None and owner != page_id and size >= revisit_bytes:
                    member = record("revisit", page_id, url, base64.b32encode(sha).decode(), size, b"", owner)
                if out is None or out.at >= FILE_BYTES:
                    if out:
                        out.stream.close()
                    out = Appender(folder, f"{part:06d}-{uuid.uuid4().hex[:8]}", ".warc.gz")
                    out.add(information())
                captures.append((url_key(url), page_id, f"{folder}/{out.name}", out.add(member), len(member)))
            yield _rows(captures, CAPTURE)
        if out:
            out.stream.close()

    owners = pages.groupBy(F.unhex(F.sha1("html")).alias("sha")).agg(F.max("page_id").cast("string").alias("owner"))
    responses = map_arrow(pages.select("id", "url", "html"), respond, "id string, url string, sha binary, size long, member binary")
    typed = responses.join(owners.hint("merge"), "sha", "left")
    return stage(map_arrow(typed, gather, CAPTURES), "captures")


@dataclass(frozen=True)
class IndexFile:
    """One index file: the first key and id in it, its path, and where its directory starts."""

    first: tuple[str, str]
    path: str
    directory: int
    end: int


def _place(key: str, name: str | None) -> tuple[str, str]:
    """The order of the index: key, then id as text, a missing id first."""
    return key, "" if name is None else "=" + name


def build_index(captures: DataFrame, folder: str | None = None) -> list[IndexFile]:
    """Sort captures into index files of compressed blocks, each with its directory at its end.

    Returns one small entry for each file, in order; captures with equal keys
    may lie in several.  Null ids come before others of their key; an empty
    table has no file.
    """
    spark = captures.sparkSession
    folder = folder or staging_folder(spark, "warc-index")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, directory = None, [], []

        def flush(rows: list) -> None:
            data = packed("\n".join(map(json.dumps, rows)).encode())
            directory.append((*_place(rows[0][0], rows[0][1]), out.add(data), len(data)))

        for batch in batches:
            out = out or Appender(folder, f"{TaskContext.get().partitionId():06d}", ".cdx.gz")
            held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            while len(held) >= BLOCK_CAPTURES:
                flush(held[:BLOCK_CAPTURES])
                held = held[BLOCK_CAPTURES:]
        if held:
            flush(held)
        if directory:
            start = out.add(packed("\n".join(map(json.dumps, directory)).encode()))
            out.stream.close()
            yield pa.RecordBatch.from_arrays([pa.array([directory[0][0]]), pa.array([directory[0][1]]), pa.array([f"{folder}/{out.name}"]), pa.array([start], pa.int64()), pa.array([out.at], pa.int64())], ["key", "id", "path", "directory", "end"])

    count = captures.count()
    files = max(1, -(-count // INDEX_CAPTURES), min(int(spark.conf.get("spark.sql.shuffle.partitions")), count // 10_000))
    ordered = captures.repartitionByRange(files, "key", F.coalesce("id", F.lit("")), "file", "start").sortWithinPartitions("key", F.col("id").asc_nulls_first(), "file", "start")
    written = stage(map_arrow(ordered, blocks, "key string, id string, path string, directory long, end long"), "index-files")
    return sorted((IndexFile((r.key, r.id), r.path, r.directory, r.end) for r in written.collect()), key=lambda f: (f.first, f.path))


class IndexReader:
    """Bisection in one index file; it keeps the directory and the block that it read last."""

    def __init__(self, file: IndexFile):
        system, path = open_folder(file.path)
        self.stream = system.open_input_file(path)
        data = self.stream.read_at(file.end - file.directory, file.directory)
        self.directory = [tuple(json.loads(line)) for line in zlib.decompress(data, 31).split(b"\n")]
        self.firsts = [(key, name) for key, name, _, _ in self.directory]
        self.number, self.lines, self.places = -1, [], []

    def block(self, number: int) -> None:
        if number != self.number:
            _, _, start, size = self.directory[number]
            self.lines = [tuple(json.loads(line)) for line in zlib.decompress(self.stream.read_at(size, start), 31).split(b"\n")]
            self.number, self.places = number, [_place(line[0], line[1]) for line in self.lines]

    def find(self, low: tuple[str, str], high: tuple[str, str]) -> Iterator[tuple]:
        """The captures from ``low`` to ``high``, both included."""
        number = max(0, bisect_left(self.firsts, low) - 1)
        while number < len(self.directory) and self.firsts[number] <= high:
            self.block(number)
            yield from self.lines[bisect_left(self.places, low) : bisect_right(self.places, high)]
            number += 1


def look_up(index: list[IndexFile], wanted: DataFrame, *, url_col: str = "url", id_col: str | None = None) -> DataFrame:
    """The captures of the URLs in ``wanted``, with ``id_col`` only those of the row's id too.

    Asked for once or often, a capture comes once for each time that it was
    written.  Null urls have the empty key; a null id is an id.  No rows, or an
    empty index, find nothing.  Rows go to the index files that can hold them
    and are looked for in order, so a task reads each block once.
    """
    spark = wanted.sparkSession
    files = spark.sparkContext.broadcast(index)
    exact = id_col is not None

    def routes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = [f.first for f in files.value]
        for batch in batches:
            rows = []
            for url, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                low, high = _bounds(key := url_key(url), name, exact)
                rows += [(i, key, name) for i in range(max(0, bisect_left(firsts, low) - 1), bisect_right(firsts, high))]
            yield _rows(rows, pa.schema([("number", pa.int32()), ("key", pa.string()), ("id", pa.string())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, at = None, None
        for batch in batches:
            found = []
            for number, key, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if number != at:
                    reader, at = IndexReader(files.value[number]), number
                for capture in reader.find(*_bounds(key, name, exact)):
                    found.append(capture)
                    if len(found) >= 10_000:
                        yield _rows(found, CAPTURE)
                        found = []
            yield _rows(found, CAPTURE)

    asked = wanted.select(F.col(f"`{url_col}`").cast("string").alias("url"), (F.col(f"`{id_col}`").cast("string") if exact else F.lit(None).cast("string")).alias("id"))
    routed = map_arrow(asked, routes, "number int, key string, id string").distinct()
    parts = max(1, min(len(index), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    ordered = routed.repartition(parts, "number").sortWithinPartitions("number", "key", F.col("id").asc_nulls_first())
    return map_arrow(ordered, search, CAPTURES)


def _bounds(key: str, name: str | None, exact: bool) -> tuple[tuple[str, str], tuple[str, str]]:
    return (_place(key, name),) * 2 if exact else ((key, ""), (key, "\U0010ffff"))


def read_captures(found: DataFrame, *, with_payload: bool = False) -> DataFrame:
    """Range-read captures and parse them; a response's digest is computed from its payload anew.

    Ids are text.  Each capture gives a row, as often as it comes; no captures
    give none.  Captures that lie close together are read at once.
    """
    schema = pa.schema([("page_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("url", pa.string()), ("payload", pa.binary())])

    def parsed(data: memoryview) -> tuple:
        got = parse(data)
        h, kind = got.headers, got.headers["WARC-Type"]
        whole = kind == "response"
        digest = digest_of(got.payload) if whole else h["WARC-Payload-Digest"].removeprefix("sha1:")
        name = lambda field: unquote(h[field]) if field in h else None
        return name("X-Page-ID"), len(got.payload) if whole else int(h["X-Payload-Length"]), digest, kind, name("X-Refers-To-Page-ID"), h.get("WARC-Target-URI"), got.payload if whole and with_payload else None

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, stream = None, None
        for batch in batches:
            file, start, size = (batch.column(c).to_pylist() for c in ("file", "start", "size"))
            i = 0
            while i < len(file):
                if file[i] != path:
                    path = file[i]
                    system, inside = open_folder(path)
                    stream = system.open_input_file(inside)
                j, end = i + 1, start[i] + size[i]
                while j < len(file) and file[j] == path and start[j] - end <= APART and start[j] + size[j] - start[i] <= AT_ONCE:
                    end = max(end, start[j] + size[j])
                    j += 1
                data = memoryview(stream.read_at(end - start[i], start[i]))
                yield _rows([parsed(data[start[k] - start[i] : start[k] - start[i] + size[k]]) for k in range(i, j)], schema)
                i = j

    chunks = found.withColumn("chunk", F.floor(F.col("start") / CHUNK))
    seen = found.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    parts = max(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(seen / CHUNK))
    ordered = chunks.repartition(parts, "file", "chunk").sortWithinPartitions("file", "start").select("file", "start", "size")
    return map_arrow(ordered, task, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string, payload binary")


def archive_and_read(df: DataFrame, *, id_col: str = "page_id", url_col: str = "url", **columns) -> DataFrame:
    """Write an archive, index it, look every page up in the index and read what is found.

    One row per row of ``df``, with the types of its ids; see ``write_archive``
    and ``look_up`` for nulls, repeated rows and empty tables.
    """
    index = build_index(write_archive(df, id_col=id_col, url_col=url_col, **columns))
    found = stage(look_up(index, df, url_col=url_col, id_col=id_col), "found-captures")
    kind = df.schema[id_col].dataType
    return read_captures(found).drop("payload").withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})
