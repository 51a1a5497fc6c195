"""WARC archives of pages with a two-level capture index.

Tasks write one gzip member per record into archive files in the shared folder. The capture index has a
line per record, ordered by URL key with the host reversed and page_id, in compressed blocks. Next to each
index file lies its sparse directory: the first line's key and the place of each block; a table names the files with
their first and last keys. A lookup bisects the files, then the directory, reads one block by range, bisects its lines
and reads only the records that it wants. Reading an archive back is a lookup of every capture in key order, so a
task decompresses each block once. File names carry the task attempt and are passed on in written tables, so a repeated
task never mixes with an earlier one.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .skew import lookup
from .store import new_dir, numbered, sized, written

BLOCK_LINES = 256
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURES = "order string, file string, offset long, length long"
FILES = "first string, last string, file string, blocks int"
RECORDS = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def url_key(url: str | None) -> str:
    """com,example,www)/path?query for http://www.example.com/path?query; host lower-cased, port kept, fragment dropped."""
    try:
        u = urlsplit((url or "").strip())
        host = quote(u.netloc.rpartition("@")[2].lower(), safe="[]:!$&'()*+,;=~")
    except ValueError:
        return ")" + quote(url or "", safe="/?=&%:")
    name, colon, port = host.partition(":")
    return ",".join(reversed(name.split("."))) + colon + port + ")" + quote((u.path or "/") + ("?" + u.query if u.query else ""), safe="/?=&%:,;@!$'()*+~")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None) -> bytes:
    """The bytes of a response record, or of a revisit record if refers_to is set."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="%/:?#[]@!$&'()*+,;=~ "))
    head += ["WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{sha1}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode() + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[int | None, str | None, bytes | None, int, str, str, int | None]:
    """A row of RECORDS from the bytes of one record; the digest of a response is computed from its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    names = {k.lower(): v for k, _, v in (x.partition(": ") for x in head.decode().split("\r\n")[1:])}
    body = rest[: int(names["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    number = lambda x: int(x[10:-1]) if x and x[10:-1] else None
    kind, stated = names["warc-type"], names["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or digest(payload) != stated):
        raise ValueError(f"a damaged record: {names.get('warc-record-id')}")
    return number(names["warc-record-id"]), names.get("warc-target-uri"), payload if kind == "response" else None, size, stated, kind, number(names.get("warc-refers-to"))


def _name(kind: str) -> str:
    c = TaskContext.get()
    return f"{kind}-{c.partitionId():06d}-{c.taskAttemptId()}"


def _write(folder: str):
    schema = pa.schema([("order", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, file = None, 0, _name("pages") + ".warc.gz"
        for batch in batches:
            if out is None:
                fs, path = pa.fs.FileSystem.from_uri(folder)
                out = fs.open_output_stream(f"{path}/{file}", compression=None)
            rows = []
            for page_id, url, html, refers_to in zip(*map(iter, batch.columns), strict=True):
                page_id, url, refers_to = page_id.as_py(), url.as_py(), refers_to.as_py()
                payload = (html.as_py() or "").encode()
                member = gzip.compress(record(page_id, url, payload, digest(payload), refers_to), 6, mtime=0)
                out.write(member)
                rows.append({"order": _sort_key(url_key(url), page_id), "file": file, "offset": at, "length": len(member)})
                at += len(member)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)
        if out is not None:
            out.close()

    return run


def _sort_key(key: str, page_id: int | None) -> str:
    """A string that orders lines as (key, page_id) does, null first; no key holds a tab."""
    return f"{key}\t" if page_id is None else f"{key}\t{page_id + (1 << 63):020d}"


def _index(folder: str, block_lines: int):
    """Writes sorted lines (order, file, offset, length) as blocks and their directory; a row for each index file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, file, lines, blocks, last = None, 0, _name("captures"), [], [], ""

        def flush(n: int):
            nonlocal at, lines, last
            part, lines = lines[:n], lines[n:]
            data = zlib.compress("\n".join("\x01".join(map(str, x)) for x in part).encode(), 6)
            out.write(data)
            blocks.append(f"{part[0][0]}\x01{at}\x01{len(data)}")
            at, last = at + len(data), part[-1][0]

        fs, path = pa.fs.FileSystem.from_uri(folder)
        for batch in batches:
            if out is None:
                out = fs.open_output_stream(f"{path}/{file}.idx", compression=None)
            lines += zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)
            while len(lines) >= block_lines:
                flush(block_lines)
        if lines:
            flush(len(lines))
        if out is not None:
            out.close()
        if blocks:
            with fs.open_output_stream(f"{path}/{file}.dir", compression=None) as d:
                d.write(zlib.compress("\n".join(blocks).encode(), 6))
            first = blocks[0].split("\x01")[0]
            yield pa.RecordBatch.from_pylist([{"first": first, "last": last, "file": file, "blocks": len(blocks)}], pa.schema([("first", pa.string()), ("last", pa.string()), ("file", pa.string()), ("blocks", pa.int32())]))

    return run


class _Reader:
    """Looks captures up in an archive; keeps one directory and one block, which suits sorted requests."""

    def __init__(self, folder: str, files: list[tuple[str, str, str]]):
        self.fs, self.path = pa.fs.FileSystem.from_uri(folder)
        self.files, self.lasts = files, [last for _, last, _ in files]
        self.handles: dict[str, pa.NativeFile] = {}
        self.held: dict[str, tuple] = {}

    def read(self, file: str, at: int, n: int) -> bytes:
        if file not in self.handles:
            if len(self.handles) >= 32:
                self.handles.pop(next(iter(self.handles))).close()
            self.handles[file] = self.fs.open_input_file(f"{self.path}/{file}")
        return self.handles[file].read_at(n, at)

    def directory(self, file: str) -> tuple[list[str], list[tuple[int, int]]]:
        """First orders and places of a file's blocks."""
        if self.held.get("dir", ("",))[0] != file:
            with self.fs.open_input_stream(f"{self.path}/{file}.dir", compression=None) as d:
                rows = [x.split("\x01") for x in zlib.decompress(d.read()).decode().split("\n")]
            self.held["dir"] = (file, [x[0] for x in rows], [(int(x[1]), int(x[2])) for x in rows])
        return self.held["dir"][1:]

    def block(self, file: str, at: int, n: int) -> tuple[list[str], list[list[str]]]:
        """Orders and lines of a block."""
        if self.held.get("block", ("", 0))[:2] != (file, at):
            lines = [x.split("\x01") for x in zlib.decompress(self.read(f"{file}.idx", at, n)).decode().split("\n")]
            self.held["block"] = (file, at, [x[0] for x in lines], lines)
        return self.held["block"][2:]

    def find(self, low: str, high: str) -> Iterator[tuple[str, int, int]]:
        """(file, offset, length) of the records with low <= order < high, by binary search on all three levels."""
        for f in range(bisect.bisect_left(self.lasts, low), len(self.files)):
            first, _, file = self.files[f]
            if first >= high:
                return
            firsts, places = self.directory(file)
            for b in range(max(0, bisect.bisect_left(firsts, low) - 1), bisect.bisect_left(firsts, high)):
                orders, lines = self.block(file, *places[b])
                for x in lines[bisect.bisect_left(orders, low) : bisect.bisect_left(orders, high)]:
                    yield x[1], int(x[2]), int(x[3])


def _fetch(folder: str, files, with_payload: bool):
    """Of (low, high), sorted: the records in each range of orders."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(folder, files.value)
        rows, held = [], 0
        for batch in batches:
            for low, high in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for file, at, n in reader.find(low, high):
                    got = parse(gzip.decompress(reader.read(file, at, n)))
                    rows.append(dict(zip(schema.names, got if with_payload else (*got[:2], None, *got[3:]), strict=True)))
                    held += n if with_payload else 64
                    if held > 1 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return run


class Archive:
    """An archive in `folder`. files: a table of the index files, one row each; captures: (order, file, offset, length) of all records."""

    def __init__(self, spark: SparkSession, folder: str, files: DataFrame, captures: DataFrame):
        self.spark, self.folder, self.files, self.captures = spark, folder, files, captures

    def _find(self, ranges: DataFrame, with_payload: bool) -> DataFrame:
        # one short row per index file, as many as the tasks that wrote the index
        files = self.spark.sparkContext.broadcast(sorted((r["first"], r["last"], r["file"]) for r in self.files.collect()))
        return ranges.mapInArrow(_fetch(self.folder, files, with_payload), RECORDS)

    def read(self, with_payload: bool = False) -> DataFrame:
        """All records, each looked up by its key and page_id; payload is null for revisits, and for all rows without with_payload."""
        low = self.captures.select("order").distinct().repartitionByRange("order").sortWithinPartitions("order")
        return self._find(low.select("order", F.concat("order", F.lit("\x02")).alias("high")), with_payload)

    def lookup(self, urls: list[str]) -> DataFrame:
        """The records of a stated list of URLs, with payloads."""
        keys = sorted({url_key(u) for u in urls})
        return self._find(self.spark.createDataFrame([(f"{k}\t", f"{k}\n") for k in keys], "low string, high string"), True)


def write_archive(pages: DataFrame, min_bytes: int = 0, block_lines: int = BLOCK_LINES) -> Archive:
    """Writes a record per row of pages (page_id, url, html; other columns are ignored) and the capture index.

    Null html is the empty payload. Of records with equal payloads of at least min_bytes bytes the one
    with the largest page_id is the response and the others revisit it; rows that repeat this page_id are responses
    too, and a row without page_id revisits a payload that some page_id has. A null url has the key ")/". An empty
    table gives an archive without records.
    """
    spark = pages.sparkSession
    folder = new_dir(spark, "archive")
    fs, path = pa.fs.FileSystem.from_uri(folder)
    fs.create_dir(path)
    x = numbered(pages, "row", ["page_id", "url", "html"]).withColumn("html", F.coalesce("html", F.lit("")))
    sums = written(x.select("row", "page_id", F.octet_length("html").alias("size"), F.sha1(F.col("html").cast("binary")).alias("sha1")), "digests")
    best = sums.groupBy("sha1").agg(F.count("*").alias("c"), F.max("page_id").alias("best")).where("c > 1")
    refers = lookup(sums, best, ["sha1"], sums.count(), F.col("row"))
    other = (F.col("size") >= min_bytes) & F.col("best").isNotNull() & ~F.col("best").eqNullSafe(F.col("page_id"))
    refers = written(refers.where(other).select("row", F.col("best").alias("refers_to")), "refers")
    x = x.join(sized(refers), "row", "left").select("page_id", "url", "html", "refers_to")
    captures = written(x.mapInArrow(_write(folder), CAPTURES), "captures")
    ordered = captures.repartitionByRange("order").sortWithinPartitions("order")
    return Archive(spark, folder, written(ordered.mapInArrow(_index(folder, block_lines), FILES), "files"), captures)
