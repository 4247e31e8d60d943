"""Operator 13: WARC archives in which a payload stands once.

A first pass writes every page as a response record to archives of a member of gzip for each record, and notes each record's headers
in a table: file, place, key, digest. Of the headers alone, those of one payload meet by its digest and are joined to the one that
stays a response. A second pass deals the files to tasks again; each reads its files in order and writes new archives
with fresh headers, the payload of a response or the headers of a revisit (profile: identical payload digest).

Archives are real WARC 1.1 files in a folder that all executors reach (the paths that pyarrow's file systems open: local
and mounted folders, s3, gs, hdfs, abfs). A task writes files of its own names and lists them in a table that Spark commits, so what a lost or repeated
task left behind is in no list and is never read. No task holds more than a record at a time; archives end at about ARCHIVE_BYTES.

Defined results: a null payload is empty; equal payloads of fewer than `least_bytes` bytes are all responses; of one payload the row with the largest
key is the response, a null key counts as smallest, and among rows with that key one is (an arbitrary one: they give the same results). A null
URL gives a record without a target; bytes of a URL up to 0x20, 0x7F and % itself are written as %XX. An empty table gives no archive; other columns aren't carried.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.texts import batches_of, slices
from loomgraph.session import discard, fresh_path, staged, table

ARCHIVE_BYTES = 64 << 20
READ_BYTES = 1 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Extension fields: the keys of the row and of the response that a revisit stands for.
KEY, REFERS_KEY = "Row-Key", "Refers-To-Row-Key"

CAPTURED = "file string, place long, size long, key long, bytes long, digest string, record string, url string"
CAPTURED_SCHEMA = pa.schema([(n, {"string": pa.string(), "long": pa.int64()}[k]) for n, k in (x.split() for x in CAPTURED.split(", "))])
LISTED = "file string, bytes long, records long"
LISTED_SCHEMA = pa.schema([("file", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())])


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (pafs.LocalFileSystem(), path) if path.startswith("/") else pafs.FileSystem.from_uri(path)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()  # noqa: S324  the format's own digest


def quoted(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", url)


def unquoted(url: str) -> str:
    return re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), url)


def record(fields: list[tuple[str, str | int | None]], block: bytes) -> bytes:
    """A record as it stands in an archive; fields without a value are left out."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def http(n: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()


def response(name: str, key: int | None, url: str | None, payload: bytes, digest: str, date: str) -> bytes:
    block = http(len(payload)) + payload
    kept = [("WARC-Type", "response"), ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", date), ("WARC-Target-URI", url), ("Content-Type", "application/http;msgtype=response")]
    return record([*kept, ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{digest_of(block)}"), (KEY, key)], block)


def revisit(name: str, key: int | None, url: str | None, n: int, digest: str, date: str, to: tuple[str, str | None, int | None]) -> bytes:
    block = http(n)
    kept = [("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Profile", PROFILE), ("Content-Type", "application/http;msgtype=response")]
    refers = [("WARC-Refers-To", f"<{to[0]}>"), ("WARC-Refers-To-Target-URI", to[1]), ("WARC-Refers-To-Date", date), (REFERS_KEY, to[2])]
    return record([*kept, ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{digest_of(block)}"), (KEY, key), *refers], block)


class Archives:
    """Writes records to archives under a folder, each of about ARCHIVE_BYTES."""

    def __init__(self, folder: str, level: int, most: int):
        self.fs, self.folder = opened(folder)
        self.uri, self.level, self.most, self.out, self.done = folder, level, most, None, []

    def add(self, data: bytes) -> tuple[str, int, int]:
        """(file, place, size) of the record's member."""
        if self.out is None:
            self.name, self.at, self.n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
            self.fs.create_dir(self.folder, recursive=True)
            self.out = self.fs.open_output_stream(f"{self.folder}/{self.name}", compression=None)
        z = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        member = z.compress(data) + z.flush()
        self.out.write(member)
        place = (f"{self.uri}/{self.name}", self.at, len(member))
        self.at, self.n = self.at + len(member), self.n + 1
        if self.at >= self.most:
            self.close()
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append({"file": f"{self.uri}/{self.name}", "bytes": self.at, "records": self.n})
            self.out = None


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """The fields of a record and its block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    n = int(fields["Content-Length"])
    if version != "WARC/1.1" or rest[n:] != b"\r\n\r\n":
        raise ValueError("a record that is damaged")
    return fields, rest[:n]


def members(path: str) -> Iterator[tuple[int, bytes]]:
    """The members of an archive with their places, one after the other."""
    fs, at = opened(path)
    with fs.open_input_stream(at, compression=None) as f:
        place, held = 0, b""
        while held or (held := f.read(READ_BYTES)):
            z, out, size = zlib.decompressobj(31), [], 0
            while not z.eof:
                if not held and not (held := f.read(READ_BYTES)):
                    raise ValueError(f"{path} ends within a record")
                out.append(z.decompress(held))
                size += len(held) - len(z.unused_data)
                held = z.unused_data
            yield place, b"".join(out)
            place += size


def fetch(path: str, place: int, size: int) -> tuple[dict[str, str], bytes]:
    """One record by its place, without reading others."""
    fs, at = opened(path)
    with fs.open_input_file(at) as f:
        f.seek(place)
        return parsed(zlib.decompress(f.read(size), 31))


def capture(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", date: str = DATE, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes each row as a response record; gives the records' headers and places."""

    def run(batches):
        out = Archives(folder, 1, archive_bytes)
        for whole in batches:
            for batch in slices(whole, "payload"):
                rows = []
                for k, u, p in zip(*(batch.column(c).to_pylist() for c in ("key", "url", "payload")), strict=True):
                    p = (p or "").encode()
                    u = None if u is None else quoted(u)
                    name, digest = uuid.uuid4().urn, digest_of(p)
                    rows.append([*out.add(response(name, k, u, p, digest, date)), k, len(p), digest, name, u])
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), CAPTURED_SCHEMA, strict=True)], schema=CAPTURED_SCHEMA)
        out.close()

    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), F.col(payload).cast("string").alias("payload"))
    with batches_of(pages.sparkSession, 256):
        return staged(rows.mapInArrow(run, CAPTURED), "captured")


def resolved(captured: DataFrame, least_bytes: int = 0) -> DataFrame:
    """captured, with the record that each row's revisits refer to as to_record, to_url and to_key; to_record is null for responses."""
    order = F.struct(F.col("key").isNotNull(), "key", "record")
    same = captured.where(F.col("bytes") >= least_bytes).groupBy("digest", "bytes").agg(F.count("*").alias("n"), F.max_by(F.struct("record", "url", "key"), order).alias("to"))
    kept = staged(same.where("n > 1").drop("n"), "originals")  # a table, so that a digest with very many rows can be split
    out = captured.join(kept, ["digest", "bytes"], "left")
    own = F.col("to.record").isNull() | (F.col("to.record") == F.col("record"))
    return out.withColumns({f"to_{c}": F.when(~own, F.col(f"to.{c}")) for c in ("record", "url", "key")}).drop("to")


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0, date: str = DATE, level: int = 6, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the rows as archives under folder, each payload of at least so many bytes once; gives the list of archives (file, bytes, records)."""
    spark = pages.sparkSession
    captured = capture(pages, f"{folder}/captured", key, url, payload, date, archive_bytes)
    plan = resolved(captured, least_bytes)

    def run(batches):
        out, path, source = Archives(f"{folder}/archives", level, archive_bytes), None, iter(())
        for batch in batches:
            for r in batch.to_pylist():
                if r["file"] != path:
                    path, source = r["file"], members(r["file"])
                if r["to_record"] is not None:
                    out.add(revisit(r["record"], r["key"], r["url"], r["bytes"], r["digest"], date, (r["to_record"], r["to_url"], r["to_key"])))
                    continue
                for place, data in source:
                    if place == r["place"]:
                        break
                else:
                    raise ValueError(f"{path} has no record at {r['place']}")
                block = parsed(data)[1]
                out.add(response(r["record"], r["key"], r["url"], block[len(http(r["bytes"])) :], r["digest"], date))
        out.close()
        if out.done:
            yield pa.RecordBatch.from_pylist(out.done, LISTED_SCHEMA)

    total = captured.agg(F.sum("size")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // archive_bytes))
    with batches_of(spark, 1024):
        listed = staged(plan.repartition(tasks, "file").sortWithinPartitions("file", "place").mapInArrow(run, LISTED), "archives")
    sweep(captured)
    return listed


def sweep(captured: DataFrame) -> None:
    """Deletes the archives of the first pass, in tasks, and their headers."""

    def run(batches):
        for batch in batches:
            for path in batch.column("file").to_pylist():
                fs, at = opened(path)
                if fs.get_file_info(at).type != pafs.FileType.NotFound:  # a repeated task finds nothing
                    fs.delete_file(at)
        yield from ()

    captured.select("file").distinct().mapInArrow(run, "file string").write.format("noop").mode("overwrite").save()
    discard(captured)


def read(listed: DataFrame, key: str = "page_id", payload: str | None = None) -> DataFrame:
    """A row for each record of the listed archives: key, payload_bytes, payload_digest, record_type, refers_to, record_id, refers_to_id, url and date, and the payload (null for revisits) under the given name. A response whose payload doesn't have its digest raises."""
    names = [key, "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "refers_to_id", "url", "date", *([payload] if payload else [])]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary()][: len(names)]

    def run(batches):
        for batch in batches:
            for path in batch.column("file").to_pylist():
                rows, held = [], 0
                for _, data in members(path):
                    fields, block = parsed(data)
                    head, _, body = block.partition(b"\r\n\r\n")
                    n = int(re.search(rb"Content-Length: (\d+)", head)[1])
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if fields["WARC-Type"] == "response" and (len(body) != n or digest_of(body) != digest):
                        raise ValueError(f"{fields['WARC-Record-ID']} in {path} doesn't have its digest")
                    own, to = ((int(fields[x]) if x in fields else None) for x in (KEY, REFERS_KEY))
                    row = [own, n, digest, fields["WARC-Type"], to, fields["WARC-Record-ID"][1:-1], fields.get("WARC-Refers-To", "<>")[1:-1] or None, fields.get("WARC-Target-URI") and unquoted(fields["WARC-Target-URI"]), fields["WARC-Date"]]
                    rows.append(row + ([body if fields["WARC-Type"] == "response" else None] if payload else []))
                    held += n if payload else 1024
                    if held >= 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    files = listed.count()
    says = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    with batches_of(listed.sparkSession, 1024):
        return listed.select("file").repartition(max(1, files)).mapInArrow(run, ", ".join(f"`{n}` {says[t]}" for n, t in zip(names, kinds, strict=True)))


def restored(listed: DataFrame, key: str = "page_id", payload: str = "html") -> DataFrame:
    """(key, url, payload as text): every row as it was, revisits with the payload of their response."""
    rows = staged(read(listed, key, payload), "records")
    first = rows.where("record_type = 'response'").select(F.col("record_id").alias("_to"), F.col(payload).alias("_own"))
    out = rows.drop(payload).join(first, F.coalesce("refers_to_id", "record_id") == F.col("_to"))
    return out.select(key, "url", F.col("_own").cast("string").alias(payload))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = write(table(spark, sf_dir, "pages"), fresh_path(spark, "warc"))
    return read(listed).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP13_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, upper(sha1(coalesce(html, ''))) AS h, coalesce(html, '') AS html FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, payload_bytes, array_to_string(flatten(list_transform(range(0, 8), lambda g: list_transform(range(0, 4), lambda j:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 5 * g + 1, 5))::INTEGER >> (15 - 5 * j)::INTEGER) & 31) + 1, 1)))), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM g
"""
