"""WARC archives in Zstandard: one frame per record, the dictionary in the leading skippable frame.

Writing: each task writes archives of about `archive_bytes` of payload into the shared folder under names of its own,
and returns their paths. Only paths that a finished task returned are in the manifest, so what a lost task left behind is never
read. Of records with equal payloads of at least `least_bytes`, that with the smallest page_id is a response with the
payload, the others are revisits that refer to it and hold the HTTP header alone; smaller payloads are always whole.

Reading: the dictionary comes from the leading skippable frame, frames are decoded one by one as bytes arrive, and each
record's version line, required headers, lengths and payload digest are checked; a record that fails raises ValueError
with the archive's path and the record's number.

Cases: a null html is an empty payload; a null page_id is written as an empty one and read as null, and such a record is never what others
refer to (it refers to the smallest page_id of its payload, or is a response where there is none); a null or odd url is written with its control characters and blanks
percent-encoded; repeated rows with the smallest page_id are all responses; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import scratch, spread_join, stored, table

LEAST_BYTES = 100
ARCHIVE_BYTES = 64 << 20
#: A dictionary is trained on an archive's first records, up to so many bytes of them.
SAMPLE_BYTES = 1 << 20
DICTIONARY_BYTES = 16 << 10
#: The skippable frame that holds a dictionary, and the first bytes of a Zstandard frame.
SKIPPABLE, FRAME = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 20
#: Tasks that read archives at most; a task reads several, one after the other.
READERS = 20_000


class Record(NamedTuple):
    page_id: int | None
    url: str
    payload_bytes: int
    payload_digest: str
    record_type: str
    refers_to: int | None
    payload: bytes | None


def encode(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record; a revisit (refers_to given) holds the HTTP header without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Target-URI", quote(url or "", safe="!#$%&'()*+,/:;=?@[]~")),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha256:{hashlib.sha256(payload).hexdigest()}"),
        *([] if refers_to is None else [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)]),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers).encode() + b"\r\n" + block + b"\r\n\r\n"


def _split(head: bytes, what: str) -> dict[str, str]:
    out = {}
    for line in head.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError(f"{what}: a header line without a colon: {line[:80]!r}")
        out[name.decode().strip().lower()] = value.decode().strip()
    return out


def _page(uri: str, what: str) -> int | None:
    if not uri.startswith("<urn:page:") or not uri.endswith(">"):
        raise ValueError(f"{what}: a record id of another form: {uri[:80]}")
    return int(uri[10:-1]) if uri[10:-1] else None


def decode(raw: bytes, what: str = "record") -> Record:
    """Check one record and return its content."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    first, _, head = head.partition(b"\r\n")
    if not gap or first != VERSION:
        raise ValueError(f"{what}: no {VERSION.decode()} header")
    headers = _split(head, what)
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"} - headers.keys():
        raise ValueError(f"{what}: headers are missing: {sorted(missing)}")
    n = int(headers["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"{what}: the block has {len(rest) - 4} bytes, Content-Length says {n}")
    http, gap, payload = rest[:n].partition(b"\r\n\r\n")
    if not gap or not http.startswith(b"HTTP/"):
        raise ValueError(f"{what}: no HTTP header in the block")
    size = int(_split(http.partition(b"\r\n")[2], what)["content-length"])
    digest, kind = headers["warc-payload-digest"].removeprefix("sha256:"), headers["warc-type"]
    if kind == "response":
        if len(payload) != size:
            raise ValueError(f"{what}: the payload has {len(payload)} bytes, its header says {size}")
        if hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"{what}: the payload's digest differs")
    elif kind != "revisit" or payload or "warc-refers-to" not in headers:
        raise ValueError(f"{what}: not a response and not a whole revisit: {kind}")
    refers = _page(headers["warc-refers-to"], what) if kind == "revisit" else None
    return Record(_page(headers["warc-record-id"], what), headers.get("warc-target-uri", ""), size, digest, kind, refers, payload if kind == "response" else None)


def dictionary(samples: list[bytes]) -> bytes:
    """A dictionary trained on samples; where they are too few for that, their own bytes are one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return (b"".join(samples)[-DICTIONARY_BYTES:] or VERSION * 2).ljust(16, b" ")


#: Hadoop's names of stores, and Arrow's (fixed values).
_SCHEMES = {"s3a": "s3", "s3n": "s3"}


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system for a path as Spark names it."""
    scheme, mark, rest = path.partition("://")
    if mark and scheme == "viewfs":
        return fs.HadoopFileSystem(f"viewfs://{rest.partition('/')[0]}"), "/" + rest.partition("/")[2]
    path = _SCHEMES.get(scheme, scheme) + mark + rest
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def write_archive(path: str, records: Iterator[bytes]) -> tuple[int, int]:
    """Write records (at least their first ones, for the dictionary, are held in memory); their number and the archive's bytes."""
    held, size = [], 0
    for r in records:
        held.append(r)
        size += len(r)
        if size >= SAMPLE_BYTES:
            break
    trained = dictionary(held)
    compress = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(trained)).compress
    system, place = _file_system(path)
    n = done = 0
    with system.open_output_stream(place, compression=None) as out:
        out.write(struct.pack("<II", SKIPPABLE, len(trained)) + trained)
        for r in held:
            done += out.write(compress(r)) or 0
            n += 1
        held.clear()
        for r in records:
            out.write(compress(r))
            n += 1
        done = out.tell()
    return n, done


def read_archive(path: str) -> Iterator[Record]:
    """The records of one archive, one frame in memory at a time."""
    system, place = _file_system(path)
    with system.open_input_stream(place, compression=None) as source:
        magic, n = struct.unpack("<II", source.read(8).ljust(8, b"\0"))
        if magic != SKIPPABLE:
            raise ValueError(f"{path}: no dictionary frame leads")
        trained = source.read(n)
        if len(trained) < n:
            raise ValueError(f"{path}: the dictionary frame is cut off")
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained))
        rest, at = b"", 0
        while rest or (rest := source.read(CHUNK)):
            while len(rest) < 4 and (more := source.read(CHUNK)):
                rest += more
            if rest[:4] != FRAME:
                raise ValueError(f"{path}, record {at}: no Zstandard frame")
            frame, parts = reader.decompressobj(), []
            while True:
                parts.append(frame.decompress(rest))
                if frame.eof:
                    rest = frame.unused_data
                    break
                if not (rest := source.read(CHUNK)):
                    raise ValueError(f"{path}, record {at}: the frame is cut off")
            yield decode(b"".join(parts), f"{path}, record {at}")
            at += 1


def write(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives of all pages under folder; returns their manifest: path, n_records, n_bytes."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.when(F.octet_length(html) >= least_bytes, F.sha2(html, 256)).alias("digest"))
    # only digests of several records are joined back: elsewhere the record is its own response
    several = rows.filter("digest is not null").groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first")
    refers = F.when(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    dealt = spread_join(rows, several, ["digest"], "left", ["page_id"]).select("page_id", "url", "html", refers.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((page, url, (text or "").encode(), refers) for b in batches for page, url, text, refers in zip(*(c.to_pylist() for c in b.columns), strict=True))
        ahead = next(rows, None)
        while ahead is not None:

            def some() -> Iterator[bytes]:
                nonlocal ahead
                size = 0
                while ahead is not None and size < archive_bytes:
                    page, url, payload, refers = ahead
                    size += len(payload)
                    yield encode(page, url, payload, refers)
                    ahead = next(rows, None)

            path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
            n, size = write_archive(path, some())
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["path", "n_records", "n_bytes"])

    return stored(dealt.mapInArrow(run, "path string, n_records long, n_bytes long"), "warc-manifest")


def read(manifest: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for a revisit) of every record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                held, size = [], 0
                for r in read_archive(path):
                    held.append(r)
                    size += len(r.payload or b"") + 100
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    spread = manifest.select("path").repartition(max(1, min(manifest.count(), READERS)))
    return spread.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write(table(spark, sf_dir, "pages"), scratch(spark, "warc"))
    return read(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
with p as (select page_id, coalesce(html, '') h, sha256(coalesce(html, '')) d from pages),
f as (select d, min(page_id) first from p where strlen(h) >= 100 group by d)
select page_id, cast(strlen(h) as bigint) payload_bytes, p.d payload_digest,
  case when first < page_id then 'revisit' else 'response' end record_type,
  case when first < page_id then first end refers_to
from p left join f on p.d = f.d
"""
