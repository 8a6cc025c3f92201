"""WARC archives: a writer, and a sequential reader.

The writer makes one gzip member for each record.  The reader goes through a
file once, inflates it piece by piece, takes a record's block by its
Content-Length, and verifies the block's and the payload's digest; it never
holds more than a record and a piece of input.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import opened, written_file
from .shared import in_small_batches, qualified, saved, shared_folder, small

#: Equal payloads below this size are stored each time.
REVISIT_BYTES = 1000
READ_BYTES = 1 << 18
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """A file that is no well-formed archive, or whose digests don't match."""


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, first: tuple[int, str | None] | None = None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One record as a gzip member; with ``first``, the id and the url of the
    page that has the payload, a revisit of it.  A revisit holds the HTTP header
    alone, whose Content-Length and the payload digest are those of the full
    payload.  Record ids are unique; pages are named in fields of their own."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if first is None else http
    fields = [
        ("WARC-Type", "response" if first is None else "revisit"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", _uri(url)),
        ("WARC-Payload-Digest", _sha1(payload)),
        ("WARC-Block-Digest", _sha1(block)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if first is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To-Target-URI", _uri(first[1])), ("WARC-Refers-To-Date", date), ("X-Refers-To-Page-ID", str(first[0]))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head.encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def _uri(url: str | None) -> str:
    return quote(url or "urn:x-unknown", safe=":/?#[]@!$&'()*+,;=%~")


@dataclass
class Record:
    headers: dict[str, str]
    http: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""


def _members(stream) -> Iterator[Iterator[bytes]]:
    """For each gzip member of a stream its inflated pieces.  A member must be
    read to its end before the next."""
    data = stream.read(READ_BYTES)
    while data:
        z = zlib.decompressobj(31)
        rest: list[bytes] = []

        def pieces(z=z, data=data, rest=rest) -> Iterator[bytes]:
            try:
                while True:
                    if out := z.decompress(data, READ_BYTES):
                        yield out
                    if z.eof:
                        rest.append(z.unused_data)
                        return
                    data = z.unconsumed_tail or stream.read(READ_BYTES)
                    if not data:
                        raise WarcError("the file ends within a record")
            except zlib.error as e:
                raise WarcError(f"broken gzip member: {e}") from e

        yield pieces()
        if not rest:
            raise WarcError("a record was not read to its end")
        data = rest[0] or stream.read(READ_BYTES)


def _headers(lines: Iterable[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon:
            raise WarcError(f"no header line: {line[:80]!r}")
        out[name.strip().lower()] = value.strip()
    return out


def records(stream) -> Iterator[Record]:
    """The records of an archive, each verified."""
    for member in _members(stream):
        data = bytearray()
        length = end = None
        for piece in member:
            data += piece
            if length is None and (at := data.find(b"\r\n\r\n")) >= 0:
                lines = bytes(data[:at]).split(b"\r\n")
                if not lines[0].startswith(b"WARC/1."):
                    raise WarcError(f"no WARC record: {lines[0][:40]!r}")
                headers, end = _headers(lines[1:]), at + 4
                length = int(headers.get("content-length", -1))
                if length < 0:
                    raise WarcError("a record without Content-Length")
            if length is not None and len(data) > end + length + 4:
                raise WarcError("a record is longer than its Content-Length")
        if length is None or bytes(data[end + length :]) != b"\r\n\r\n":
            raise WarcError("a record doesn't end where its Content-Length says")
        block = bytes(data[end : end + length])
        if "warc-block-digest" in headers and headers["warc-block-digest"] != _sha1(block):
            raise WarcError(f"block digest of {headers.get('warc-record-id')}")
        head, _, payload = block.partition(b"\r\n\r\n")
        if headers.get("warc-type") == "response" and headers.get("warc-payload-digest", digest := _sha1(payload)) != digest:
            raise WarcError(f"payload digest of {headers.get('warc-record-id')}")
        yield Record(headers, _headers(head.split(b"\r\n")[1:]), payload)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Writes a record for each row of ``pages`` below ``folder`` and returns
    the files written: ``path, n_records``.

    Of equal payloads of ``revisit_bytes`` or more the one with the largest id
    is the response and the others revisit it; rows that share that id, and all
    rows where no id is set, are responses.  Null html is an empty payload, a
    null url ``urn:x-unknown``; a very long page is one record.  Repeated rows
    are a record each.  Further columns are not read.  Empty input: no files.

    Pages meet the table of repeated payloads by digest: digests, ids and urls
    alone, broadcast while they are few; else pages are shuffled once.
    """
    in_small_batches(pages.sparkSession)
    folder = qualified(pages.sparkSession, folder)
    html = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), html.alias("payload"))
    rows = rows.withColumns({"size": F.length("payload").cast("long"), "sha1": F.sha1("payload")})
    large = rows.filter(F.col("size") >= revisit_bytes).select("sha1", "id", "url")
    twice = large.groupBy("sha1").agg(F.count("*").alias("c"), F.max(F.struct("id", "url")).alias("first")).filter("c > 1 AND first.id IS NOT NULL").drop("c")
    twice = small(saved(twice, "warc-payloads"))
    rows = rows.join(twice, "sha1", "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first.id"))
    rows = rows.select("id", "url", "payload", F.when(revisit, F.col("first.id")).alias("to"), F.when(revisit, F.col("first.url")).alias("to_url"))

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        n = 0
        with written_file(folder, "pages", ".warc.gz") as (stream, path):
            while first is not None:
                for id_, url, payload, to, to_url in zip(*(c.to_pylist() for c in first.columns), strict=True):
                    stream.write(record(id_, url, payload, None if to is None else (to, to_url)))
                    n += 1
                first = next(batches, None)
        yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [n]}, schema=pa.schema([("path", pa.string()), ("n_records", pa.int64())]))

    return saved(rows.mapInArrow(write, "path string, n_records long"), "warc-files")


READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def read_archives(files: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives named in ``files.path``: ``page_id, url,
    payload_bytes, payload_digest`` (hex SHA-1, both of the full payload),
    ``record_type, refers_to`` and, if asked for, ``payload`` (null for a
    revisit).  A file is read by one task, front to back."""
    schema = READ if payloads else pa.schema(list(READ)[:-1])

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                with opened(path) as stream:
                    for r in records(stream):
                        kind = r.headers["warc-type"]
                        digest = base64.b32decode(r.headers["warc-payload-digest"].removeprefix("sha1:")).hex()
                        page, to = (None if v is None else int(v) for v in map(r.headers.get, ("x-page-id", "x-refers-to-page-id")))
                        size = int(r.http["content-length"]) if kind == "revisit" else len(r.payload)
                        row = (page, r.headers["warc-target-uri"], size, digest, kind, to, r.payload if kind == "response" else None)
                        rows.append(row[: len(schema)])
                        held += len(r.payload) * payloads + 200
                        if held > 16 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    kinds = {"int64": "long", "string": "string", "binary": "binary"}
    ddl = ", ".join(f"{f.name} {kinds[str(f.type)]}" for f in schema)
    n = max(1, files.count())
    return files.select("path").repartition(min(n, 10_000), "path").mapInArrow(read, ddl)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` to archives in the shared folder and reads them back:
    ``page_id, payload_bytes, payload_digest, record_type, refers_to``."""
    files = write_archives(pages, shared_folder(pages.sparkSession, "warc"))
    return read_archives(files, payloads=False).drop("url")
