"""WARC records in ZIP archives, read by range without extraction.

Writing: each task packs its pages into ZIP archives of about ``ARCHIVE_BYTES``. An
archive has two stored members: ``archive/data.warc`` with the records and
``indexes/index.cdxj`` with a line for each record. Of pages with equal payloads the
one with the largest page_id is a response, the others are revisits that refer to it.
Every attempt of a task writes files of its own name, and only files in the manifest,
which Spark commits, count: a lost executor leaves nothing that would be read.

Reading: a task opens an archive, finds the end of the central directory in its tail
(with the ZIP64 records where they are), parses the directory, locates the stored
members through their local headers, range-reads the index and then each record.

Cases: NULL html is the empty payload. All rows of the largest page_id of a payload
are responses. A NULL page_id revisits the largest id if there is one, else it is a
response. Control characters of an url are percent-encoded in the record. An empty
table gives an empty result. Payloads are never cut. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answergrid.llm.batches import slices, stored
from answergrid.sources.shared import new_path

ARCHIVE_BYTES = 64 << 20
DATA, INDEX = "archive/data.warc", "indexes/index.cdxj"
_DATE = "2020-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(name: str) -> int | None:
    digits = name.removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit has the payload's HTTP headers only."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    revisit = fields["WARC-Type"] == "revisit"
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"{fields['WARC-Record-ID']} does not match its digest")
    return {
        "page_id": _page(fields["WARC-Record-ID"]),
        "url": fields["WARC-Target-URI"],
        "record_type": fields["WARC-Type"],
        "refers_to": _page(fields["WARC-Refers-To"]) if revisit else None,
        "payload_bytes": size,
        "payload_digest": digest,
        "payload": None if revisit else payload,
    }


def write_archives(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the archives; returns the manifest ``archive, records``.

    Payloads of fewer than ``least_bytes`` bytes are all responses.
    """
    spark = pages.sparkSession
    target = folder or new_path(spark, "archives")
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    digest = F.sha1(payload)
    known = pages.select("page_id", "url", "html").withColumn("digest", F.when(F.length(payload) >= least_bytes, digest))
    shared = (
        known.where("digest is not null")
        .groupBy(F.col("digest").alias("equal"))
        .agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 and largest is not null")
    )
    shared = stored(shared.drop("n"), "equal-payloads")
    marked = known.join(shared, F.col("digest") == F.col("equal"), "left").select(
        "page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("largest")), F.col("largest")).alias("refers_to")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = pafs.FileSystem.from_uri(target) if "://" in target or target.startswith("file:") else (pafs.LocalFileSystem(), target)
        system.create_dir(place, recursive=True)
        rows = (row for batch in slices(batches, "html") for row in batch.to_pylist())
        row = next(rows, None)
        while row is not None:
            name, index, at = f"{uuid.uuid4().hex}.zip", [], 0
            with system.open_output_stream(f"{place}/{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
                with archive.open(zipfile.ZipInfo(DATA), "w", force_zip64=True) as data:
                    while row is not None and at < archive_bytes:
                        raw = record(row["page_id"], row["url"], (row["html"] or "").encode(), row["refers_to"], row["refers_to"] is not None)
                        data.write(raw)
                        index.append(json.dumps({"offset": at, "length": len(raw)}))
                        at += len(raw)
                        row = next(rows, None)
                archive.writestr(zipfile.ZipInfo(INDEX), "\n".join(index))
            yield pa.RecordBatch.from_pydict({"archive": [f"{target}/{name}"], "records": [len(index)]})

    return stored(marked.mapInArrow(write, "archive string, records long"), "archive-manifest")


def directory(file: pa.NativeFile) -> dict[str, tuple[int, int, int]]:
    """``method, offset of the data, size`` of each member, from the central directory."""
    size = file.size()
    tail_at = max(0, size - (1 << 16) - 64)
    tail = file.read_at(size - tail_at, tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack("<HII", tail[end + 10 : end + 20])
    if end >= 20 and tail[end - 20 : end - 16] == b"PK\x06\x07":
        at = struct.unpack("<Q", tail[end - 12 : end - 4])[0]
        count, length, start = struct.unpack("<QQQ", file.read_at(56, at)[32:56])
    raw, at, members = file.read_at(length, start), 0, {}
    for _ in range(count):
        if raw[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method = struct.unpack("<H", raw[at + 10 : at + 12])[0]
        packed, plain = struct.unpack("<II", raw[at + 20 : at + 28])
        names, extras, comments = struct.unpack("<HHH", raw[at + 28 : at + 34])
        local = struct.unpack("<I", raw[at + 42 : at + 46])[0]
        name = raw[at + 46 : at + 46 + names].decode()
        extra = raw[at + 46 + names : at + 46 + names + extras]
        while len(extra) >= 4:
            kind, n = struct.unpack("<HH", extra[:4])
            if kind == 1:
                # 64-bit values follow in this order, for those that are all ones above.
                values = iter(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                plain = next(values) if plain == 0xFFFFFFFF else plain
                packed = next(values) if packed == 0xFFFFFFFF else packed
                local = next(values) if local == 0xFFFFFFFF else local
            extra = extra[4 + n :]
        own_names, own_extras = struct.unpack("<HH", file.read_at(30, local)[26:30])
        members[name] = (method, local + 30 + own_names + own_extras, packed)
        at += 46 + names + extras + comments
    return members


def read_archives(manifest: DataFrame) -> DataFrame:
    """All records of the archives, each read by its range."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                system, place = pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)
                with system.open_input_file(place) as file:
                    members = directory(file)
                    if any(members[m][0] != 0 for m in (DATA, INDEX)):
                        raise ValueError(f"{uri} has members that are not stored")
                    _, start, _ = members[DATA]
                    _, at, size = members[INDEX]
                    rows, total = [], 0
                    for line in file.read_at(size, at).split(b"\n"):
                        entry = json.loads(line)
                        rows.append(parse_record(file.read_at(entry["length"], start + entry["offset"])))
                        total += entry["length"]
                        if total >= 1 << 21:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, total = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

    count = manifest.count()
    return manifest.select("archive").repartition(max(1, count), "archive").mapInArrow(read, RECORDS)
