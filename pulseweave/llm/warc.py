"""WARC archives: a writer that stores equal payloads once, and a sequential reader.

Every record is a gzip member of its own. The reader inflates an archive in pieces,
member by member, frames each record by its Content-Length and verifies digests.
Archives lie in a folder that all executors reach; files are opened in the tasks,
through pyarrow's file systems, by the names in a written manifest.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseweave.lineage import materialize, new_path

LEAST_REVISIT_BYTES = 100
ARCHIVE_BYTES = 32 << 20
PIECE = 1 << 16
DATE = "2024-01-01T00:00:00Z"
COMPRESSION = 3
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = (
    "record_id string, record_type string, target_uri string, payload_bytes long, payload_digest string, refers_to string"
)


class DamagedArchive(ValueError):
    """An archive that does not hold what its records declare."""


def _one_line(value: str) -> str:
    """Header values cannot hold line ends or other controls; these are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One record, uncompressed. A revisit has the response's HTTP header but no payload."""
    name = lambda x: f"<urn:page:{'' if x is None else x}>"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http;msgtype=response",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_one_line(url)}")
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def members(stream, piece: int = PIECE) -> Iterator[bytes]:
    """The gzip members of a stream, inflated one after the other from pieces of it."""
    held = b""
    while True:
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            held = held or stream.read(piece)
            if not held:
                if parts:
                    raise DamagedArchive("the archive ends inside a record")
                return
            try:
                parts.append(inflate.decompress(held))
            except zlib.error as error:
                raise DamagedArchive(str(error)) from error
            held = inflate.unused_data
        yield b"".join(parts)


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    return {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}


def parse_record(record: bytes) -> dict:
    """Fields of a record, after its framing and digests were verified."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = _headers(head)
    if not head.startswith(b"WARC/1.") or "content-length" not in fields:
        raise DamagedArchive("a member that is no record")
    size = int(fields["content-length"])
    block, tail = rest[:size], rest[size:]
    if len(block) != size or tail != b"\r\n\r\n":
        raise DamagedArchive(f"{fields.get('warc-record-id')}: its length is not the declared one")
    if "sha256:" + hashlib.sha256(block).hexdigest() != fields.get("warc-block-digest"):
        raise DamagedArchive(f"{fields.get('warc-record-id')}: its block does not match its digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, declared = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
    length = int(_headers(http)["content-length"])
    if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != declared):
        raise DamagedArchive(f"{fields['warc-record-id']}: its payload does not match its digest")
    return {
        "record_id": fields["warc-record-id"], "record_type": kind, "target_uri": fields.get("warc-target-uri"),
        "payload_bytes": length, "payload_digest": declared, "refers_to": fields.get("warc-refers-to"), "payload": payload,
    }


def _write_batches(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, name, written, count, names, counts = None, "", 0, 0, [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    # A task that runs again writes under new names; the manifest has those that count.
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, written, count = store.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                squeeze = zlib.compressobj(COMPRESSION, zlib.DEFLATED, 31)
                member = squeeze.compress(build_record(*row)) + squeeze.flush()
                out.write(member)
                written, count = written + len(member), count + 1
                if written >= ARCHIVE_BYTES:
                    out.close()
                    out = None
                    names.append(name)
                    counts.append(count)
        if out is not None:
            out.close()
            names.append(name)
            counts.append(count)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], ["archive", "records"])

    return run


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """Writes a record per row of ``pages`` (page_id, url, html); returns the manifest.

    The payload is the html in UTF-8, a null one is empty. Of equal payloads of
    ``least`` bytes or more, the row with the smallest page_id is a response and the
    others revisit it; rows that repeat that page_id are responses too, and so is a
    row without page_id. The manifest (archive, records) is a written table.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("long"))
    first = (
        rows.filter(F.col("size") >= least)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
        .filter("copies > 1 AND first IS NOT NULL")
        .select("digest", "first")
    )
    joined = rows.join(first, "digest", "left")
    refers = F.when((F.col("page_id") != F.col("first")) & (F.col("size") >= least), F.col("first"))
    joined = joined.withColumn("refers_to", refers)
    kept = F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b""))
    records = joined.select("page_id", "url", kept.alias("payload"), "digest", "size", "refers_to")
    return materialize(records.mapInArrow(_write_batches(folder), "archive string, records long"), "warc-manifest")


def _read_batches(folder: str, with_payload: bool):
    names = [c.split()[0] for c in RECORD_SCHEMA.split(", ")] + ["payload"] * with_payload
    schema = pa.schema([(n, pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                held, size = [], 0
                with store.open_input_stream(f"{root}/{archive}", compression=None) as stream:
                    for member in members(stream):
                        record = parse_record(member)
                        held.append([record[n] for n in names])
                        size += len(member)
                        if size > ARCHIVE_BYTES // 4 or len(held) >= 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    return run


def read_archives(manifest: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """The records of the archives in ``manifest``; a damaged one ends the job with its reason.

    ``payload_bytes`` and ``payload_digest`` are those of the full payload, of a revisit
    those that it declares. With ``with_payload`` the payload comes too.
    """
    archives = max(1, manifest.count())
    schema = RECORD_SCHEMA + (", payload binary" if with_payload else "")
    return manifest.select("archive").repartition(archives, "archive").mapInArrow(_read_batches(folder, with_payload), schema)


def page_records(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes ``pages`` to archives in ``folder`` and gives what is read back from them."""
    folder = folder or new_path(pages.sparkSession, "warc")
    records = read_archives(write_archives(pages, folder), folder)
    number = lambda c: F.regexp_extract(c, "^<urn:page:(.*)>$", 1).try_cast("long")
    return records.select(
        number(F.col("record_id")).alias("page_id"), "target_uri", "payload_bytes", "payload_digest", "record_type",
        number(F.col("refers_to")).alias("refers_to"),
    )
