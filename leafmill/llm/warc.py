"""Web archives: writing, normalising, indexing and reading them back.

Archives are written as one gzip stream per file, as many tools do. The normaliser
inflates such a stream once, from front to back in chunks, and rewrites every record as
a gzip member of its own, with a sidecar file that lists offset and length of each
member. Readers then fetch single records. All files are in a folder that every executor
reaches; names carry a fresh part for each task attempt and only the names that a
finished task returns are used, so a lost executor leaves nothing half-written behind.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.spark import bounded_batches, shuffle_parts, stored
from leafmill.operators.frames import broadcast_if_small
from leafmill.session import scratch

ARCHIVE_BYTES = 32 << 20  # a new archive begins beyond that many bytes of records
CHUNK = 1 << 20
LEVEL = 3
LEAST_BYTES = 0  # records with smaller payloads are never revisits
DATE = "1970-01-01T00:00:00Z"  # pages have no time of their own
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LAST_ID = (1 << 63) - 1
INDEX = "archive string, offset long, length long, record string, type string"


def revisits(pages: DataFrame, id_col: str, html_col: str, least_bytes: int) -> DataFrame:
    """(at, sha, first): rows whose payload an earlier id has, with the least such id."""
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("at"), payload.alias("payload"))
    rows = rows.where(F.octet_length("payload") >= least_bytes).select("at", F.sha1("payload").alias("sha"))
    groups = rows.groupBy("sha").agg(F.min("at").alias("first"), F.max("at").alias("last")).where("first < last")
    return rows.join(groups.select("sha", "first"), "sha").where("at > first").distinct()


def record(page_id: str, url: str, payload: bytes, refers_to: str | None) -> bytes:
    """One record: a response with its payload, or a revisit with the HTTP head alone."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Target-URI: {re.sub(r'[\x00-\x20\x7f]', lambda m: f'%{ord(m[0]):02X}', url)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = LEAST_BYTES
) -> DataFrame:
    """Write all pages into archives of one gzip stream each: (archive).

    Of pages with equal payloads the least id is written in full, the others as revisits
    to it; pages that share that id are written in full too.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    known = revisits(pages, id_col, html_col, least_bytes).select(F.col("at").alias("r_at"), F.col("sha").alias("r_sha"), "first")
    rows = pages.select(
        F.col(id_col).cast("string").alias("id"),
        F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).alias("html"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("at"),
    )
    rows = rows.join(
        broadcast_if_small(stored(known, "revisits")),
        (F.col("at") == F.col("r_at")) & (F.sha1(F.encode("html", "UTF-8")) == F.col("r_sha")),
        "left",
    ).select("id", "url", "html", F.col("first").cast("string").alias("first"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, place = FileSystem.from_uri(folder)
        files.create_dir(place, recursive=True)
        out = packer = name = None
        size = 0
        for batch in batches:
            for page_id, url, html, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name, size = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = files.open_output_stream(f"{place}/{name}", compression=None)
                    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                whole = record(page_id or "", url, html.encode("utf-8", "replace"), first)
                out.write(packer.compress(whole))
                size += len(whole)
                if size >= ARCHIVE_BYTES:
                    out.write(packer.flush())
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"archive": [name]})
        if out is not None:
            out.write(packer.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"archive": [name]})

    return stored(rows.mapInArrow(write, "archive string"), "archives")


class Stream:
    """The bytes of a gzip file, inflated as they are asked for."""

    def __init__(self, source):
        self.source = source
        self.inflater = zlib.decompressobj(31)
        self.ready = bytearray()
        self.packed = b""

    def more(self) -> bool:
        """Inflate another chunk; a file may hold several members one after the other."""
        while True:
            if not self.packed:
                self.packed = self.source.read(CHUNK)
                if not self.packed:
                    return False
            if self.inflater.eof:
                self.inflater = zlib.decompressobj(31)
            got = self.inflater.decompress(self.packed, CHUNK)
            self.packed = self.inflater.unconsumed_tail or self.inflater.unused_data
            if got:
                self.ready += got
                return True

    def head(self) -> bytes | None:
        """Up to the next empty line, or None at the end of the file."""
        while (end := self.ready.find(b"\r\n\r\n")) < 0:
            if not self.more():
                if self.ready.strip():
                    raise ValueError("the archive ends within the head of a record")
                return None
        head = bytes(self.ready[: end + 4])
        del self.ready[: end + 4]
        return head

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes, in chunks."""
        while n:
            if not self.ready and not self.more():
                raise ValueError("the archive ends within a record")
            part = bytes(self.ready[:n])
            del self.ready[:n]
            n -= len(part)
            yield part


def fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if k}


def normalise(archives: DataFrame, source: str, target: str) -> DataFrame:
    """Rewrite archives with one gzip member per record: the index (archive, offset, length, record, type).

    Beside each new archive lies the same index as a text file, one line per record. A
    record is copied in chunks, so memory doesn't depend on its size.
    """

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, place = FileSystem.from_uri(source)
        out_files, out_place = FileSystem.from_uri(target)
        out_files.create_dir(out_place, recursive=True)
        for batch in batches:
            for old in batch.column(0).to_pylist():
                name = f"{uuid.uuid4().hex}.warc.gz"
                rows: list[tuple] = []
                at = 0
                with (
                    files.open_input_stream(f"{place}/{old}", compression=None) as packed,
                    out_files.open_output_stream(f"{out_place}/{name}", compression=None) as out,
                    out_files.open_output_stream(f"{out_place}/{name}.idx", compression=None) as sidecar,
                ):
                    stream = Stream(packed)
                    while (head := stream.head()) is not None:
                        about = fields(head)
                        packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        size = out.write(packer.compress(head))
                        for part in stream.take(int(about["content-length"]) + 4):
                            size += out.write(packer.compress(part))
                        size += out.write(packer.flush())
                        rows.append((name, at, size, about["warc-record-id"], about["warc-type"]))
                        sidecar.write(f"{at} {size} {about['warc-type']} {about['warc-record-id']}\n".encode())
                        at += size
                if rows:
                    yield pa.RecordBatch.from_pydict(dict(zip(("archive", "offset", "length", "record", "type"), zip(*rows, strict=True), strict=True)))

    parts = max(1, shuffle_parts(archives.sparkSession))
    return stored(archives.repartition(parts, "archive").mapInArrow(rewrite, INDEX), "index")


def read_records(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) of indexed records.

    Each record is fetched by offset and length. Digest and length of a response are
    taken from its payload, and compared with its head; those of a revisit from its head.
    Ids are text here. ``payloads`` false leaves the payloads out.
    """
    kinds = "page_id string, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to string"
    names = [k.split()[0] for k in kinds.split(", ")]

    def page(urn: str) -> str:
        return urn.removeprefix("<urn:page:").removesuffix(">")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, place = FileSystem.from_uri(folder)
        opened: tuple[str, object] | None = None
        for batch in batches:
            rows, size = [], 0
            for archive, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if opened is None or opened[0] != archive:
                    if opened:
                        opened[1].close()
                    opened = (archive, files.open_input_file(f"{place}/{archive}"))
                whole = zlib.decompress(opened[1].read_at(length, offset), 31)
                head, _, rest = whole.partition(b"\r\n\r\n")
                about = fields(head)
                http, _, payload = rest[: int(about["content-length"])].partition(b"\r\n\r\n")
                digest, count = about["warc-payload-digest"].removeprefix("sha1:"), int(fields(http)["content-length"])
                refers = None
                if about["warc-type"] == "response":
                    found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    if (found, len(payload)) != (digest, count):
                        raise ValueError(f"record {about['warc-record-id']} does not hold what its head says")
                else:
                    refers, payload = page(about["warc-refers-to"]), None
                rows.append((page(about["warc-record-id"]), about["warc-target-uri"], payload if payloads else None, count, digest, about["warc-type"], refers))
                size += len(whole) if payloads else 0
                if size >= CHUNK * 8:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], _schema())
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], _schema())
        if opened:
            opened[1].close()

    placed = index.select("archive", "offset", "length").repartition(shuffle_parts(index.sparkSession), "archive")
    return placed.sortWithinPartitions("archive", "offset").mapInArrow(read, kinds)


def _schema() -> pa.Schema:
    text, whole = pa.string(), pa.int64()
    return pa.schema(
        [("page_id", text), ("url", text), ("payload", pa.binary()), ("payload_bytes", whole), ("payload_digest", text), ("record_type", text), ("refers_to", text)]
    )


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = LEAST_BYTES, payloads: bool = False) -> DataFrame:
    """Write, normalise and read back all pages: the columns of ``read_records`` with the input's ids.

    Null pages have an empty payload; null ids come after all others and stay null;
    repeated rows each give a record; an empty table gives none; other columns are not
    read. Urls come back with white space and control characters percent-encoded.
    """
    spark = pages.sparkSession
    folder = scratch(spark, "warc")
    archives = write_archives(pages, f"{folder}/whole", id_col, url_col, html_col, least_bytes)
    index = normalise(archives, f"{folder}/whole", f"{folder}/members")
    rows = read_records(index, f"{folder}/members", payloads)
    kind = pages.schema[id_col].dataType.simpleString()
    return rows.withColumns({c: F.nullif(F.col(c), F.lit("")).cast(kind) for c in ("page_id", "refers_to")})
