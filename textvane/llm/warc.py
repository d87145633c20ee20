"""WARC archives: whole-file gzip streams normalised to one gzip member per record.

``write_crawl`` writes pages as a crawler does: response records, one gzip stream per archive.
``normalise`` inflates each archive's stream once, from its first byte to its last, and rewrites
every record as a gzip member of its own, so that a record can be read at its offset; beside the
archive goes a sidecar with a JSON line (offset, length, record id, type, digest, uri) per record.
Records that repeat a payload become revisits of the one response that keeps it.
``read_archives`` reads every record back through the sidecars' offsets and checks its digest.

Payloads are moved by nothing but the archives: each is compressed where its page is scanned, and
the choice of responses is made on narrow rows (archive, record number, id, payload hash), of which
only the revisits go to the task that normalises their archive.  An archive holds at most
``ARCHIVE_BYTES`` of blocks before compression (or one larger page) and ``ARCHIVE_RECORDS`` records.
Archives carry a name of their own for every attempt to write them; those of lost or repeated tasks
are never listed.

Payloads are equal if their SHA-256 and length are.  Of the records with equal payloads of at least
``least_bytes`` bytes the one with the largest id is the response (null is the smallest id); a row
that repeats id and payload is the same record written again and gets the same type.  A null
payload is empty.  A null id is written as ``<urn:page>`` and read back as null; a null address is left out.  Control
characters and blanks of an address are percent-encoded.  A damaged or truncated archive raises
ValueError with its name.  A page must stay below 2 GB, Arrow's limit for one value.  Without pages
there are no archives and no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textvane.llm.common import columns_as, joined_spread, stored
from textvane.llm.files import file_system
from textvane.session import scratch_path

ARCHIVE_BYTES = 64 << 20
ARCHIVE_RECORDS = 65_536
DATE = "2024-01-01T00:00:00Z"  # the tables hold no fetch time

# fixed values: names of the WARC 1.1 format
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http;msgtype=response"

_GZIP = 31  # zlib's window bits for a gzip stream


# --- records ----------------------------------------------------------------------


def record_id(page) -> str:
    return "<urn:page>" if page is None else f"<urn:page:{quote(str(page), safe='')}>"


def page_of(record: str) -> str | None:
    name = record.strip("<>").removeprefix("urn:page")
    return unquote(name[1:]) if name else None


def digest_of(payload) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(headers: dict[str, str], block: bytes) -> bytes:
    lines = [f"{name}: {value}".encode() for name, value in headers.items()]
    lines.append(b"Content-Length: %d" % len(block))
    return b"\r\n".join([VERSION, *lines, b"", b""]) + block + b"\r\n\r\n"


def response_record(page, url: str | None, payload) -> bytes:
    headers = {"WARC-Type": "response", "WARC-Record-ID": record_id(page), "WARC-Date": DATE}
    if url is not None:
        headers["WARC-Target-URI"] = quote(url, safe="".join(map(chr, range(33, 127))))
    headers |= {"WARC-Payload-Digest": f"sha1:{digest_of(payload)}", "Content-Type": HTTP_TYPE}
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    return record_bytes(headers, b"%b%b" % (http, memoryview(payload)))


def as_revisit(headers: dict[str, str], block: bytes, target) -> tuple[dict[str, str], bytes]:
    """The record as a revisit of ``target``: same headers, the HTTP head without the body."""
    head, _, _ = block.partition(b"\r\n\r\n")
    changed = {k: v for k, v in headers.items() if k != "Content-Type"}
    changed |= {"WARC-Type": "revisit", "WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": record_id(target)}
    return changed | {"Content-Type": HTTP_TYPE}, head + b"\r\n\r\n"


def read_records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of an inflated stream, in order."""
    while first := stream.readline():
        if not first.strip():
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {first[:40]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8").partition(":")
            headers[name.strip()] = value.strip()
        size = int(headers.pop("Content-Length"))
        block = stream.read(size)
        if len(block) != size:
            raise ValueError(f"record {headers.get('WARC-Record-ID')} ends after {len(block)} of {size} bytes")
        yield headers, block


def http_parts(block: bytes) -> tuple[int, bytes]:
    """(length of the full payload as the HTTP head has it, the payload in the block)."""
    head, _, body = block.partition(b"\r\n\r\n")
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length":
            return int(value), body
    return len(body), body


# --- archives written as one gzip stream -------------------------------------------


class Crawl:
    """An archive being written as a single gzip stream."""

    def __init__(self, folder: str):
        system, path = file_system(folder)
        system.create_dir(path, recursive=True)
        self.name = f"{uuid.uuid4().hex}.warc.gz"
        self.out = system.open_output_stream(f"{path}/{self.name}", compression=None)
        self.deflate = zlib.compressobj(level=6, wbits=_GZIP)
        self.size = self.records = 0

    def add(self, record: bytes) -> int:
        self.out.write(self.deflate.compress(record))
        self.size += len(record)
        self.records += 1
        return self.records - 1

    def full(self) -> bool:
        return self.size >= ARCHIVE_BYTES or self.records >= ARCHIVE_RECORDS

    def close(self) -> None:
        self.out.write(self.deflate.flush())
        self.out.close()


def write_crawl(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html"
) -> DataFrame:
    """Write the pages into archives under ``folder``; (archive, number, id, bytes, payload_key) per record."""
    own = columns_as(pages, id=id_col, url=url_col, payload=payload_col)
    own = own.select("id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("payload").cast("binary"), F.lit(b"")).alias("payload"))
    id_type = own.schema["id"].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crawl: Crawl | None = None
        for batch in batches:
            names, numbers, sizes, keys = [], [], [], []
            for page, url, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if crawl is None or crawl.full():
                    if crawl is not None:
                        crawl.close()
                    crawl = Crawl(folder)
                data = payload.as_buffer()
                names.append(crawl.name)
                numbers.append(crawl.add(response_record(page, url, data)))
                sizes.append(data.size)
                keys.append(hashlib.sha256(data).digest())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(numbers, pa.int32()), batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary())],
                ["archive", "number", "id", "bytes", "payload_key"],
            )
        if crawl is not None:
            crawl.close()

    written = own.mapInArrow(write, f"archive string, number int, id {id_type}, bytes long, payload_key binary")
    return stored(written, "crawl-records")


def revisits(records: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(archive, number, target) of the records that become revisits of the record ``target``."""
    large = records.where(F.col("bytes") >= least_bytes)
    groups = large.groupBy("payload_key").agg(F.max("id").alias("target"), F.count(F.lit(1)).alias("n")).where("n > 1")
    place = F.xxhash64("archive", "number")
    met = joined_spread(large, stored(groups, "payloads"), "payload_key", "n", place)
    return met.where(F.col("target").isNotNull() & ~F.col("id").eqNullSafe(F.col("target"))).select("archive", "number", "target")


# --- one member per record ----------------------------------------------------------


def normalise_archive(source: str, folder: str, name: str, repeats: dict[int, object]) -> tuple[str, str, int, int]:
    """Rewrite one archive; (archive, sidecar, records, bytes).  ``repeats`` has targets by record number."""
    system, path = file_system(folder)
    system.create_dir(path, recursive=True)
    there, place = file_system(source)
    mark = uuid.uuid4().hex
    archive, sidecar = f"{mark}.warc.gz", f"{mark}.idx"
    offset = number = 0
    try:
        with (
            there.open_input_stream(place, compression=None) as raw,
            gzip.GzipFile(fileobj=raw, mode="rb") as inflated,
            system.open_output_stream(f"{path}/{archive}", compression=None) as out,
            system.open_output_stream(f"{path}/{sidecar}", compression=None) as index,
        ):
            for headers, block in read_records(inflated):
                if number in repeats:
                    headers, block = as_revisit(headers, block, repeats[number])
                member = gzip.compress(record_bytes(headers, block), 6, mtime=0)
                out.write(member)
                entry = {
                    "offset": offset, "length": len(member), "record": headers["WARC-Record-ID"], "type": headers["WARC-Type"],
                    "digest": headers.get("WARC-Payload-Digest"), "uri": headers.get("WARC-Target-URI"),
                }
                index.write(json.dumps(entry).encode() + b"\n")
                offset += len(member)
                number += 1
    except (EOFError, zlib.error, gzip.BadGzipFile, ValueError) as error:
        raise ValueError(f"{name}, after {number} records: {error}") from error
    return archive, sidecar, number, offset


def normalise(archives: DataFrame, source: str, target: str, repeats: DataFrame) -> DataFrame:
    """Rewrite the ``archives`` (column archive) of folder ``source`` into ``target``.

    ``repeats`` has (archive, number, target).  One row per archive: archive, sidecar, records, bytes.
    """
    kind = repeats.schema["target"].dataType.simpleString()
    none = F.lit(None).cast(kind).alias("target")
    rows = archives.select("archive", F.lit(-1).alias("number"), none).unionByName(repeats)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of an archive stand together."""
        held: str | None = None
        found: dict[int, object] = {}

        def made() -> pa.RecordBatch:
            row = normalise_archive(f"{source}/{held}", target, held, found)
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["archive", "sidecar", "records", "bytes"])

        for batch in batches:
            for name, number, to in zip(*(batch.column(c).to_pylist() for c in ("archive", "number", "target"))):
                if name != held:
                    if held is not None:
                        yield made()
                    held, found = name, {}
                if number >= 0:
                    found[number] = to
        if held is not None:
            yield made()

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a few bytes a row, but much work: a stated number of partitions is not coalesced
    dealt = rows.repartition(tasks, "archive").sortWithinPartitions("archive")
    made = dealt.mapInArrow(rewrite, "archive string, sidecar string, records long, bytes long")
    return stored(made, "archives")


# --- reading back -------------------------------------------------------------------


def read_member(data: bytes) -> tuple[dict[str, str], bytes]:
    """The single record of a gzip member."""
    inflate = zlib.decompressobj(_GZIP)
    whole = inflate.decompress(data) + inflate.flush()
    if inflate.unused_data or not inflate.eof:
        raise ValueError("the offset index does not cut at members")
    start = whole.index(b"\r\n\r\n") + 4
    lines = (line.partition(":") for line in whole[: start - 4].decode("utf-8").split("\r\n")[1:])
    headers = {name.strip(): value.strip() for name, _, value in lines}
    return headers, whole[start : start + int(headers["Content-Length"])]


def read_archives(archives: DataFrame, folder: str, id_type: str = "long", payloads: bool = True) -> DataFrame:
    """Every record of the archives, read at its offset.

    id, url, record_type, payload_bytes, payload_digest, refers_to and, if asked for, the payload
    (null for a revisit).  A response whose payload does not have its digest raises ValueError.
    """
    schema = "id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary"
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = file_system(folder)
        table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
        for batch in batches:
            for name, sidecar in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with system.open_input_file(f"{path}/{name}") as archive, system.open_input_stream(f"{path}/{sidecar}", compression=None) as index:
                    rows, held = [], 0
                    for line in io.BufferedReader(index):
                        entry = json.loads(line)
                        archive.seek(entry["offset"])
                        headers, block = read_member(archive.read(entry["length"]))
                        size, payload = http_parts(block)
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        response = headers["WARC-Type"] == "response"
                        if headers["WARC-Record-ID"] != entry["record"] or response and (len(payload) != size or digest_of(payload) != digest):
                            raise ValueError(f"{name}: the record at {entry['offset']} is not what it is said to be")
                        target = headers.get("WARC-Refers-To")
                        rows.append((
                            page_of(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), headers["WARC-Type"], size, digest,
                            page_of(target) if target else None, payload if payloads and response else None,
                        ))
                        held += len(payload) if payloads else 0
                        if len(rows) >= 8192 or held >= 16 << 20:
                            yield table(rows)
                            rows, held = [], 0
                    if rows:
                        yield table(rows)

    tasks = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = archives.select("archive", "sidecar").repartition(tasks)
    found = spread.mapInArrow(read, schema)
    kept = [c for c in names if payloads or c != "payload"]
    return found.select(*[F.col(c).cast(id_type).alias(c) if c in ("id", "refers_to") else F.col(c) for c in kept])


def archived_pages(
    pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", payloads: bool = True
) -> DataFrame:
    """Pages written, normalised and read back: the columns of ``read_archives``."""
    spark = pages.sparkSession
    crawl, folder = scratch_path(spark, "crawl"), scratch_path(spark, "warc")
    records = write_crawl(pages, crawl, id_col, url_col, payload_col)
    made = normalise(records.select("archive").distinct(), crawl, folder, revisits(records, least_bytes))
    return read_archives(made, folder, records.schema["id"].dataType.simpleString(), payloads)
