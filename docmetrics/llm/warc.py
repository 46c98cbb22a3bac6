"""WARC files: writing pages as records, and a sequential reader.

Reader (the method): a .warc.gz holds one gzip member per record. The reader inflates member after member
with an incremental zlib object from a stream of small chunks, so it holds one record at a time; a record
is its header lines, then exactly Content-Length bytes, then two line ends; the block digest, and for records that
hold their payload the payload digest, are computed and compared where the record gives them in an algorithm known here
(SHA-1, SHA-256, MD5; base 32 or hex). A damaged or cut record ends its file and is reported with status ``damaged``. Records of
other writers are read too: each gives a row with its type and record id, and null where it says nothing (a warcinfo
or request record has no payload, an id that is no page of this writer no page_id).

Writer: each task writes archives under the given shared folder (by pyarrow's file systems, so a URI of
any of them), starts a new one after ``archive_bytes``, and returns what it wrote; that list is stored, and
only listed archives are read, so what a lost or repeated task attempt left behind is never read. Of equal
payloads of at least ``least`` bytes only the page with the largest id is written in full; the others are
revisit records that name it. The choice is an aggregation on the payload's SHA-256; payloads are shuffled
once, by page id, never by payload, so copies of one page don't meet in one task.

Defined results: a null or empty html is an empty payload; a null url has no target line; a null page id is
written in full and reads back as null; of repeated rows of one page id and payload all are treated alike;
an empty table gives no archive and an empty result. Further columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmetrics.llm.common import materialize
from docmetrics.session import scratch_dir

ARCHIVE_BYTES = 32 << 20
CHUNK = 1 << 16
LEAST_REVISIT = 1000
DATE = "2024-01-01T00:00:00Z"
# Header names and the profile of the WARC format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("9d3c1f6e-52a7-4b1e-8000-000000000000").int >> 64 << 64


def record_id(page_id: int | None) -> str:
    """A page's record id: the page id is its low 64 bits. Null pages get a random id."""
    return f"<urn:uuid:{uuid.uuid4() if page_id is None else uuid.UUID(int=_SPACE | (page_id & (2**64 - 1)))}>"


def page_of(record: str) -> int | None:
    """The page of a record id of this writer; None for any other id."""
    try:
        n = uuid.UUID(record[10:-1]).int if record.startswith("<urn:uuid:") else 0
    except ValueError:
        return None
    if n >> 64 << 64 != _SPACE:
        return None
    low = n & (2**64 - 1)
    return low - 2**64 if low >> 63 else low


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def digest_bytes(value: str) -> tuple[str, bytes] | None:
    """(algorithm, digest) of a digest header; None if the algorithm or the form is not known."""
    name, _, text = value.partition(":")
    name = name.strip().lower().replace("-", "")
    size = {"sha1": 20, "sha256": 32, "md5": 16}.get(name)
    if size is None:
        return None
    text = text.strip()
    try:
        raw = bytes.fromhex(text) if len(text) == 2 * size else base64.b32decode(text.upper() + "=" * (-len(text) % 8))
    except ValueError:
        return None
    return (name, raw) if len(raw) == size else None


def agrees(value: str | None, data: bytes) -> bool:
    """Whether data has the digest of the header; a missing or unknown one is not looked at."""
    known = digest_bytes(value) if value else None
    return known is None or hashlib.new(known[0], data, usedforsecurity=False).digest() == known[1]


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record, not compressed. With ``refers_to`` it is a revisit: the HTTP head without the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines += [f"WARC-Payload-Digest: {_sha1(payload)}", f"WARC-Block-Digest: {_sha1(block)}",
              "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Damaged(ValueError):
    pass


def members(stream: BinaryIO) -> Iterator[Iterator[bytes]]:
    """For each gzip member of the stream, its inflated chunks."""
    rest = b""

    def inflate() -> Iterator[bytes]:
        nonlocal rest
        z = zlib.decompressobj(31)
        while not z.eof:
            data = z.unconsumed_tail or rest or stream.read(CHUNK)
            rest = b""
            if not data:
                raise Damaged("the file ends inside a record")
            try:
                out = z.decompress(data, CHUNK)
            except zlib.error as e:
                raise Damaged(str(e)) from e
            if out:
                yield out
        rest = z.unused_data

    while True:
        rest = rest or stream.read(CHUNK)
        if not rest:
            return
        yield inflate()


def read_records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of every record; Damaged where framing or a digest is wrong."""
    for chunks in members(stream):
        data = bytearray()
        while (end := data.find(b"\r\n\r\n")) < 0:
            piece = next(chunks, None)
            if piece is None:
                raise Damaged("a record without a header")
            data += piece
        lines = bytes(data[:end]).decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise Damaged("not a WARC record")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        try:
            size = int(headers["content-length"])
        except (KeyError, ValueError) as e:
            raise Damaged("a record without a length") from e
        del data[:end + 4]
        for piece in chunks:  # to the member's end, so that the next one starts at its own head
            data += piece
            if len(data) > size + 4:
                raise Damaged("a record longer than its length")
        if data[size:] != b"\r\n\r\n":
            raise Damaged("a record shorter than its length")
        block = bytes(data[:size])
        if not agrees(headers.get("warc-block-digest"), block):
            raise Damaged("block digest")
        yield headers, block


def page_row(headers: dict[str, str], block: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, record_id) of any record, None where it says nothing.

    The payload of a response is the body of its HTTP message, or the block if it is no HTTP; that of a resource or conversion
    the block. A revisit has the size and digest that its headers give."""
    kind, name, refers = headers.get("warc-type") or None, headers.get("warc-record-id"), headers.get("warc-refers-to")
    given = headers.get("warc-payload-digest")
    http = headers.get("content-type", "").replace(" ", "").lower().startswith("application/http")
    head, _, body = block.partition(b"\r\n\r\n")
    size = digest = None
    if kind in ("response", "resource", "conversion"):
        payload = body if http and kind == "response" else block
        if not agrees(given, payload):
            raise Damaged("payload digest")
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
    elif kind == "revisit":
        known = digest_bytes(given) if given else None
        digest = known[1].hex() if known and known[0] == "sha1" else None
        if http:
            lines = (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])
            length = {k.strip().lower(): v.strip() for k, _, v in lines}.get("content-length", "")
            size = int(length) if length.isascii() and length.isdigit() else None
    return page_of(name) if name else None, size, digest, kind, page_of(refers) if refers else None, name


def revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(page_id, key, refers_to): pages whose payload is written in full by the page of a larger id."""
    facts = pages.where(F.col("page_id").isNotNull() & (F.octet_length("html") >= least)).select("page_id", F.sha2("html", 256).alias("key"))
    keep = facts.groupBy("key").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("lo")).where("lo < refers_to").drop("lo")
    return facts.join(keep, "key").where("page_id < refers_to").select("page_id", "key", "refers_to").distinct()


def write_warc(pages: DataFrame, folder: str, least: int = LEAST_REVISIT, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(page_id, url, html) -> the stored list of archives (file, records, bytes)."""
    rows = (pages.withColumn("key", F.sha2("html", 256)).join(revisits(pages, least), ["page_id", "key"], "left")
            .select("page_id", "url", F.encode("html", "UTF-8").alias("payload"), "refers_to"))

    def write(batches):
        store, base = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        out, name, records, size = None, "", 0, 0
        for batch in batches:
            done = []
            for page_id, url, payload, refers in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if out is None:
                    store.create_dir(base, recursive=True)
                    name, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                member = gzip_member(record(page_id, url, payload or b"", refers))
                out.write(member)
                records, size = records + 1, size + len(member)
                if size >= archive_bytes:
                    out.close()
                    done.append((name, records, size))
                    out = None
            if done:
                yield pa.record_batch([pa.array(c) for c in zip(*done)], names=["file", "records", "bytes"])
        if out is not None:
            out.close()
            yield pa.record_batch([pa.array([name]), pa.array([records]), pa.array([size])], names=["file", "records", "bytes"])

    return materialize(rows.mapInArrow(write, "file string, records long, bytes long"), "warc_list")


def read_warc(archives: DataFrame, folder: str) -> DataFrame:
    """-> a row per record of the listed archives; status is ``ok``, or ``damaged`` at the end of a bad file."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "status", "file"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def read(batches):
        store, base = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows = []
                with store.open_input_stream(f"{base}/{name}", compression=None, buffer_size=0) as stream:
                    try:
                        for headers, block in read_records(stream):
                            rows.append((*page_row(headers, block), "ok", name))
                    except Damaged as e:
                        rows.append((None, None, None, None, None, None, f"damaged: {e}", name))
                for at in range(0, len(rows), 10_000):
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows[at:at + 10_000]), kinds)], names=names)

    width = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("file").repartition(width, "file").mapInArrow(
        read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, status string, file string")


def warc_round_trip(pages: DataFrame, page_col: str = "page_id", url_col: str = "url", html_col: str = "html", folder: str | None = None,
                    archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the pages to archives under ``folder`` (a fresh shared one by default) and read them back."""
    folder = folder or scratch_dir(pages.sparkSession, "warc")
    pages = pages.select(F.col(page_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return read_warc(write_warc(pages, folder, archive_bytes=archive_bytes), folder)
