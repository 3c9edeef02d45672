"""Seekable Zstandard bundles of WARC records.

Writing: each page becomes a WARC 1.1 record, a ``response`` (HTTP header and the html in UTF-8) or, when a page with an
equal payload and a smaller page_id exists, a ``revisit`` that refers to the least such page and holds the header only.
Records are gathered into independent Zstandard frames of about ``FRAME`` bytes; a bundle file ends with a skippable
frame whose seek table lists the compressed and plain size of every frame (the public seekable format). The index maps
record ids to (bundle, frame, offset and length within the plain frame).

Tasks write bundles straight to the shared folder under names of their own and return index rows; the index is stored
by Spark's committing writer, and only bundles that it names are ever read, so repeated or lost tasks do no harm. A task
holds one frame and one Arrow batch.

Reading: the index is dealt by frame; a task seeks to the frame through the table, unpacks it once and cuts out records.

Cases: null html is an empty payload; a null url is written as an empty target; of rows that repeat a page_id, those
with the payload's least id are all responses; a null page_id never is the one referred to; an empty table writes
nothing; columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import fresh_path, small_batches, store

FRAME = 1 << 20
BUNDLE = 64 << 20
LEVEL = 3
#: Fixed values of the seekable format: magic numbers of the skippable frame and of its footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "2020-01-01T00:00:00Z"
_INDEX = pa.schema([("record_id", pa.string()), ("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])
_RECORD = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
                     ("refers_to", pa.int64()), ("payload", pa.binary())])


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder named as Hadoop or as Arrow writes it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    try:
        return fs.FileSystem.from_uri(path)
    except pa.ArrowInvalid as error:
        raise ValueError(f"bundles are written through Arrow, which knows no folder like {path}: name one it knows "
                         "(a shared path, hdfs://, s3://, gs://, abfs://)") from error


class BundleWriter:
    """Writes frames and, on closing, the seek table."""

    def __init__(self, sink, frame_bytes: int = FRAME) -> None:
        self.sink, self.frame_bytes, self.size = sink, frame_bytes, 0
        self.pending, self.plain, self.table = [], 0, []
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)

    def add(self, record: bytes) -> tuple[int, int, int]:
        """Frame, offset within the plain frame, and length of a record."""
        if self.plain and self.plain + len(record) > self.frame_bytes:
            self.flush()
        place = (len(self.table), self.plain, len(record))
        self.pending.append(record)
        self.plain += len(record)
        return place

    def flush(self) -> None:
        if self.pending:
            packed = self.packer.compress(b"".join(self.pending))
            self.sink.write(packed)
            self.table.append((len(packed), self.plain))
            self.size += len(packed)
            self.pending, self.plain = [], 0

    def close(self) -> None:
        self.flush()
        body = b"".join(struct.pack("<II", *row) for row in self.table) + struct.pack("<IBI", len(self.table), 0, SEEKABLE)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        self.sink.close()


class BundleReader:
    """Reads single frames of a bundle through its seek table."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.size()
        source.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        row = 12 if flags & 0x80 else 8
        source.seek(size - 9 - n * row)
        sizes = [struct.unpack_from("<I", x)[0] for x in (source.read(row) for _ in range(n))]
        self.starts = [0]
        for s in sizes:
            self.starts.append(self.starts[-1] + s)

    def frame(self, k: int) -> bytes:
        self.source.seek(self.starts[k])
        return zstandard.ZstdDecompressor().decompress(self.source.read(self.starts[k + 1] - self.starts[k]))


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page_id(name: str | None) -> int | None:
    number = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.lstrip("-").isdigit() else None


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def write_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = "".join(c if c.isprintable() and c != " " else f"%{ord(c):02X}" for c in url or "")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}",
             f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest(payload)}",
             "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: {record_id(refers_to)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(data: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in data.decode().split("\r\n")[1:])}


def read_record(data: bytes) -> dict:
    """What a record says; a response's payload must have the digest that its header names."""
    head, _, rest = data.partition(b"\r\n\r\n")
    named = _headers(head)
    http, _, payload = rest[:int(named["content-length"])].partition(b"\r\n\r\n")
    sha, kind = named["warc-payload-digest"].removeprefix("sha1:"), named["warc-type"]
    if kind == "response" and digest(payload) != sha:
        raise ValueError(f"payload of {named['warc-record-id']} is damaged")
    return {"page_id": _page_id(named["warc-record-id"]), "payload_bytes": int(_headers(http)["content-length"]), "payload_digest": sha,
            "record_type": kind, "refers_to": _page_id(named.get("warc-refers-to")), "payload": payload if kind == "response" else None}


def mark_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``(page_id, url, html, refers_to)``: the least page with an equal payload of at least ``min_bytes`` bytes, if it is another."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", "html", F.when(F.length(payload) >= min_bytes, F.unhex(F.sha1(payload))).alias("_digest"))
    first = rows.groupBy("_digest").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter(
        "_n > 1 AND _digest IS NOT NULL").select(F.col("_digest").alias("_same"), "_first")
    met = rows.join(first, F.col("_digest") == F.col("_same"), "left")
    return met.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first")).alias("refers_to"))


def write_bundles(marked: DataFrame, folder: str, frame_bytes: int = FRAME, bundle_bytes: int = BUNDLE) -> DataFrame:
    """Write a record per row of ``marked(page_id, url, html, refers_to)``; the stored index of all records."""
    small_batches(marked.sparkSession)

    def run(batches):
        store_at, base = filesystem(folder)
        store_at.create_dir(base, recursive=True)
        writer, name = None, None
        for b in batches:
            rows = []
            for page_id, url, html, refers_to in zip(*(b.column(i) for i in range(4))):
                if writer is None:
                    name = f"{base}/{uuid.uuid4().hex}.warc.zst"
                    writer = BundleWriter(store_at.open_output_stream(name, compression=None), frame_bytes)
                number = page_id.as_py()
                frame, offset, length = writer.add(write_record(number, url.as_py(), (html.as_py() or "").encode("utf-8", "surrogatepass"),
                                                                refers_to.as_py()))
                rows.append({"record_id": record_id(number), "bundle": name, "frame": frame, "offset": offset, "length": length})
                if writer.size >= bundle_bytes:
                    writer.close()
                    writer = None
            yield pa.RecordBatch.from_pylist(rows, schema=_INDEX)
        if writer is not None:
            writer.close()

    return store(marked.select("page_id", "url", "html", "refers_to").mapInArrow(
        run, "record_id string, bundle string, frame int, offset long, length long"), "warc-index")


def read_bundles(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records that ``index`` names, read through seek tables; without ``payloads`` their texts are checked but left out."""
    # a number of partitions, as Spark would merge the few bytes of the index into one task that reads all bundles
    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = index.repartition(tasks, "bundle", "frame").sortWithinPartitions("bundle", "frame", "offset")

    def run(batches):
        store_at, _ = filesystem(folder)
        at, reader, number, plain = None, None, None, b""

        def records(b) -> Iterator[dict]:
            nonlocal at, reader, number, plain
            for bundle, frame, offset, length in zip(*(b.column(i).to_pylist() for i in range(1, 5))):
                if bundle != at:
                    if reader is not None:
                        reader.source.close()
                    at, reader, number = bundle, BundleReader(store_at.open_input_file(bundle)), None
                if frame != number:
                    number, plain = frame, reader.frame(frame)
                found = read_record(plain[offset:offset + length])
                yield found if payloads else found | {"payload": None}

        for b in batches:
            yield pa.RecordBatch.from_pylist(list(records(b)), schema=_RECORD)
        if reader is not None:
            reader.source.close()

    return dealt.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def archive(pages: DataFrame, min_bytes: int = 0) -> tuple[DataFrame, str]:
    """Write all of ``pages(page_id, url, html)``; the index and the folder of the bundles."""
    folder = fresh_path(pages.sparkSession, "warc")
    filesystem(folder)  # an unknown kind of folder is an error at once, not in a task
    return write_bundles(mark_revisits(pages, min_bytes), folder), folder
