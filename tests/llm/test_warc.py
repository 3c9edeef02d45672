import base64
import hashlib
import struct

import pytest
import zstandard

from slotwise.llm import warc
from tests.llm.conftest import clash

SCHEMA = "page_id long, url string, html string"
ROWS = [(5, "http://a", "same"), (3, None, "same"), (9, "http://a b\r\nc", "same"), (4, "http://x", None), (2, "u", ""), (7, "u", "é" * 70_000),
        (7, "u", "é" * 70_000), (None, "n", "same"), (None, None, None), (11, "u", "WARC/1.1\r\n\r\n"), (12, "u", "\r\n\r\nx")]


def sha32(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.mark.parametrize("frame_bytes", [100, 1 << 20])
def test_round_trip(spark, tmp_path, frame_bytes):
    pages = clash(spark.createDataFrame(ROWS, SCHEMA))
    index = warc.write_bundles(warc.mark_revisits(pages), str(tmp_path), frame_bytes=frame_bytes, bundle_bytes=1000)
    assert index.count() == len(ROWS)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload) for r in
                  warc.read_bundles(index, str(tmp_path)).collect()), key=str)
    least = {"same": 3, "": 2}
    want = []
    for page, _, html in ROWS:
        first = least.get(html or "")
        other = first if first is not None and page != first else None
        data = (html or "").encode()
        want.append((page, len(data), sha32(html), "revisit" if other is not None else "response", other,
                     None if other is not None else bytearray(data)))
    assert got == sorted(want, key=str)


def test_small_payloads_stay_responses(spark, tmp_path):
    marked = warc.mark_revisits(spark.createDataFrame(ROWS, SCHEMA), min_bytes=5)
    assert marked.filter("refers_to IS NOT NULL").count() == 0


def test_bundle_is_plain_zstandard_with_a_seek_table(spark, tmp_path):
    warc.write_bundles(warc.mark_revisits(spark.createDataFrame(ROWS, SCHEMA).coalesce(1)), str(tmp_path), frame_bytes=64)
    for path in tmp_path.glob("*.warc.zst"):
        data = path.read_bytes()
        n, _, magic = struct.unpack("<IBI", data[-9:])
        assert magic == warc.SEEKABLE
        sizes = struct.unpack(f"<{2 * n}I", data[-9 - 8 * n:-9])
        plain = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
        assert len(plain) == sum(sizes[1::2]) and plain.startswith(b"WARC/1.1\r\n")


def test_damaged_payload_is_noticed():
    record = warc.write_record(1, "u", b"payload", None)
    assert warc.read_record(record)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.read_record(record.replace(b"\r\n\r\npayload", b"\r\n\r\npayl0ad"))


def test_empty_table(spark, tmp_path):
    index = warc.write_bundles(warc.mark_revisits(spark.createDataFrame([], SCHEMA)), str(tmp_path))
    assert index.count() == 0 and warc.read_bundles(index, str(tmp_path)).count() == 0
