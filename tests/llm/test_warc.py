import hashlib
import struct

import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import warc


@given(st.lists(st.tuples(st.binary(max_size=400), st.text(max_size=20)), max_size=20))
@settings(max_examples=40, deadline=None)
def test_round_trip(tmp_path_factory, records):
    path = str(tmp_path_factory.mktemp("w") / "a.warc.zst")
    n, _ = warc.write_archive(path, (warc.encode(i, url, payload, None) for i, (payload, url) in enumerate(records)))
    back = list(warc.read_archive(path))
    assert n == len(records) == len(back)
    assert [(r.page_id, r.payload, r.payload_digest) for r in back] == [(i, p, hashlib.sha256(p).hexdigest()) for i, (p, _) in enumerate(records)]


def test_frames_and_dictionary(tmp_path):
    path = tmp_path / "a.warc.zst"
    warc.write_archive(str(path), (warc.encode(i, "http://x/", b"body %d" % i * 30, None if i else None) for i in range(50)))
    raw = path.read_bytes()
    magic, n = struct.unpack("<II", raw[:8])
    assert magic == warc.SKIPPABLE
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8 : 8 + n]))
    frame = reader.decompressobj()
    first = frame.decompress(raw[8 + n :])
    assert first.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and frame.eof and frame.unused_data.startswith(warc.FRAME)


def test_bad_archives(tmp_path):
    path = tmp_path / "a.warc.zst"
    good = warc.encode(1, "u", b"x" * 200, None)
    for bad in (good.replace(b"WARC/1.1", b"WARC/9.9"), good.replace(b"x" * 200, b"x" * 199), good.replace(b"xxxx", b"yyyy", 1), good.replace(b"WARC-Date", b"X-Date"), good[:-2], good.replace(b"Type: response", b"Type: revisit", 1)):
        with pytest.raises(ValueError, match="record"):
            warc.decode(bad)
    warc.write_archive(str(path), iter([good]))
    raw = path.read_bytes()
    for bad in (raw[:-5], raw[:40], b"\x00" + raw, raw + b"junk"):
        path.write_bytes(bad)
        with pytest.raises(ValueError):
            list(warc.read_archive(str(path)))


def test_pages(spark, tmp_path):
    same, short = "same " * 40, "short"
    data = [(5, "http://a/ b\n", same), (3, None, same), (9, "u", same), (1, "u", short), (2, "u", short), (4, "u", None), (6, "u", ""), (7, "u", "é" * 60), (8, "u", "é" * 60), (3, "u", same), (10, "u", "<p>" * 30_000)]
    pages = spark.createDataFrame([(i, u, h, "x") for i, u, h in data], "page_id long, url string, html string, payload_digest string").repartition(3)
    (tmp_path / "w").mkdir()
    rows = warc.read(warc.write(pages, str(tmp_path / "w"), archive_bytes=2000)).collect()
    assert len(rows) == len(data)
    for r in rows:
        html = next(h for i, _, h in data if i == r.page_id) or ""
        payload = html.encode()
        assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha256(payload).hexdigest())
        first = min(i for i, _, h in data if (h or "") == html)
        assert (r.record_type, r.refers_to) == (("revisit", first) if len(payload) >= 100 and first < r.page_id else ("response", None))
        assert r.payload == (payload if r.record_type == "response" else None)
    assert warc.read(warc.write(pages.limit(0), str(tmp_path / "w"))).count() == 0


def test_null_ids_and_very_long_pages(spark, tmp_path):
    long = "<p>" + "x y " * 1_000_000
    rows = [(None, "u", "a" * 200), (3, "u", "a" * 200), (2, None, "a" * 200), (None, None, None), (None, "v", "b" * 150), (None, "v", "b" * 150), (9, "w", long), (8, "w", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    (tmp_path / "w").mkdir()
    got = [(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read(warc.write(pages, f"file://{tmp_path}/w")).collect()]
    n = len(long)
    want = [(None, "revisit", 2, 200), (3, "revisit", 2, 200), (2, "response", None, 200), (None, "response", None, 0), (None, "response", None, 150), (None, "response", None, 150), (9, "revisit", 8, n), (8, "response", None, n)]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_stores_that_spark_names():
    assert warc._file_system("file:///tmp/x")[1] == "/tmp/x"
    assert warc._file_system("s3a://bucket/a/b")[1] == "bucket/a/b"
