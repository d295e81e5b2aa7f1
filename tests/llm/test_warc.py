import hashlib
import struct

import pytest
import zstandard

from dendroscan.llm import common, warc


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string, row string")


BIG = "é" * 600


def test_round_trip(spark, tmp_path):
    rows = [(1, "http://a/\r\nX: y", BIG, "d", "r"), (2, None, BIG, None, None), (3, "http://c", BIG[:-1], "d", "r"), (4, "u", None, "d", "r"), (5, "u", "", "d", "r"), (None, None, BIG, None, None), (6, "u", "short", None, None), (7, "u", "short", None, None), (8, "u", "x" * 3_000_000, None, None), (2, None, BIG, None, None)]
    index = warc.write(pages(spark, rows), str(tmp_path / "out"), frame_bytes=4000)
    assert index.count() == len(rows)
    got = [(r.id, r.type, r.digest, r.refers_to, r.payload_bytes, None if r.payload is None else bytes(r.payload)) for r in warc.read(index).collect()]
    want = []
    for i, _, html, _, _ in rows:
        data = (html or "").encode()
        revisit = html == BIG and i != 2
        want.append((None if i is None else str(i), "revisit" if revisit else "response", hashlib.sha1(data).hexdigest(), "2" if revisit else None, len(data), None if revisit else data))
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_bundle_is_a_seekable_file(spark, tmp_path):
    index = warc.write(pages(spark, [(i, f"http://x/{i}", str(i) * 500, None, None) for i in range(40)]).coalesce(1), str(tmp_path / "out"), frame_bytes=3000)
    rows = index.orderBy("frame", "offset").collect()
    path = rows[0].bundle
    raw = open(path, "rb").read()
    n, flags, magic = struct.unpack("<IBI", raw[-9:])
    assert magic == warc.SEEKABLE and n == rows[-1].frame + 1 > 5 and flags == 0
    # any Zstandard reader gets the records by reading on
    text = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
    assert text.count(b"WARC/1.1\r\n") == 40
    reader = warc.BundleReader(warc.open_folder(path)[0].open_input_file(path))
    r = rows[17]
    assert warc.parse(reader.frame(r.frame)[r.offset : r.offset + r.length])["id"] == r.id


def test_broken_payload_is_noticed():
    raw = warc.record("1", "u", b"abc", hashlib.sha1(b"abc").hexdigest(), None, False, "2000-01-01T00:00:00Z")
    assert warc.parse(raw)["payload"] == b"abc"
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"abc", b"abd"))


def test_frequent_payloads(spark, tmp_path, monkeypatch):
    """More digests than are broadcast: the most frequent are, the others are shuffled."""
    rows = [(i, f"http://x/{i}", "hot" * 500 if i % 2 else f"{i % 7:04}" * 300, None, None) for i in range(120)] + [(500, "u", "single" * 300, None, None)]
    monkeypatch.setattr(warc, "met", lambda *a, **b: common.met(*a, **b, most=1, heavy=2))
    planned = warc.plan(pages(spark, rows)).collect()
    last = {}
    for i, _, html, _, _ in rows:
        last[html] = max(i, last.get(html, 0))
    assert len(planned) == 121 and all(r.refers_to == (None if last[rows[r.id][2] if r.id < 120 else rows[-1][2]] == r.id else last[rows[r.id][2]]) for r in planned)


def test_reading_has_many_tasks(spark, tmp_path):
    index = warc.write(pages(spark, [(i, None, str(i) * 300, None, None) for i in range(60)]), str(tmp_path / "out"), frame_bytes=3000)
    assert warc.read(index).rdd.getNumPartitions() >= 4 and warc.read(index, task_bytes=5000).rdd.getNumPartitions() >= 10


def test_empty(spark, tmp_path):
    assert warc.read(warc.write(pages(spark, []), str(tmp_path / "out"))).count() == 0
