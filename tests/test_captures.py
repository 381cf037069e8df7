"""Captures read in ranges against the plain reader."""

import random
import struct

import pytest

from trafficlens.sources import captures, frames

HEAD = {order: struct.pack(order + "IHHIIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1) for order in "<>"}


def record(order, second, body):
    return struct.pack(order + "IIII", second, 17, len(body), len(body) + 3) + body


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng = random.Random(9)
    path = tmp_path_factory.mktemp("captures with space")
    for order, name in (("<", "little"), (">", "big")):
        plain = [record(order, 1_700_000_000 + n, rng.randbytes(rng.randrange(0, 400))) for n in range(300)]
        # packets that hold whole chains of records, and one longer than many ranges
        inner = [record(order, 1_700_000_000 + n, b"".join(record(order, 1_700_000_000, b"x" * 20) for _ in range(12))) for n in range(60)]
        mixed = plain[:100] + inner + plain[100:200] + [record(order, 1_700_000_500, bytes(30_000))] + plain[200:]
        (path / f"{name}.pcap").write_bytes(HEAD[order] + b"".join(mixed))
        (path / f"{name}-cut.pcap").write_bytes((HEAD[order] + b"".join(mixed))[:-20])
        (path / f"{name}-broken.pcap").write_bytes(HEAD[order] + b"".join(plain[:50]) + struct.pack(order + "IIII", 1, 1, 1 << 31, 5) + b"".join(plain[50:]))
    (path / "empty.pcap").write_bytes(b"")
    (path / "head.pcap").write_bytes(HEAD["<"])
    (path / "bad.pcap").write_bytes(b"nothing to see here, move on please" * 50)
    (path / "zeros.pcap").write_bytes(HEAD["<"] + bytes(5000))
    return str(path)


@pytest.mark.parametrize("part_bytes", [20, 777, 4096, 1 << 26])
def test_ranges_equal_the_plain_reader(spark, folder, part_bytes):
    def rows(df):
        return sorted((r.path, r.frame_no, r.ts_us, r.link_type, r.orig_len, bytes(r.frame)) for r in df.collect())

    expected = rows(frames.read_pcap(spark, folder))
    assert len(expected) > 1500
    assert rows(captures.read_large_pcap(spark, folder, part_bytes)) == expected


def test_many_ranges_hold_frames(spark, folder):
    files = spark.read.format("binaryFile").option("pathGlobFilter", "little.pcap").load(folder).select("path", "length")
    ranges = captures.settled_ranges(files, 4096).orderBy("part").collect()
    assert len(ranges) > 15 and [r.number for r in ranges] == [sum(x["count"] for x in ranges[:i]) for i in range(len(ranges))]


def test_wrong_places_are_found_by_the_check(spark, folder):
    """Some range does begin inside a packet that holds records, so the check is what mends it."""
    capture = captures.Capture(f"{folder}/little.pcap", len(open(f"{folder}/little.pcap", "rb").read()))
    right, at = set(), frames.FILE_HEADER
    for at, _ in capture.frames(frames.FILE_HEADER, capture.length):
        right.add(at)
    assert any(capture.guess(b, b + 512) not in right | {-1} for b in range(512, capture.length, 512))


def test_windows_smaller_than_packets(spark, folder, monkeypatch):
    monkeypatch.setattr(captures, "WINDOW_BYTES", 64)
    raw = open(f"{folder}/big.pcap", "rb").read()
    capture = captures.Capture(f"{folder}/big.pcap", len(raw))
    bodies = [capture.bytes(at + 16, head[2]) for at, head in capture.frames(24, len(raw)) if head]
    assert sum(map(len, bodies)) + 16 * len(bodies) + 24 == len(raw) and bodies[-1] == raw[-len(bodies[-1]):]
