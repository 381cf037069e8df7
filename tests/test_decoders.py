import socket
import struct

import numpy as np
from pyspark.sql import functions as F

from trafficlens import schemas
from trafficlens.plans import encoded
from trafficlens.sources import datagrams as d
from trafficlens.sources import frames as fr

SCHEMA = "exporter_ip string, tick bigint, seq bigint, payload binary"


def ip4(text):
    return socket.inet_aton(text)


def ipv4(src, dst, proto, body, flags=0, length=None):
    return struct.pack("!BBHHHBBH4s4s", 0x45, 0, length or 20 + len(body), 0, flags, 64, proto, 0, ip4(src), ip4(dst)) + body


def ipv6(src, dst, nxt, body):
    return struct.pack("!IHBB", 6 << 28, len(body), nxt, 64) + socket.inet_pton(socket.AF_INET6, src) + \
        socket.inet_pton(socket.AF_INET6, dst) + body


def tcp(sport, dport, flags):
    return struct.pack("!HHIIBBHHH", sport, dport, 0, 0, 0x50, flags, 0, 0, 0)


def udp(sport, dport, data=b""):
    return struct.pack("!HHHH", sport, dport, 8 + len(data), 0) + data


def ether(packet, kind=0x0800, tags=()):
    return b"\0" * 12 + b"".join(struct.pack("!HH", t, 1) for t in tags) + struct.pack("!H", kind) + packet


def v5(records, count=None, sampling=0):
    head = struct.pack("!HHIIIIBBH", 5, len(records) if count is None else count, 0, 0, 0, 0, 0, 0, sampling)
    body = b"".join(ip4(s) + ip4(t) + b"\0" * 8 + struct.pack("!II", p, o) + b"\0" * 8 + struct.pack("!HH", sp, dp)
                    + bytes([0, fl, pr]) + b"\0" * 9 for s, t, p, o, sp, dp, fl, pr in records)
    return head + body


REC = ("1.2.3.4", "5.6.7.8", 10, 5000, 1000, 80, 2, 6)


def frame_of(spark, payloads, ticks=None):
    rows = [("9.9.9.9", (ticks or range(len(payloads)))[i], i, bytearray(p)) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, SCHEMA)


def test_netflow_v5_edges(spark):
    rows = frame_of(spark, [v5([REC, REC]), v5([REC], sampling=0x4064), v5([REC], count=5), v5([REC])[:60], v5([]), b"",
                            b"\0\x09" + v5([REC])[2:]])
    got = d.decode_netflow_v5(rows).orderBy("seq", "record_no").collect()
    assert [(r.seq, r.packets, r.octets, r.sample_rate) for r in got] == [
        (0, 10, 5000, 1), (0, 10, 5000, 1), (1, 1000, 500000, 100), (2, 10, 5000, 1)]
    assert (got[0].src_ip, got[0].dst_ip, got[0].src_port, got[0].dst_port, got[0].tcp_flags, got[0].protocol) == (
        "1.2.3.4", "5.6.7.8", 1000, 80, 2, 6)


def sflow(samples, address=1):
    agent = ip4("9.9.9.9") if address == 1 else b"\0" * 16
    return struct.pack("!II", 5, address) + agent + struct.pack("!IIII", 0, 0, 0, len(samples)) + b"".join(samples)


def sample(frame, rate, size, expanded=False):
    header = struct.pack("!IIII", 1, size, 0, len(frame)) + frame + b"\0" * (-len(frame) % 4)
    record = struct.pack("!II", 1, len(header)) + header
    body = struct.pack("!IIII", 0, 0, 0, rate) + b"\0" * 24 + struct.pack("!I", 1) + record if expanded else \
        struct.pack("!III", 0, 0, rate) + b"\0" * 16 + struct.pack("!I", 1) + record
    return struct.pack("!II", 3 if expanded else 1, len(body)) + body


def test_sflow_shapes(spark):
    four = ether(ipv4("1.1.1.1", "2.2.2.2", 6, tcp(1, 80, 2)))
    tagged = ether(ipv4("1.1.1.1", "2.2.2.3", 17, udp(53, 9)), tags=(0x8100,))
    six = ether(ipv6("2001:db8::1", "2001:db8:0:1::", 17, udp(5, 6)), 0x86DD)
    payload = sflow([sample(four, 1000, 64), struct.pack("!II", 2, 4) + b"\0" * 4, sample(tagged, 0, 100, True), sample(six, 7, 80)])
    got = d.decode_sflow_v5(frame_of(spark, [payload, sflow([]), sflow([sample(four, 5, 9)], 2), payload[:20]])) \
        .orderBy("seq", "record_no").collect()
    assert [(r.seq, r.src_ip, r.dst_ip, r.dst_port, r.packets, r.octets, r.tcp_flags) for r in got] == [
        (0, "1.1.1.1", "2.2.2.2", 80, 1000, 64000, 2), (0, "1.1.1.1", "2.2.2.3", 9, 1, 100, 0),
        (0, "2001:db8::1", "2001:db8:0:1::", 6, 7, 560, 0), (2, "1.1.1.1", "2.2.2.2", 80, 5, 45, 2)]


def test_sflow_tags_and_extension_headers(spark):
    double = ether(ipv4("1.1.1.1", "2.2.2.2", 6, tcp(1, 80, 2)), tags=(0x88A8, 0x8100))
    deep = ether(ipv6("2001:db8::1", "2001:db8::2", 0, b"\x2b\0" + b"\0" * 6 + b"\x11\1" + b"\0" * 14 + udp(5, 53)), 0x86DD, tags=(0x8100,))
    cut = ether(b"", tags=(0x8100, 0x8100))[:-4]  # ends inside its second tag
    options = ether(b"\x47" + ipv4("3.3.3.3", "4.4.4.4", 17, b"\1" * 8 + udp(7, 9))[1:])
    got = d.decode_sflow_v5(frame_of(spark, [sflow([sample(f, 10, 100) for f in (double, deep, cut, options)]), sflow([sample(cut, 1, 1)])])).orderBy("record_no").collect()
    assert [(r.record_no, r.src_ip, r.protocol, r.src_port, r.dst_port, r.tcp_flags, r.packets) for r in got] == [
        (0, "1.1.1.1", 6, 1, 80, 2, 10), (1, "2001:db8::1", 17, 5, 53, 0, 10), (2, "3.3.3.3", 17, 7, 9, 0, 10)]


FIELDS = ((8, 4), (12, 4), (7, 2), (11, 2), (4, 1), (6, 1), (2, 4), (1, 4))


def data_record(packets=10):
    return ip4("1.2.3.4") + ip4("5.6.7.8") + struct.pack("!HHBBII", 1000, 80, 6, 2, packets, 5000)


def v9(*sets, count=None):
    body = b"".join(struct.pack("!HH", i, len(b) + 4) + b for i, b in sets)
    return struct.pack("!HHIIII", 9, count or len(sets), 0, 0, 0, 7) + body


def ipfix(*sets):
    body = b"".join(struct.pack("!HH", i, len(b) + 4) + b for i, b in sets)
    return struct.pack("!HHIII", 10, 16 + len(body), 0, 0, 7) + body


def template(tid, fields):
    return struct.pack("!HH", tid, len(fields)) + b"".join(struct.pack("!HH", *f) for f in fields)


OPTIONS = (1, struct.pack("!HHHHHHH", 300, 4, 4, 1, 4, 34, 4))


def decoded(spark, payloads, ticks=None, override=0):
    rows = d.decode_datagrams(frame_of(spark, payloads, ticks), override)
    return [(r.seq, r.packets, r.octets, r.sample_rate) for r in rows.orderBy("seq", "record_no").collect()]


def test_templates_apply_forward_only_and_expire(spark):
    data, definition = (256, data_record() + data_record(0) + b"\0\0"), (0, template(256, FIELDS))
    got = decoded(spark, [v9(data), v9(definition), v9(data), v9(data), v9((257, data_record()))], [0, 1, 2, 3000, 9000])
    assert got == [(2, 10, 5000, 1), (2, 1, 5000, 1), (3, 10, 5000, 1), (3, 1, 5000, 1)]
    assert decoded(spark, [v9(definition, data), v9(data)], [0, 3700]) == [(0, 10, 5000, 1), (0, 1, 5000, 1)]


def test_sampling_announced_or_overridden(spark):
    definition, data = (0, template(256, FIELDS)), (256, data_record())
    announced = v9(OPTIONS, (300, struct.pack("!II", 1, 100)))
    assert decoded(spark, [v9(definition, data), announced, v9(data), v5([REC], sampling=5)]) == [
        (0, 10, 5000, 1), (2, 1000, 500000, 100), (3, 50, 25000, 5)]
    assert decoded(spark, [v9(definition, data)], override=2048) == [(0, 20480, 10240000, 2048)]


def test_ipfix_vendor_fields_and_oversized_templates(spark):
    vendor = struct.pack("!HH", 256, 3) + struct.pack("!HHI", 0x8000 | 8, 4, 99) + struct.pack("!HHHH", 8, 4, 2, 8)
    payloads = [ipfix((2, vendor)), ipfix((256, b"\xff" * 4 + ip4("3.3.3.3") + struct.pack("!Q", 77)))]
    rows = d.decode_datagrams(frame_of(spark, payloads)).collect()
    assert [(r.src_ip, r.dst_ip, r.packets) for r in rows] == [("3.3.3.3", "", 77)]
    cut = d.template_sets(d.route_datagrams(frame_of(spark, [v9((0, b"\1\0")), b"\0\x09", v9() + b"\0\0\0\1"])))
    assert d.extract_templates(cut).count() == 0


def test_nothing_is_capped(spark):
    wide = tuple((1000, 1) for _ in range(192)) + FIELDS
    record = b"\7" * 192 + data_record()
    definition = (0, template(256, wide) + template(257, FIELDS))
    assert decoded(spark, [v9(definition, (256, record), (257, data_record(3)))]) == [(0, 10, 5000, 1), (0, 3, 5000, 1)]
    many = v9((0, template(256, FIELDS)), *[(256, data_record(k + 1)) for k in range(150)])
    assert [r[1] for r in sorted(decoded(spark, [many]))] == list(range(1, 151))
    rows = d.decode_netflow_v5(frame_of(spark, [v5([REC] * 100)]))
    assert [r.record_no for r in rows.orderBy("record_no").collect()] == list(range(100))
    four = ether(ipv4("1.1.1.1", "2.2.2.2", 6, tcp(1, 80, 2)))
    rows = d.decode_sflow_v5(frame_of(spark, [sflow([sample(four, k + 1, 64) for k in range(300)])]))
    assert [r.packets for r in rows.orderBy("record_no").collect()] == list(range(1, 301))
    largest = struct.pack("!HH", 256, 2) + struct.pack("!HHHH", 8, 4, 2, 8)
    rows = d.decode_datagrams(frame_of(spark, [ipfix((2, largest)), ipfix((256, ip4("3.3.3.3") + b"\xff" * 8))])).collect()
    assert [r.packets for r in rows] == [2**63 - 1]


def packets(spark, raw, **options):
    df = spark.createDataFrame([(i, 1, bytearray(b)) for i, b in enumerate(raw)], "n bigint, link_type bigint, frame binary")
    return fr.decode_frames(df, **options).orderBy("n").collect()


def test_frames(spark):
    hop = bytes([6, 0]) + b"\0" * 6
    got = packets(spark, [
        ether(ipv4("1.1.1.1", "2.2.2.2", 6, tcp(5, 80, 0x12))), ether(ipv4("1.1.1.1", "2.2.2.2", 17, udp(5, 53), 0x2000)),
        ether(ipv4("1.1.1.1", "2.2.2.2", 1, b"\0" * 8), tags=(0x88A8, 0x8100)), ether(b"\0" * 40, 0x0806),
        ether(ipv6("::1", "fe80::2", 0, hop + tcp(1, 443, 2)), 0x86DD), ether(b"\x45" + b"\0" * 5), b"\0" * 10,
        ether(b"\x65" + b"\0" * 30), ether(ipv4("1.1.1.1", "2.2.2.2", 6, b"\0\5\0\x50"))])
    assert [(r.n, r.dst_ip, r.protocol, r.dst_port, r.tcp_flags, r.is_fragment, r.pkt_len) for r in got] == [
        (0, "2.2.2.2", 6, 80, 0x12, False, 40), (1, "2.2.2.2", 17, 53, 0, True, 28), (2, "2.2.2.2", 1, 0, 0, False, 28),
        (4, "fe80::2", 6, 443, 2, False, 68), (8, "2.2.2.2", 6, 0, 0, False, 24)]


def test_deep_headers(spark):
    hop = bytes([0, 0]) + b"\0" * 6
    deep = ipv6("::1", "fe80::2", 0, hop * 14 + bytes([6, 0]) + b"\0" * 6 + tcp(1, 443, 2))
    layers = ipv4("10.0.0.1", "10.0.0.2", 17, udp(1, 2))
    for _ in range(6):
        layers = ipv4("1.1.1.1", "2.2.2.2", 47, struct.pack("!HH", 0, 0x0800) + layers)
    got = packets(spark, [ether(ipv4("1.1.1.1", "2.2.2.2", 6, tcp(5, 80, 2)), tags=(0x8100,) * 5), ether(deep, 0x86DD), ether(layers)], gre_strip=True)
    assert [(r.dst_ip, r.dst_port) for r in got] == [("2.2.2.2", 80), ("fe80::2", 443), ("10.0.0.2", 2)]


def test_gre_layers(spark):
    inner = ipv4("10.0.0.1", "10.0.0.2", 17, udp(1, 2))
    once = ipv4("1.1.1.1", "2.2.2.2", 47, struct.pack("!HHI", 0x2000, 0x0800, 7) + inner)
    twice = ipv4("3.3.3.3", "4.4.4.4", 47, struct.pack("!HH", 0, 0x0800) + once)
    other = ipv4("1.1.1.1", "2.2.2.2", 47, struct.pack("!HH", 0, 0x6558) + inner)
    got = packets(spark, [ether(once), ether(twice), ether(other)], gre_strip=True)
    assert [(r.dst_ip, r.was_gre, r.pkt_len, r.outer_len) for r in got] == [
        ("10.0.0.2", True, 28, 56), ("10.0.0.2", True, 28, 80), ("2.2.2.2", False, 52, 52)]
    assert [r.dst_ip for r in packets(spark, [ether(once), ether(twice)])] == ["2.2.2.2", "4.4.4.4"]


def test_dns_names(spark):
    def query(flags, name):
        labels = b"".join(bytes([len(p)]) + p for p in name) + b"\0"
        return struct.pack("!HHHHHH", 1, flags, 1, 0, 0, 0) + labels + b"\0\1\0\1"
    got = packets(spark, [ether(ipv4("1.1.1.1", "2.2.2.2", 17, udp(5, 53, query(0x0100, (b"www", b"example"))))),
                          ether(ipv4("1.1.1.1", "2.2.2.2", 17, udp(53, 5, query(0x8100, (b"www",))))),
                          ether(ipv4("1.1.1.1", "2.2.2.2", 17, udp(5, 80, query(0, (b"x",)))))])
    assert [r.dns_qname for r in got] == ["www.example.", None, None]


def test_pcap_both_byte_orders(spark, tmp_path):
    frame = ether(ipv4("1.1.1.1", "2.2.2.2", 6, tcp(5, 80, 2)))
    for order, name in (("<", "little"), (">", "big")):
        head = struct.pack(order + "IHHIIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
        record = struct.pack(order + "IIII", 3, 4, len(frame), len(frame)) + frame
        (tmp_path / f"{name}.pcap").write_bytes(head + record * 2 + record[:-5])
    fine = struct.pack("<IHHIIII", 0xA1B23C4D, 2, 4, 0, 0, 65535, 1) + struct.pack("<IIII", 3, 4000, len(frame), len(frame)) + frame
    (tmp_path / "nano.pcap").write_bytes(fine)
    (tmp_path / "bad.pcap").write_bytes(b"nothing to see here, move on please")
    rows = fr.read_pcap(spark, str(tmp_path))
    assert [(r.frame_no, r.ts_us, bytes(r.frame)) for r in rows.orderBy("path", "frame_no").collect()] == [
        (0, 3000004, frame), (1, 3000004, frame)] * 2 + [(0, 3000004, frame)]
    assert fr.decode_frames(rows).filter(F.col("tcp_flags") == 2).count() == 5
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert [r.path.endswith("bad.pcap") for r in fr.unreadable_captures(files).collect()] == [True]


def test_equal_definitions_are_read_once(spark, monkeypatch):
    """Definitions of a batch are parsed by content, and come out as often as they were sent, whatever stands between them."""
    import pyarrow as pa

    read = []
    plain = d._definitions
    monkeypatch.setattr(d, "_definitions", lambda body, set_id: (read.append(set_id), plain(body, set_id))[1])
    two = template(256, FIELDS) + template(257, FIELDS[:2])
    bodies, kinds = [two, template(256, FIELDS), two, b"", two, two], [0, 0, 0, 0, 1, 2]
    batch = pa.RecordBatch.from_pydict({"set_id": pa.array(kinds, pa.int64()), "body": pa.array(bodies, pa.binary())})
    rows, columns = d._read_templates(batch)
    want = [(n, *found) for n, (body, kind) in enumerate(zip(bodies, kinds)) for found in plain(body, kind)]
    got = list(zip(rows.tolist(), columns["template_id"].to_pylist(), columns["is_options"].to_pylist(), columns["fields"].to_pylist()))
    assert got == want and len(read) == 5
    rows, columns = d._read_templates(batch.slice(3, 1))
    assert len(rows) == 0 and all(len(c) == 0 for c in columns.values())


def test_sampling_writes_its_sets_once(spark, tmp_path):
    """Data of other templates never meets the layouts of options."""
    rates = d.extract_sampling(*_sets_and_templates(spark))
    assert [(r.seq, r.rate) for r in rates.collect()] == [(1, 9)]
    assert "options-data" in rates._jdf.queryExecution().toString()


def _sets_and_templates(spark):
    options = (1, struct.pack("!HHHHHHH", 300, 4, 4, 1, 4, 34, 4))
    rows = frame_of(spark, [v9(options, (0, template(256, FIELDS))), v9((256, data_record()), (300, struct.pack("!II", 1, 9)))])
    sets = d.template_sets(d.route_datagrams(rows))
    return sets, d.extract_templates(sets)


def test_layouts_of_definitions(spark):
    """Equal definitions are laid out alike; the last field of an element counts, others only take room; no arrays go to Python."""
    fields = [[(8, 4), (-1, 3), (1, 2), (8, 4), (7, 3)], [(34, 4)], [(8, 4), (-1, 3), (1, 2), (8, 4), (7, 3)], [(305, 5)]]
    rows = [("e", 0, 256, k, 0, k, k == 1, f) for k, f in enumerate(fields)]
    found = d.template_layouts(spark.createDataFrame(rows, schemas.TEMPLATES))
    got = {r.seq: np.frombuffer(r.layout, np.int64).tolist() for r in found.collect()}
    names = list(d.ELEMENTS)

    def layout(size, options, **at):
        return [size, options, *(n for name in names for n in at.get(name, (-1, 0)))]

    assert got == {0: layout(16, 0, src4=(9, 4), octets=(7, 2)), 1: layout(4, 1, rate=(0, 4)), 2: got[0], 3: layout(5, 0)}
    assert not any(f.dataType.typeName() == "array" for f in found.schema)


def lines_of(spark, path, rows):
    columns = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_returnflag string"
    spark.createDataFrame(rows, columns).coalesce(1).write.parquet(f"{path}/lineitem.parquet")
    return path


def test_datagrams_are_dealt_once(spark, tmp_path):
    """All formats come from one shuffle of the lines; unknown fields leave a record out, numbers that are too long keep their leading digits."""
    path = lines_of(spark, str(tmp_path), [
        (5, 251, 1, 2, 7.0, "A"), (5, 251, 1, 1, 3.0, "N"), (5, None, 1, 3, 1.0, "N"), (5, 70_000, 1, 4, 1.0, "N"), (6, 1, 2, 1, 2.0**40, "R"),
        (7, 1, None, 1, 1.0, "R")])
    sent = encoded.mixed_datagrams(spark, path)
    assert sent._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = {(r.exporter_ip, r.seq): r.payload for r in sent.collect()}
    head = struct.pack("!HH18xH", 5, 4, 0x4001)
    record = "!4s4s8xII8xHHxBB9x"
    first, second = (struct.pack(record, bytes([10, 1, 1, 1]), bytes([192, 0, 2, 1]), n, n * 311, 1275, 443, flags, 6) for n, flags in ((3, 16), (7, 2)))
    assert got["v5-198.51.100.1", 5 * 10**9 + 5] == head + first + second
    packets = got["v5-198.51.100.2", 6 * 10**9 + 6][24 + 16:24 + 20]
    assert packets == bytes.fromhex(f"{2**40:X}"[:8])
    unknown = [r.payload and len(r.payload) for r in sent.filter("exporter_ip IS NULL").collect()]
    assert sorted(unknown, key=str) == [16 + 4 + 36, None, None]
    flows = d.decode_datagrams(sent.filter("exporter_ip LIKE '%100.1'"))
    assert sorted((r.exporter_ip[:2], r.packets) for r in flows.collect()) == [("sf", 3), ("sf", 7), ("te", 7), ("v5", 3), ("v5", 7)]
