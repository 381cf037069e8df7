"""Column contracts of the telemetry tables."""

from __future__ import annotations

from pyspark.sql import types as T

_L, _S, _D, _B = T.LongType(), T.StringType(), T.DoubleType(), T.BinaryType()


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


FLOWS = _struct(
    ts=T.TimestampType(), tick=_L, node_id=_S, exporter_ip=_S, src_ip=_S, dst_ip=_S,
    src_port=_L, dst_port=_L, protocol=_L, packets=_L, octets=_L, tcp_flags=_L, sample_rate=_L,
)

DATAGRAMS = _struct(ts=T.TimestampType(), tick=_L, seq=_L, exporter_ip=_S, payload=_B)

PACKETS = _struct(
    ts=T.TimestampType(), tick=_L, node_id=_S, src_ip=_S, dst_ip=_S, src_port=_L, dst_port=_L,
    protocol=_L, pkt_len=_L, tcp_flags=_L, ttl=_L, is_fragment=T.BooleanType(), payload=_B,
    dns_qname=_S, was_gre=T.BooleanType(), inner_dst_ip=_S, outer_len=_L, inner_len=_L,
)

COUNTERS = _struct(node_id=_S, ts=T.TimestampType(), tick=_L, rx_packets=_L, rx_bytes=_L,
                   tcp_in=_L, udp_in=_L, icmp_in=_L)

HTTP_REQUESTS = _struct(
    ts=T.TimestampType(), tick=_L, site_id=_S, ip=_S, method=_S, path=_S, status=_L, size=_L,
    ua=_S, resp_time_ms=_D, http_version=_S,
)

FRAMES = _struct(path=_S, frame_no=_L, ts_us=_L, link_type=_L, orig_len=_L, frame=_B)

TEMPLATES = T.StructType([
    T.StructField("exporter_ip", _S), T.StructField("domain", _L), T.StructField("template_id", _L),
    T.StructField("seq", _L), T.StructField("set_no", _L), T.StructField("tick", _L),
    T.StructField("is_options", T.BooleanType()),
    T.StructField("fields", T.ArrayType(_struct(id=_L, len=_L))),
])

BASELINE_STATE = T.StructType([
    T.StructField("key", _S), T.StructField("saved_tick", _L),
    T.StructField("pps", T.ArrayType(_D)), T.StructField("bps", T.ArrayType(_D)),
    T.StructField("avg_pps", _D), T.StructField("p99_pps", _D), T.StructField("avg_bps", _D),
    T.StructField("p99_bps", _D), T.StructField("threshold", _D), T.StructField("bps_threshold", _D),
    T.StructField("ready", T.BooleanType()),
])

# One line per detector decision; the detectors for nodes and destinations share it.
DETECTION_EVENTS = _struct(
    key=_S, event=_S, tick=_L, started_tick=_L, pps=_D, bps=_D, peak_pps=_D, peak_bps=_D,
    threshold=_D, avg_pps=_D, snap_tick=_L,
)

HTTP_EVENTS = _struct(
    key=_S, event=_S, tick=_L, started_tick=_L, rps=_D, peak_rps=_D, baseline_rps=_D, signals=_L,
)
