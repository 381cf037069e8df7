"""Captured frames: pcap files and the decoding of Ethernet, IP, GRE and transport headers."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from trafficlens import schemas
from trafficlens.functions.network import UDP
from trafficlens.sources.wire import Cells, batches_of, dns_name, ip_header, link_header, transport, transport_start, tunnelled

# Link types.
ETHERNET, LINUX_COOKED = 1, 113
# First bytes of a capture file, byte order, and nanoseconds of its second time field.
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 1000), b"\xa1\xb2\xc3\xd4": (">", 1000), b"\x4d\x3c\xb2\xa1": ("<", 1), b"\xa1\xb2\x3c\x4d": (">", 1)}

FILE_HEADER, RECORD_HEADER = 24, 16
_BATCH = 4096


def _frames_of(path: str, content: bytes) -> Iterator[tuple]:
    """Frames of one capture file, either byte order, micro- or nanoseconds; a cut-off last record is left out."""
    if len(content) < FILE_HEADER:
        return
    if content[:4] not in MAGIC:
        return
    order, nanoseconds = MAGIC[content[:4]]
    link_type = struct.unpack_from(order + "I", content, 20)[0]
    record = struct.Struct(order + "IIII")
    position, number = FILE_HEADER, 0
    while position + RECORD_HEADER <= len(content):
        seconds, micros, kept, original = record.unpack_from(content, position)
        position += RECORD_HEADER
        if position + kept > len(content):
            return
        yield path, number, seconds * 1_000_000 + micros * nanoseconds // 1000, link_type, original, content[position:position + kept]
        position, number = position + kept, number + 1


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows: list[tuple] = []
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            for frame in _frames_of(path, bytes(content)):
                rows.append(frame)
                if len(rows) >= _BATCH:
                    yield pd.DataFrame(rows, columns=schemas.FRAMES.names)
                    rows = []
    yield pd.DataFrame(rows, columns=schemas.FRAMES.names)


def scan_pcap(files: DataFrame) -> DataFrame:
    """Frames of capture files given as rows of path, content.

    A row is one unit of work; frames leave in batches and are never collected per file. For files that are
    too large for that, see ``captures.read_large_pcap``.
    """
    return files.select("path", "content").mapInPandas(_scan, schemas.FRAMES)


def unreadable_captures(files: DataFrame) -> DataFrame:
    """Paths of the files, given as path and content, that are no capture in a known form."""
    known = [F.lit(bytearray(magic)) for magic in MAGIC]
    return files.filter(F.length("content").isNull() | (F.length("content") < FILE_HEADER) | ~F.substring("content", 1, 4).isin(*known)).select("path")


def read_pcap(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pcap").load(path)
    return scan_pcap(files)


# --- headers ---------------------------------------------------------------

PACKET_COLUMNS = ("src_ip string, dst_ip string, src_port bigint, dst_port bigint, protocol bigint, pkt_len bigint, tcp_flags bigint, "
                  "ttl bigint, is_fragment boolean, payload binary, dns_qname string, was_gre boolean, inner_dst_ip string, outer_len bigint, inner_len bigint")


def _packets(batch: pa.RecordBatch, gre_strip: bool) -> tuple[np.ndarray, dict]:
    names = batch.schema.names
    cooked = batch.column(names.index("link_type")).to_numpy(zero_copy_only=False) == LINUX_COOKED
    frame = Cells.of(batch.column(names.index("frame")))
    kind, at = link_header(frame, cooked)
    ip = ip_header(frame, at, kind)
    outer, layers = ip["pkt_len"], np.zeros(len(frame), np.int64)
    while gre_strip:
        inside, start, kind = tunnelled(frame, ip)
        if not inside.any():
            break
        inner = ip_header(frame, start, kind)
        ip = {name: np.where(inside, inner[name], value) for name, value in ip.items()}
        layers += inside
    rows = np.flatnonzero(ip["whole"])
    ip, frame, outer, layers = {name: value[rows] for name, value in ip.items()}, frame.rows(rows), outer[rows], layers[rows]
    protocol, at = transport_start(frame, ip)
    l4 = transport(frame, protocol, at)
    data = frame.part(l4["data_at"], frame.size - l4["data_at"])
    there = (l4["data_at"] >= 0) & (data.size > 0)
    payload = np.full(len(rows), None, object)
    payload[there] = np.array([*data.rows(there).pieces(), None], object)[:-1]
    dns = (protocol == UDP) & ((l4["dst_port"] == 53) | (l4["src_port"] == 53))
    dst_ip = np.array([*frame.addresses(ip["dst_at"], ip["v6"]), None], object)[:-1]
    columns = {name: l4[name] for name in ("src_port", "dst_port", "tcp_flags")} | {name: ip[name] for name in ("pkt_len", "ttl", "is_fragment")}
    return rows, columns | {
        "src_ip": frame.addresses(ip["src_at"], ip["v6"]), "dst_ip": dst_ip, "protocol": protocol, "payload": payload,
        "dns_qname": [dns_name(p) if d and p is not None else None for d, p in zip(dns.tolist(), payload)], "was_gre": layers > 0,
        "inner_dst_ip": np.where(layers > 0, dst_ip, None), "outer_len": outer, "inner_len": ip["pkt_len"]}


def decode_frames(frames: DataFrame, gre_strip: bool = False) -> DataFrame:
    """Packet rows from captured frames; frames that carry no IP drop out.

    VLAN tags, IPv6 extension headers and, with ``gre_strip``, tunnel layers are followed to the
    end; the innermost packet is reported. The outer length and destination of a tunnelled packet are kept.
    """
    size = F.length("frame")
    cooked = F.col("link_type") == LINUX_COOKED
    rows = frames.filter(F.col("link_type").isin(ETHERNET, LINUX_COOKED) & (size >= F.when(cooked, 16).otherwise(14)))
    others = [name for name in frames.columns if name not in ("frame", "link_type", "orig_len")]
    schema = T.StructType([*frames.select(*others).schema.fields, *T.StructType.fromDDL(PACKET_COLUMNS).fields])
    run = batches_of(lambda batch: _packets(batch, gre_strip), others, to_arrow_schema(schema))
    return rows.select(*others, "link_type", "frame").mapInArrow(run, schema)
